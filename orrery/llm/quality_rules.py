"""Quality rules: a learned decision list over text statistics, run as one Spark conditional expression.

Statistics of a text are computed by DataFrame functions alone. One list of rules for both classes, bad and good, is learned by sequential
covering: each rule is a conjunction of thresholds, grown by information gain on two thirds of a labelled sample and pruned on
the rest; of the best rule for each class the one that is right more often among the pruning rows comes next in the list, and rows that it
covers leave before the next is grown. What no rule covers gets the default, the class of most rows that are left. The list becomes a chain of when().

Null and empty texts have no words and fail the base rule (under 50 words). Repeated rows are judged alike, an empty
table gives an empty result, no labels give an empty list (which keeps everything), extra columns are ignored. Texts of any length are
taken whole. Of equally good conditions the first in the order of features and thresholds stands; of equally good rules the one for bad rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import spread

#: White space between words: \x20, \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Labelled rows used for fitting, at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Thresholds tried for each statistic: so many quantiles of the labelled sample.
N_THRESHOLDS = 24
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule stays if at least this share of what it covers among the pruning rows is of its class (with one virtual row of each class).
MIN_PRECISION = 0.9
MIN_COVERED = 4

FEATURES = (
    "n_words",
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "digit_share",
    "bang_share",
    "pipe_share",
    "mean_line_words",
)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column, width: int) -> Column:
    """Positions inside windows of so many words that occur twice or more in the array."""
    n_windows = F.size(words) - F.lit(width - 1)
    windows = F.transform(
        F.sequence(F.lit(0), n_windows - 1),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"), i.alias("p")),
    )

    def starts(a: Column) -> Column:
        again = F.transform(
            a,
            lambda x, j: F.when(
                (F.get(a, j - 1)["h"] == x["h"]) | (F.get(a, j + 1)["h"] == x["h"]),
                x["p"],
            ),
        )
        return F.sort_array(F.array_compact(again))

    total = F.aggregate(
        _let(F.sort_array(windows), starts),
        F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(n_windows > 1, total).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and FEATURES' shares, of every whole text."""
    text = F.col("_t")
    base = spread(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")))
    base = base.withColumn("_w", F.array_remove(F.split(text, SPACE), ""))
    base = base.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""))
    counts = base.select(
        F.col(id_col),
        F.size("_w").cast("long").alias("n_words"),
        (F.length(text) - _removed(text, SPACES)).cast("long").alias("word_chars"),
        _removed(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_w"), 3).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("_n_lines"),
        _removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        _removed(text, "0123456789").alias("_digit"),
        _removed(text, "!?").alias("_bang"),
        _removed(text, "|").alias("_pipe"),
    )
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "_n_lines"))
    return counts.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("_upper") / chars).alias("upper_share"),
        (F.col("_digit") / chars).alias("digit_share"),
        (F.col("_bang") / chars).alias("bang_share"),
        (F.col("_pipe") / chars).alias("pipe_share"),
        (F.col("n_words") / lines).alias("mean_line_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# --- learning ---------------------------------------------------------------------------------------------------------


def _over(feature: str):
    return lambda t: F.col(feature) > t


def _between(values: list[float]) -> list[float]:
    """The values, and points between neighbours: a rule can then stand off from both classes."""
    return sorted({v + (w - v) * share for v, w in zip(values, [*values[1:], values[-1]]) for share in (0, 0.1, 0.25, 0.5)}) if values else []


def labelled_statistics(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bound: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text"):
    """Thresholds of each feature, and how many labelled rows have each combination of features cut at them: [({feature: bin}, label, count)].

    Only statistics of at most `bound` labelled rows (the smallest hashes of their ids) reach the driver.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(bound)
    )
    rows = statistics(docs.select(id_col, text_col).join(F.broadcast(chosen.select(id_col)), id_col, "left_semi"), id_col, text_col)
    # kept before it is filtered: a filter pushed below the statistics would compute them again
    kept = rows.join(F.broadcast(chosen), id_col).persist()
    # base failures are decided before the list, so it is learned on the rest
    rows = kept.where(~base_failed()).select("_label", *FEATURES)
    try:
        ranks = [(i + 0.5) / N_THRESHOLDS for i in range(N_THRESHOLDS)]
        cuts = rows.select(*[F.percentile_approx(f, F.lit(ranks), 10_000).alias(f) for f in FEATURES]).first()
        cuts = {f: _between(sorted(set(cuts[f] or []))) for f in FEATURES}
        bins = [F.size(F.filter(F.lit(cuts[f]), _over(f))).alias(f) if cuts[f] else F.lit(0).alias(f) for f in FEATURES]
        table = rows.select("_label", *bins).groupBy("_label", *FEATURES).count().collect()
    finally:
        kept.unpersist()
    return cuts, [({f: r[f] for f in FEATURES}, r["_label"], r["count"]) for r in sorted(table, key=lambda r: tuple(r))]


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """FOIL's gain: positives kept, times the bits by which being positive has become likelier."""
    if not after[0]:
        return -math.inf
    bits = lambda p, n: math.log2(p / (p + n))
    return after[0] * (bits(*after) - bits(*before))


def _count(rows, target) -> tuple[int, int]:
    p = sum(n for _, label, n in rows if label == target)
    return p, sum(n for _, _, n in rows) - p


def _match(bins: dict, conditions) -> bool:
    return all((bins[f] > k) if above else (bins[f] <= k) for f, above, k in conditions)


class Rules(list):
    """Rules in the order in which they apply, and the verdict where none does."""

    def __init__(self, rules=(), default: bool = True):
        super().__init__(rules)
        self.default = default


def _grown(cuts: dict[str, list[float]], rows, target: int) -> list[tuple[str, bool, int]]:
    """Conditions of the conjunction for `target` that gains most, step by step. A condition (f, above, k) holds for bins over k, that is, for values over the k-th threshold."""
    conditions, grow = [], rows
    while len(conditions) < MAX_CONDITIONS and _count(grow, target)[0] and _count(grow, target)[1]:
        now, best, best_gain = _count(grow, target), None, 1e-9
        for f in FEATURES:
            per = {}
            for bins, label, n in grow:
                c = per.setdefault(bins[f], [0, 0])
                c[label != target] += n
            low = [0, 0]
            for k in range(len(cuts[f])):
                at = per.get(k, (0, 0))
                low = [low[0] + at[0], low[1] + at[1]]
                for above, after in ((False, tuple(low)), (True, (now[0] - low[0], now[1] - low[1]))):
                    # of equal conditions on one feature, the one that leaves most room to the other class
                    wider = best is not None and above and best[:2] == (f, True)
                    if (g := _gain(now, after)) > best_gain or wider and g == best_gain:
                        best, best_gain = (f, above, k), g
        if best is None:
            break
        conditions.append(best)
        grow = [x for x in grow if _match(x[0], [best])]
    return conditions


def learn(cuts: dict[str, list[float]], rows) -> Rules:
    """Sequential covering over binned rows."""
    grow_all, prune_all = [x for i, x in enumerate(rows) if i % 3], [x for i, x in enumerate(rows) if not i % 3]
    out = Rules()
    while len(out) < MAX_RULES:
        choices = []
        for target in (0, 1):
            if not (conditions := _grown(cuts, grow_all, target)):
                continue

            def worth(cs, target=target) -> float:
                p, n = _count([x for x in prune_all if _match(x[0], cs)], target)
                return (p + 1) / (p + n + 2)

            while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
                conditions = conditions[:-1]
            p, n = _count([x for x in [*grow_all, *prune_all] if _match(x[0], conditions)], target)
            if worth(conditions) >= MIN_PRECISION and p >= MIN_COVERED and p / (p + n) >= MIN_PRECISION:
                # rules of like worth: those for bad rows first, since a wrong rule for good ones would hide them
                choices.append((round(p / (p + n), 2), -target, target, conditions))
        if not choices:
            break
        *_, target, conditions = max(choices, key=lambda c: c[:2])
        # bins count thresholds strictly below a value: bin > k means value > cuts[k]
        out.append(Rule(tuple(Condition(f, above, float(cuts[f][k])) for f, above, k in conditions), keep=target == 1))
        grow_all = [x for x in grow_all if not _match(x[0], conditions)]
        prune_all = [x for x in prune_all if not _match(x[0], conditions)]
    good, bad = _count([*grow_all, *prune_all], 1)
    out.default = good >= bad
    return out


def verdict(rules: list[Rule], default: bool | None = None) -> Column:
    """The list as one conditional expression: the first rule that holds decides."""
    default = getattr(rules, "default", True) if default is None else default
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(r.keep)) if out is None else out.when(r.column(), F.lit(r.keep))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def fit(docs: DataFrame, labels: DataFrame, **kw) -> Rules:
    cuts, rows = labelled_statistics(docs, labels, **kw)
    return learn(cuts, rows)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every document, base_failed, kept, and rule: the place in the list of the rule that decided (null: none)."""
    number = None
    for i, r in enumerate(rules):
        number = F.when(r.column(), F.lit(i)) if number is None else number.when(r.column(), F.lit(i))
    rows = statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    return rows.withColumns({"kept": ~F.col("base_failed") & verdict(rules), "rule": F.lit(None).cast("int") if number is None else number})
