"""Quality classifier from weak labels: overlapping labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Labellers look at a text and vote good, bad, or nothing, on two questions: is it text of quality, is it free of abuse. The given
labels are two more labellers, which know only some documents. Votes of all documents are counted by pattern; from the counts,
expectation-maximisation estimates how often each labeller is right, and with it the chance that a document of each pattern is good.
These posterior labels train one linear scorer for each question over hashed features (beginnings of words, and cut-up statistics),
by stochastic gradient steps with shrinkage, on at most MAX_TRAINING documents (the smallest hashes of ids among the labelled) and
MAX_UNLABELLED others, of which those count, for less, whose posterior stands on the other side than the prior. Without labels all are from all documents. A document is kept if both scorers find it good.

Null and empty texts have no vote against them and are kept or not by the scorers' bias alone, like any other text; repeated
rows are judged alike; an empty table gives an empty result; extra columns are ignored (and kept by `keep`). Texts of any length are
taken whole. Contradictory labels of one id cancel out.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import map_rows, release, ship, spread

MAX_TRAINING = 8_000
BITS = 18
EPOCHS = 4
RATE = 0.15
SHRINK = 2e-4
#: Unlabelled documents that train the scorers too, at most, and what one weighs beside a labelled one.
MAX_UNLABELLED = 2_000
UNLABELLED_WEIGHT = 0.2
SEED = 11
#: Words remembered in a task, about 300 bytes each.
REMEMBERED = 80_000
TASKS = ("quality", "clean")

#: Common insults in English.
INSULTS = frozenset("arsehole asshole bastard bitch clown cretin disgusting dumbass filth garbage idiot idiotic imbecile jerk loser moron pathetic retard scum scumbag stupid trash vermin worthless".split())
ENGLISH = frozenset("a an and are as at be but by for from has have he her his in is it its not of on or she that the their they this to was were which will with you".split())
CONTEMPT = frozenset("clown disgusting garbage loser pathetic trash worthless scum filth vermin".split())
SYMBOLS = "#*$%&|<>"
WORD = re.compile(r"[^\W\d_]+")


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


@dataclass
class Statistics:
    n_words: int
    symbol_share: float
    dup_lines: float
    distinct: float
    upper: float
    bang: float
    pipes: float
    runs: float
    mean_word: float
    stops: float
    english: float
    insults: int
    contempt: int


_crc32, _MASK = zlib.crc32, (1 << BITS) - 1


def _of_word(word: str) -> tuple[int, int, bool, bool, bool, int, int]:
    """Letters, capitals (of words in capitals), English function word, insult, contempt, hashed beginnings (-1: none)."""
    core = word.strip(".,;:!?\"'()[]#*$%&|<>")
    if not core.isalpha():
        core = max(WORD.findall(core), key=len, default="")
    low = core.lower()
    n = len(core)
    if n < 3:
        return n, n if n > 1 and core.isupper() else 0, low in ENGLISH, False, False, -1, -1
    head = ("w" + low[:5]).encode("utf-8", "surrogatepass")
    return n, n if core.isupper() else 0, low in ENGLISH, low in INSULTS, low in CONTEMPT, _crc32(("w" + low[:4]).encode("utf-8", "surrogatepass")) & _MASK, _crc32(head) & _MASK


class Reader:
    """Statistics of texts, remembering what it found out about words (REMEMBERED of them, then afresh)."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def read(self, text: str) -> tuple[Statistics, np.ndarray, np.ndarray]:
        """Statistics, hashed features of the statistics (short texts apart), hashed features of words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = text.split()
        counts = Counter(words)
        n = max(1, len(words))
        letters = capitals = english = insults = contempt = 0
        starts: set[int] = set()
        add = starts.add
        for w, k in counts.items():
            x = self.known.get(w)
            if x is None:
                x = self.known[w] = _of_word(w)
            n_letters, n_capitals, is_english, is_insult, is_contempt, four, five = x
            letters += k * n_letters
            if n_capitals:
                capitals += k * n_capitals
            if is_english:
                english += k
            if is_insult:
                insults += k
                contempt += k * is_contempt
            add(four)
            add(five)
        starts.discard(-1)
        chars = max(1, sum(map(len, words)))
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        s = Statistics(
            len(words),
            sum(map(text.count, SYMBOLS)) / chars,
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            len(counts) / n,
            capitals / max(1, letters),
            text.count("!!") / n,
            text.count("|") / n,
            sum(map(operator.eq, words, words[1:])) / n,
            chars / n,
            text.count(".") / n,
            english / n,
            insults,
            contempt,
        )
        short = "short" if s.n_words < 15 else "long"
        cut = {_bucket(f"{short}:{name}:{sum(getattr(s, name) >= c for c in cuts)}") for name, cuts in CUTS.items()}
        return s, np.fromiter(cut, np.int64, len(cut)), np.fromiter(starts, np.int64, len(starts))


#: name: (task, vote of the statistics). That a text lacks one defect says little, so most vote against or not at all.
LABELLERS = {
    "symbols": ("quality", lambda s: -(s.symbol_share >= 0.03)),
    "pipes": ("quality", lambda s: -(s.pipes >= 0.1)),
    "dup_lines": ("quality", lambda s: -(s.dup_lines >= 0.4)),
    "repetitive": ("quality", lambda s: -(s.n_words >= 15 and s.distinct < 0.35)),
    "shouting": ("quality", lambda s: -(s.n_words >= 8 and s.upper >= 0.4)),
    "bangs": ("quality", lambda s: -(s.bang >= 0.15)),
    "doubled": ("quality", lambda s: -(s.n_words >= 8 and s.runs >= 0.25)),
    "prose": ("quality", lambda s: 1 if 0.02 <= s.stops <= 0.5 and s.upper < 0.2 and s.symbol_share < 0.01 and s.runs < 0.1 else 0),
    "varied": ("quality", lambda s: 1 if s.distinct > 0.45 and s.symbol_share < 0.02 and s.dup_lines < 0.2 else 0),
    "insults": ("clean", lambda s: -1 if s.insults >= 2 else 1 if s.insults == 0 and s.english >= 0.1 else 0),
    "contempt": ("clean", lambda s: -(s.contempt >= 2)),
}
GIVEN = {"quality": "given_quality", "clean": "given_clean"}


def labellers_of(task: str) -> list[str]:
    return [n for n, (t, _) in LABELLERS.items() if t == task] + [GIVEN[task]]


#: Cuts of the statistics that become features.
CUTS = {"symbol_share": (0.003, 0.02, 0.05, 0.1), "dup_lines": (0.05, 0.2, 0.4), "distinct": (0.25, 0.35, 0.45, 0.6), "upper": (0.05, 0.2, 0.5), "bang": (0.01, 0.1, 0.3), "pipes": (0.01, 0.1, 0.3), "runs": (0.05, 0.15, 0.3), "mean_word": (3, 4, 8, 12)}


def votes(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and one vote for each labeller."""
    names = list(LABELLERS)

    def make():
        reader = Reader()

        def f(key, text):
            s, *_ = reader.read(text or "")
            return [(key, *(int(LABELLERS[n][1](s)) for n in names))]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_rows(spread(docs.select(F.col(id_col), F.col(text_col))), make, f"{id_col} {kind}, " + ", ".join(f"{n} int" for n in names))
    if labels is None:
        return rows.withColumns({n: F.lit(0) for n in GIVEN.values()})
    return rows.join(_given(labels, id_col), id_col, "left").fillna(0, list(GIVEN.values()))


def _given(labels: DataFrame, id_col: str) -> DataFrame:
    """One row for each labelled document; contradictory labels cancel out."""
    sign = lambda c, good: F.signum(F.avg(F.when(F.col(c) == good, 1).when(F.col(c).isNotNull(), -1))).cast("int")
    return labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(sign("quality", 1).alias("given_quality"), sign("toxic", 0).alias("given_clean"))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50):
    """patterns: votes and their count. Returns the share of good ones, each labeller's accuracy on good and on bad, and each pattern's chance to be good."""
    if not patterns:
        return 0.5, np.zeros((0, 2)), {}
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    # start: the mean of the votes
    good = np.clip(0.5 + 0.45 * v.sum(1) / np.maximum(1, np.abs(v).sum(1)), 0.02, 0.98)
    for _ in range(rounds):
        prior = np.clip((n * good).sum() / n.sum(), 0.02, 0.98)
        accuracy = np.empty((v.shape[1], 2))
        for j in range(v.shape[1]):
            for y, weight in ((0, n * good), (1, n * (1 - good))):
                right, said = (weight * (v[:, j] == (1, -1)[y])).sum(), (weight * (v[:, j] != 0)).sum()
                accuracy[j, y] = (right + 4) / (said + 5)  # four right answers of five beforehand
        accuracy = np.clip(accuracy, 0.05, 0.995)
        log = np.full((len(v), 2), (math.log(prior), math.log(1 - prior)))
        for j in range(v.shape[1]):
            log[:, 0] += np.where(v[:, j] == 1, np.log(accuracy[j, 0]), np.where(v[:, j] == -1, np.log(1 - accuracy[j, 0]), 0))
            log[:, 1] += np.where(v[:, j] == -1, np.log(accuracy[j, 1]), np.where(v[:, j] == 1, np.log(1 - accuracy[j, 1]), 0))
        good = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
    return prior, accuracy, {p: float(g) for (p, _), g in zip(patterns, good)}


def train_scorer(rows: list[np.ndarray], good: np.ndarray, only_against: bool = False, sure: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, the rarer class weighing more, each row as much as it is sure; weights shrink towards zero at each use.

    only_against: no feature speaks for a text, so that a long one can't outweigh what is wrong with it.
    """
    w, b = np.zeros(1 << BITS), 2.0 if only_against else 0.0
    g2 = np.full(1 << BITS, 1e-2)
    sure = np.ones(len(rows)) if sure is None else sure
    n, total = sure.sum(), (max((sure * good).sum(), 1e-9), max((sure * (1 - good)).sum(), 1e-9))
    r = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in r.permutation(len(rows)):
            x, y = rows[i], good[i]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w[x].sum() + b))))
            weight = min(4.0, n / 2 / total[0]) * y + min(4.0, n / 2 / total[1]) * (1 - y)
            g = sure[i] * weight * (y - p)
            g2[x] += g * g
            step = w[x] + RATE * g / np.sqrt(g2[x])
            step = np.sign(step) * np.maximum(0, np.abs(step) - SHRINK)
            w[x] = np.minimum(step, 0) if only_against else step
            b += 0.02 * g
    # features of little weight only add up to noise in long texts
    w[np.abs(w) < 0.1] = 0
    return w, b


@dataclass
class Model:
    weights: np.ndarray  # task, feature
    bias: np.ndarray
    prior: dict
    accuracy: dict


def fit(docs: DataFrame, labels: DataFrame | None, bound: int = MAX_TRAINING, id_col: str = "doc_id", text_col: str = "text") -> Model:
    ship(docs.sparkSession)
    every = [*LABELLERS, *GIVEN.values()]
    counted = votes(docs, labels, id_col, text_col).groupBy(*every).count().collect()  # at most 3 to the power of the labellers
    posterior, prior, accuracy = {}, {}, {}
    for task in TASKS:
        names = labellers_of(task)
        patterns: dict[tuple[int, ...], int] = {}
        for r in counted:
            key = tuple(r[n] for n in names)
            patterns[key] = patterns.get(key, 0) + r["count"]
        prior[task], accuracy[task], posterior[task] = expectation_maximisation(sorted(patterns.items()))

    source = spread(docs.select(F.col(id_col), F.col(text_col))).where(F.col(id_col).isNotNull())
    ids = source.select(id_col).distinct()
    smallest = lambda df, n: df.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(n)
    if labels is not None:
        known = _given(labels, id_col)
        chosen, others = smallest(known, bound), smallest(ids.join(known.select(id_col), id_col, "left_anti"), MAX_UNLABELLED)
        sample = source.join(F.broadcast(chosen.unionByName(others)), id_col, "left_semi").join(F.broadcast(known.join(F.broadcast(chosen), id_col, "left_semi")), id_col, "left").fillna(0, list(GIVEN.values()))
    else:
        sample = source.join(F.broadcast(smallest(ids, bound)), id_col, "left_semi").withColumns({n: F.lit(0) for n in GIVEN.values()})

    def make():
        reader = Reader()

        def f(key, text, q, c):
            s, *x = reader.read(text or "")
            return [(key, *(int(LABELLERS[n][1](s)) for n in LABELLERS), q, c, *(a.astype(np.int32).tobytes() for a in x))]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_rows(sample.select(id_col, text_col, *GIVEN.values()), make, f"{id_col} {kind}, " + ", ".join(f"{n} int" for n in every) + ", x_quality binary, x_clean binary").dropDuplicates([id_col]).orderBy(F.xxhash64(id_col), id_col).limit(bound + MAX_UNLABELLED).collect()
    weights, bias = [], []
    for task in TASKS:
        names = labellers_of(task)
        y = np.array([posterior[task].get(tuple(r[n] for n in names), 0.5) for r in rows])
        # without a label, what tells something is a posterior on the other side than the prior
        sure = np.array([1.0 if r[GIVEN[task]] else UNLABELLED_WEIGHT * ((p < 0.5) != (prior[task] < 0.5)) for r, p in zip(rows, y)]) if labels is not None else None
        w, b = train_scorer([np.frombuffer(r[f"x_{task}"], np.int32) for r in rows], y, task == "clean", sure) if len(rows) else (np.zeros(1 << BITS), 1.0)
        weights.append(w)
        bias.append(b)
    return Model(np.array(weights, np.float32), np.array(bias), prior, {t: dict(zip(labellers_of(t), a.tolist())) for t, a in accuracy.items()})


def _chances(model: tuple[np.ndarray, np.ndarray], reader: Reader, text: str | None) -> list[float]:
    w, b = model
    _, *x = reader.read(text or "")
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[t][i].sum() + b[t]))))) for t, i in enumerate(x)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, quality and clean (chances), kept."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # two times 2**BITS numbers

    def make():
        reader, weights = Reader(), shared.value

        def f(key, text):
            q, c = _chances(weights, reader, text)
            return [(key, q, c, q >= 0.5 and c >= 0.5)]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(spread(docs.select(F.col(id_col), F.col(text_col))), make, f"{id_col} {kind}, quality double, clean double, kept boolean")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the scorers keep, with all their columns."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        reader, weights = Reader(), shared.value
        for batch in batches:
            yield batch.filter(pa.array([min(_chances(weights, reader, t.as_py())) >= 0.5 for t in batch.column(at)], pa.bool_()))
        del reader
        release()

    return spread(docs).mapInArrow(run, docs.schema)
