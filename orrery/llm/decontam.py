"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are lower-cased runs of letters and digits. Each mask hashes the words at its marked positions inside a window,
so that a changed word at an unmarked position does no harm. All windows of the benchmark are indexed; documents
look up the windows at every word of the whole text. A hit fixes how the item lies along the document; of the hits that
follow each other in one such position only the first is verified. Word equality over the whole item then yields the
best-scoring stretch (a match counts 1, a substitution -SUBSTITUTION_COST), which is reported if long and equal enough.

Items of fewer than MIN_WORDS words are never reported. Items with equal words count as one, under the smallest item_id.
Null or empty texts overlap with nothing; texts of any length are taken whole; repeated documents give the same rows once; an empty
table gives an empty result; extra columns are ignored. Of equally good stretches of a document and item the first stands.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialise, spread, without_ids

MASKS = ("110101101", "101100111", "111010011", "110011011")
#: A reported overlap has at least so many equal words, and this share of its words equal.
MIN_WORDS = 10
MIN_SHARE = 0.8
SUBSTITUTION_COST = 3
#: Windows of the benchmark in one broadcast, at most (about 32 bytes each); a larger benchmark goes in several passes.
BLOCK_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(rows: DataFrame, text: str, p: str) -> DataFrame:
    """The rows, once for each mask and window of their words: hash _h, number of the mask _m and first word of the window (column p)."""
    keep, span = rows.columns, len(MASKS[0])
    hashed = rows.withColumn("_wh", F.transform(text, lambda x: F.xxhash64(x)))
    last = F.size("_wh") - span
    # exploded before the masks are applied: outside a lambda function their hashes are compiled
    at = hashed.select(*keep, "_wh", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias(p))
    hashes = [F.xxhash64(F.lit(m), *[F.get("_wh", F.col(p) + k) for k, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(MASKS)]
    return at.select(*keep, p, F.posexplode(F.array(*hashes)).alias("_m", "_h"))


def _first(doc: Column, item: Column, p: Column, q: Column, m: Column) -> Column:
    """Whether no mask matches one word before the hit (p, q) of mask m, and none of the masks before m at it."""

    def match(mask: str, by: int) -> Column:
        equal = [F.get(doc, p + (k - by)) == F.get(item, q + (k - by)) for k, c in enumerate(mask) if c == "1"]
        return F.coalesce(functools.reduce(lambda x, y: x & y, equal), F.lit(False))

    again = [match(mask, 1) for mask in MASKS] + [(m > n) & match(mask, 0) for n, mask in enumerate(MASKS[:-1])]
    return ~functools.reduce(lambda x, y: x | y, again)


def _stretch(doc: Column, item: Column, shift: Column) -> Column:
    """The best-scoring stretch of the item laid along the document at `shift`: struct(score, start and end in the item, matched)."""
    equal = F.transform(item, lambda x, j: F.coalesce(F.when(shift + j >= 0, F.get(doc, shift + j)) == x, F.lit(False)))
    zero = F.lit(0)
    state = F.struct(zero.alias("j"), zero.alias("run"), zero.alias("from"), zero.alias("hits"), zero.alias("score"), zero.alias("start"), zero.alias("end"), zero.alias("matched"))

    def step(a: Column, e: Column) -> Column:
        fresh = a["run"] <= 0
        gain = F.when(e, F.lit(1)).otherwise(F.lit(-SUBSTITUTION_COST))
        run = F.when(fresh, gain).otherwise(a["run"] + gain)
        begin = F.when(fresh, a["j"]).otherwise(a["from"])
        hits = F.when(fresh, zero).otherwise(a["hits"]) + e.cast("int")
        better = run > a["score"]
        pick = lambda new, old: F.when(better, new).otherwise(a[old])
        return F.struct(
            (a["j"] + 1).alias("j"), run.alias("run"), begin.alias("from"), hits.alias("hits"),
            pick(run, "score").alias("score"), pick(begin, "start").alias("start"), pick(a["j"] + 1, "end").alias("end"), pick(hits, "matched").alias("matched"),
        )

    return F.aggregate(equal, state, step)


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct benchmark items long enough to be reported: _item (smallest id), _words."""
    rows = benchmark.select(F.col(id_col).alias("_item"), words(F.col(text_col)).alias("_words")).where(F.col("_item").isNotNull())
    return rows.where(F.size("_words") >= MIN_WORDS).groupBy("_words").agg(F.min("_item").alias("_item"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that overlap: id, item_id, start (word of the document), n_words, n_matched.

    Only benchmark windows are broadcast, at most BLOCK_WINDOWS at once; no document leaves the task that reads it.
    """
    known = items(benchmark)
    n_windows = known.select(F.sum(F.greatest(F.size("_words") - len(MASKS[0]) + 1, F.lit(0))) * len(MASKS)).first()[0] or 0
    blocks = max(1, math.ceil(n_windows / BLOCK_WINDOWS))
    texts = spread(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_t"))).select("_doc", words(F.col("_t")).alias("_dw")).where(F.col("_doc").isNotNull())
    seeds = _seeds(texts, "_dw", "_p")
    out = None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b) if blocks > 1 else known
        index = _seeds(part, "_words", "_q").select("_item", "_q", "_h")
        hits = seeds.join(F.broadcast(index), "_h").join(F.broadcast(part), "_item")
        first = hits.where(_first(F.col("_dw"), F.col("_words"), F.col("_p"), F.col("_q"), F.col("_m")))
        laid = first.select("_doc", "_item", (F.col("_p") - F.col("_q")).alias("_shift"), "_dw", "_words").select("_doc", "_item", "_shift", _stretch(F.col("_dw"), F.col("_words"), F.col("_shift")).alias("_x"))
        found = laid.where((F.col("_x.matched") >= MIN_WORDS) & (F.col("_x.matched") >= MIN_SHARE * (F.col("_x.end") - F.col("_x.start"))))
        best = found.groupBy("_doc", "_item").agg(F.max(F.struct(F.col("_x.score").alias("score"), (-(F.col("_shift") + F.col("_x.start"))).alias("at"), (F.col("_x.end") - F.col("_x.start")).alias("n"), F.col("_x.matched").alias("m"))).alias("_b"))
        out = best if out is None else out.unionByName(best)
    return out.select(F.col("_doc").alias(id_col), F.col("_item").alias("item_id"), (-F.col("_b.at")).cast("long").alias("start"), F.col("_b.n").cast("long").alias("n_words"), F.col("_b.m").cast("long").alias("n_matched"))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that overlap with no benchmark item, with all their columns; rows without an id stay."""
    bad = materialise(overlaps(docs, benchmark, id_col, text_col).select(id_col).distinct(), "bad", narrow=True)
    return without_ids(docs, bad, id_col)
