"""Publication rankings folded into source rankings. The formulas are those of the literature, or our own where none is fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.rank import top

RRF_K = 60


def ranked_sources(results: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, source_id, rank, n (length of the list), from id, results (ranked publications) and their sources (id, truth)."""
    rows = results.select(F.col("id").alias("qid"), F.size("results").alias("n"), F.posexplode("results").alias("_p", "_pub"))
    return rows.join(truth.select(F.col("id").alias("_pub"), F.col("truth").alias("source_id")), "_pub").select("qid", "source_id", (F.col("_p") + 1).alias("rank"), "n")


def _slices(edges=(10, 50, 100), weights=(1.0, 0.5, 0.25), bonus: float = 0.1, early: int = 3) -> Column:
    """Weighted log counts of hits in slices of the list, and a bonus for an early first hit."""
    total, low = F.lit(0.0), 0
    for edge, w in zip(edges, weights):
        total = total + w * F.log1p(F.count_if((F.col("rank") > low) & (F.col("rank") <= edge)).cast("double"))
        low = edge
    return total + F.when(F.min("rank") <= early, F.lit(bonus)).otherwise(F.lit(0.0))


def formula(name: str, **parameters) -> Column:
    r = F.col("rank")
    known = {
        "rrf": lambda: F.sum(1.0 / (RRF_K + r)),
        "rrf_minrank": lambda: 1.0 / (RRF_K + F.min(r)),
        "dcg": lambda: F.sum(1.0 / F.log2(r + 1.0)),
        "borda": lambda: F.sum(F.col("n") - r + 1).cast("double"),
        "noisyor": lambda: 1.0 - F.exp(F.sum(F.log(1.0 - 1.0 / (r + 1.0)))),
        "firsthit": lambda: -F.min(r).cast("double"),
        "slice": lambda: _slices(**parameters),
    }
    if name not in known:
        raise ValueError(f"unknown fusion {name!r}; known: {', '.join(known)}")
    return known[name]()


def fuse(ranked: DataFrame, name: str, k: int = 50, **parameters) -> DataFrame:
    """qid, source_id, score, rank."""
    scored = ranked.groupBy("qid", "source_id").agg(formula(name, **parameters).alias("score"))
    # scores that are equal but for rounding tie, and the smaller source comes first
    return top(scored.withColumn("score", F.round("score", 9)), ["qid"], k, "source_id")


def rescore(ranked: DataFrame, scores: DataFrame, k: int = 50) -> DataFrame:
    """Re-rank by new scores (qid, source_id, new_score), then by old rank. Entries without a new score come last."""
    w = Window.partitionBy("qid").orderBy(F.col("new_score").desc_nulls_last(), F.col("rank"), F.col("source_id"))
    return ranked.join(scores, ["qid", "source_id"], "left").withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)
