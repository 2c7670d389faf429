"""MRR and hit rates of ranked sources against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources import jsonl

KS = (1, 3, 5, 10, 20)
TASKS = ("journal", "conference")
#: <folder>/<task>/<version>_results/../<model>.jsonl
TREE = r"/(journal|conference)/(v[0-9]+)_results/(?:.*/)?([^/]+)\.jsonl(?:\.gz)?$"


def predictions_of_tree(spark: SparkSession, folder: str) -> DataFrame:
    """task, version, model, id, results of all prediction files of a tree: <task>/<version>_results/../<model>.jsonl."""
    rows = jsonl.read(spark, folder, jsonl.RESULTS, ("id",), glob="*.jsonl*", recursive=True)
    part = lambda i: F.regexp_extract("file", TREE, i)
    return rows.where(F.regexp_like("file", F.lit(TREE))).select(part(1).alias("task"), part(2).alias("version"), F.concat_ws("/", part(1), part(2), part(3)).alias("model"), "id", "results")


def evaluate_tree(spark: SparkSession, folder: str, truths: dict[str, DataFrame], ks=KS) -> DataFrame:
    """Metrics of every model file of a tree against the truth of its task; model is task/version/name."""
    rows = predictions_of_tree(spark, folder)
    if missing := {r["task"] for r in rows.select("task").distinct().collect()} - set(truths):  # two tasks at most
        raise ValueError(f"no truth for {', '.join(sorted(missing))}")
    out = None
    for task in TASKS:
        if task in truths:
            one = evaluate(rows.where(F.col("task") == task).select("model", "id", "results"), truths[task], ks)
            out = one if out is None else out.unionByName(one)
    return out


def truth_of(publications: DataFrame) -> DataFrame:
    """id, source_id; of rows that repeat an id the last (by pos, if there) counts."""
    order = F.col("pos") if "pos" in publications.columns else F.lit(0)
    return publications.where("id is not null and source_id is not null").groupBy("id").agg(F.max_by("source_id", order).alias("truth"))


def hits(predictions: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """Predictions (model, id, results) with a known truth: model and the rank of the first hit (0: none).

    The list is cut before entries that aren't ids are dropped, so that later ones move up only within the cut.
    """
    n = max(*ks, 10)
    found = predictions.join(truth, "id").withColumn("_r", F.filter(F.slice("results", 1, n), lambda x: x.isNotNull()))
    return found.select("model", F.coalesce(F.array_position("_r", F.col("truth")), F.lit(0)).alias("rank"))


def metrics(ranks: DataFrame, ks=KS) -> DataFrame:
    """model, MRR@5, MRR@10, HR@k, HR@k_%, N_evaluated. All are sums, so they also run over a stream in update mode."""
    r = F.col("rank")
    mrr = [F.avg(F.when((r > 0) & (r <= n), 1.0 / r).otherwise(0.0)).alias(f"MRR@{n}") for n in (5, 10)]
    hr = [F.count_if((r > 0) & (r <= k)).alias(f"HR@{k}") for k in ks]
    share = [F.avg(((r > 0) & (r <= k)).cast("double")).alias(f"HR@{k}_%") for k in ks]
    return ranks.groupBy("model").agg(*mrr, *hr, *share, F.count("*").alias("N_evaluated"))


def evaluate(predictions: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """A row for each model among the predictions, zeros for one that nothing could be evaluated of."""
    out = metrics(hits(predictions, truth, ks), ks)
    every = predictions.select("model").distinct().join(out, "model", "left")
    return every.fillna(0)
