"""Runs to id lists, ids to texts, and result lists with texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import texts as T


def runs_to_id_results(runs: DataFrame) -> DataFrame:
    """id, results: the source ids of each run in order, each once. A null top is an empty one; a run with an entry without id is dropped."""
    top = F.coalesce(F.col("top"), F.array().cast(runs.schema["top"].dataType))
    rows = runs.select(F.col("query_id").alias("id"), F.transform(top, lambda t: t["source_id"]).alias("results")).where("id is not null")
    return rows.where(~F.exists("results", lambda s: s.isNull())).withColumn("results", F.array_distinct("results"))


def unique_ids(*results: DataFrame) -> DataFrame:
    """Distinct ids of the queries and of all they found."""
    parts = [x for r in results for x in (r.select("id"), r.select(F.explode("results").alias("id")))]
    return reduce(DataFrame.union, parts).where("id is not null").distinct()


def fetch_texts(ids: DataFrame, publications: DataFrame) -> DataFrame:
    """id, explanation: abstract or else name of the wanted publications that have one."""
    rows = publications.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.select("id", T.text_or_title(F.col("abstract"), F.col("name")).alias("explanation")).where("explanation is not null")


def attach_texts(results: DataFrame, texts: DataFrame, placeholder: str = "") -> DataFrame:
    """query_id, explanation, results (id, explanation), in order. Of texts that repeat an id the last (by pos, if there) counts; missing ones are empty."""
    order = F.col("pos") if "pos" in texts.columns else F.lit(0)
    # a text is shuffled once, to its id
    known = texts.groupBy("id").agg(F.max_by("explanation", order).alias("explanation")).select(F.col("id").alias("_id"), T.without_placeholder(F.col("explanation"), placeholder).alias("_t"))
    keyed = results.select(F.monotonically_increasing_id().alias("_k"), "id", "results")
    # the query itself takes part as rank -1
    wanted = keyed.select("_k", F.col("id").alias("query"), F.posexplode(F.concat(F.array("id"), F.filter(F.coalesce("results", F.array().cast("array<bigint>")), lambda x: x.isNotNull()))).alias("at", "_id"))
    found = wanted.join(known, "_id", "left").withColumn("_t", F.coalesce("_t", F.lit("")))
    packed = found.groupBy("_k", "query").agg(F.array_sort(F.collect_list(F.struct("at", F.col("_id").alias("id"), F.col("_t").alias("explanation")))).alias("_r"))
    rest = F.transform(F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0))), lambda r: F.struct(r["id"].alias("id"), r["explanation"].alias("explanation")))
    return packed.select(F.col("query").cast("string").alias("query_id"), F.col("_r")[0]["explanation"].alias("explanation"), rest.alias("results"))
