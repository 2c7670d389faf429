"""The engine's relations, derived from the test tables; the SQL fragments derive the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of three lengths, so that raw and normalised modes differ; years inside and outside the buckets."""
    e = table(spark, sf_dir, "embeddings")
    scale = (1 + F.col("vec_id") % 3).cast("double")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("long").alias("source_id"),
        (2017 + F.col("vec_id") % 9).cast("int").alias("date_year"),
        F.col("vec_id").alias("pos"),
        F.transform("embedding", lambda x: x.cast("double") * scale).alias("embedding"),
    )


def queries(spark, sf_dir):
    """The publications that are searched for, among all of them: those whose id is divisible by 20."""
    return publications(spark, sf_dir).where("id % 20 = 0")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small sources: customers with their orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("source_id"), (F.year("o_orderdate") + 22).alias("date_year"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts, some blank, and names, some missing."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.col("text")).alias("abstract"),
        F.when(F.col("doc_id") % 21 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("name"),
    )


PUBS = """pubs as (select vec_id::bigint id, label::bigint source_id, (2017 + vec_id % 9)::int y, vec_id::bigint pos, list_transform(embedding, lambda v: v::double * (1 + vec_id % 3)) e from embeddings),
norms as (select *, sqrt(list_inner_product(e, e)) n from pubs),
units as (select id, source_id, y, pos, list_transform(e, lambda v: v / n) u from norms)"""
RAW = f"{PUBS}, rawx as (select source_id, unnest(e) x, generate_subscripts(e, 1) - 1 i from pubs)"
UNIT = f"{PUBS}, ux as (select id, source_id, y, pos, unnest(u) x, generate_subscripts(u, 1) - 1 i from units)"
BUCKETED = "buckets as (select unnest([2019, 2020, 2021, 2022, 2023]) bucket), windows as (select t.*, b.bucket from {rows} t join buckets b on t.y between greatest(2019, b.bucket - 3) and b.bucket)"
META = "meta as (select o_orderkey::bigint id, o_custkey::bigint source_id, (year(o_orderdate) + 22)::int y from orders)"
TEXTS = "pubtexts as (select doc_id id, case when doc_id % 7 = 0 then '  ' else text end abstract, case when doc_id % 21 = 0 then null else source end name from documents)"


def renormalised(cte: str, keys: str = "source_id") -> str:
    return f"select {keys}, i, round(x / sqrt(sum(x * x) over (partition by {keys})), 6) + 0.0 x from {cte}"
