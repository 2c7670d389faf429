"""Relational sources. Addresses and credentials come from options or the caller's environment, never from code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.texts import source_kind

FETCH_ROWS = 10_000


def scan(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A table, by a cursor of FETCH_ROWS rows; with a partition column and its bounds, by as many cursors as partitions."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", FETCH_ROWS)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def by_kind(rows: DataFrame) -> DataFrame:
    """id, source_id, date_year, kind of the rows of journals and conferences (id, publication_source_id, date_year, source_type)."""
    return rows.select("id", F.col("publication_source_id").alias("source_id"), F.col("date_year").cast("int").alias("date_year"), source_kind(F.col("source_type")).alias("kind")).where("kind is not null")
