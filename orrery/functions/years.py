"""Years, year buckets and the trailing windows of publications that each bucket draws on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, LAST, SPAN = 2019, 2023, 4


def bucket(year: Column) -> Column:
    """The bucket of a query: its year, clamped to the first and last one."""
    return F.greatest(F.lit(FIRST), F.least(F.lit(LAST), year)).cast("int")


def year_of_text(line: Column) -> Column:
    """The first four digits after a date_year key in a raw JSON line; null without one."""
    found = F.regexp_extract(line, r'"date_year"\s*:\s*"?(\d{4})"?', 1)
    return F.when(found != "", found.cast("int"))


def assign_buckets(df: DataFrame, year: str = "date_year") -> DataFrame:
    """A row for each bucket whose window of SPAN years (clipped at FIRST) holds the row's year; years outside have none.

    Written as an explode, so that what follows is an equi-join on the bucket.
    """
    y = F.col(year)
    return df.where(y.between(FIRST, LAST)).withColumn("bucket", F.explode(F.sequence(y.cast("int"), F.least(F.lit(LAST), y.cast("int") + SPAN - 1))))


def allowed_sources(publications: DataFrame, year: str = "date_year") -> DataFrame:
    """Distinct bucket, source_id."""
    return assign_buckets(publications.select(year, "source_id"), year).select("bucket", "source_id").distinct()


def expect_sources(year_sources: DataFrame) -> DataFrame:
    """Allowed sources; an error where no year bucket has any."""
    if year_sources.isEmpty():
        raise ValueError(f"no publications of the years {FIRST} to {LAST}")
    return year_sources
