"""Source lists, hold-out selection, and the split of embeddings by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def source_id_lists(publications: DataFrame) -> DataFrame:
    """source_id, ids (sorted, distinct)."""
    return publications.where("id is not null and source_id is not null").groupBy("source_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def list_counts(lists: DataFrame) -> DataFrame:
    """How many sources there are, with 5 and with 10 publications or more, and how many publications."""
    n = F.size("ids")
    return lists.agg(F.count("*").alias("sources"), F.count_if(n >= 5).alias("with_5"), F.count_if(n >= 10).alias("with_10"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("items"))


def holdout_size(n: Column) -> Column:
    """None of fewer than 5, one of 5 to 10, a tenth (halves up) of more."""
    return F.when(n < 5, 0).when(n <= 10, 1).otherwise(F.floor((n + 5) / 10)).cast("long")


def draw_key(id_: Column, seed: int) -> Column:
    """A fixed pseudo-random number for each id, (id * 2654435761 + seed) mod 2**32; the same wherever and however often it is computed.

    In two halves of the factor, so that no id is too large for a product of 64 bits.
    """
    low = F.pmod(id_, F.lit(1 << 32))
    high, rest = divmod(2654435761, 1 << 16)
    return F.pmod(F.pmod(low * high, F.lit(1 << 16)) * (1 << 16) + low * rest + F.lit(seed % (1 << 32)), F.lit(1 << 32))


def holdout_ids(publications: DataFrame, seed: int = 42) -> DataFrame:
    """source_id, id of the held-out publications."""
    rows = publications.where("id is not null and source_id is not null").select("source_id", "id").distinct()
    sizes = rows.groupBy("source_id").agg(holdout_size(F.count("*")).alias("take"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy(draw_key(F.col("id"), seed), "id")))
    # the size rule takes at most a fifth, so rows beyond it are dropped as soon as they are ranked
    return ranked.join(sizes, "source_id").where(F.col("_r") <= F.col("take")).select("source_id", "id")


def routing_counts(publications: DataFrame, source_type: str = "source_type") -> DataFrame:
    """How many rows there are, and how many of each kind or of no kind known."""
    from orrery.functions.texts import source_kind

    kind = source_kind(F.col(source_type))
    return publications.agg(F.count("*").alias("read"), F.count_if(kind == "journal").alias("journal"), F.count_if(kind == "conference").alias("conference"), F.count_if(kind.isNull()).alias("skipped"))


def year_counts(rows: DataFrame, year: str = "date_year") -> DataFrame:
    """bucket, written: rows of each year bucket (also of empty ones), and under null all that were read."""
    from orrery.functions import years as Y

    every = rows.sparkSession.range(Y.FIRST, Y.LAST + 1).select(F.col("id").cast("int").alias("bucket"))
    written = Y.assign_buckets(rows, year).groupBy("bucket").agg(F.count("*").alias("written"))
    return every.join(written, "bucket", "left").fillna(0).unionByName(rows.agg(F.lit(None).cast("int").alias("bucket"), F.count("*").alias("written")))


def split_by_ids(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an id in ids, all others). Rows without an id are among the others."""
    chosen = ids.select("id").distinct()
    return df.join(chosen, "id", "left_semi"), df.join(chosen, "id", "left_anti")


def split_counts(df: DataFrame, ids: DataFrame) -> DataFrame:
    """What split_by_ids would move and keep, without writing anything."""
    marked = df.join(ids.select("id", F.lit(True).alias("_in")).distinct(), "id", "left")
    return marked.agg(F.count_if(F.col("_in").isNotNull()).alias("moved"), F.count_if(F.col("_in").isNull()).alias("kept"))


def slice_from_id(lines: DataFrame, id_: int, skip_first: bool = False) -> DataFrame:
    """Lines (pos, value) from the first one with this id on; lines that aren't JSON count if they hold the id as text."""
    parsed = F.try_parse_json("value")
    key = F.try_variant_get(parsed, "$.id", "bigint")
    hit = F.when(parsed.isNotNull(), key == id_).otherwise(F.contains("value", F.lit(f'"id": {id_}')) | F.contains("value", F.lit(f'"id":{id_}')))
    first = lines.where(hit).agg(F.min("pos").alias("p")).first()["p"]
    if first is None:
        raise LookupError(f"no line has id {id_}")
    return lines.where(F.col("pos") > first if skip_first else F.col("pos") >= first)
