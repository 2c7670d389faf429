"""Writers. A target is written anew by Spark's commit protocol; nothing reads and overwrites one path."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by sessions of one machine that set no spark.checkpoint.dir (tests, a laptop).
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Only a session of one machine may do without, and gets a local one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: the executors need a folder that they share")
    return LOCAL_FOLDER


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orrery/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitioned(df: DataFrame, path: str, by: str, format: str = "json", mode: str = "overwrite") -> None:
    """One folder a value: modes, models, kinds, buckets.."""
    df.write.mode(mode).partitionBy(by).format(format).save(path)


def year_lines(lines: DataFrame, path: str) -> None:
    """Raw lines (value) into the folder of each bucket whose window has their year."""
    from orrery.functions import years as Y

    rows = Y.assign_buckets(lines.withColumn("date_year", Y.year_of_text(F.col("value"))))
    rows.select("value", "bucket").write.mode("overwrite").partitionBy("bucket").text(path)


def json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def json_array(ids: DataFrame, path: str) -> None:
    """All ids as one JSON array: the format is one line, so the list must fit a task."""
    ids.agg(F.to_json(F.sort_array(F.collect_set("id"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def metrics_sheet(metrics: DataFrame, path: str) -> None:
    """A row for each model, as CSV with a header; .xlsx (sheet Metrics) where a spreadsheet library is installed."""
    if not path.endswith(".xlsx"):
        metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("writing .xlsx needs openpyxl; give a path without .xlsx for CSV") from e
    metrics.toPandas().to_excel(path, sheet_name="Metrics", index=False)  # one row a model
