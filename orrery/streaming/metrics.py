"""Metrics over a stream of predictions: the truth is static, the sums are kept by model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.evaluate import KS, hits, metrics


def running_metrics(predictions: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """Metrics by model of a streaming frame (model, id, results); for output modes update and complete."""
    return metrics(hits(predictions, truth, ks), ks)


def start(metrics_frame: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the metrics in a table of that name, in memory."""
    return metrics_frame.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
