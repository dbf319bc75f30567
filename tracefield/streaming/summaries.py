"""Summaries of traces as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(traces: DataFrame, late: str) -> DataFrame:
    """With a watermark, which needs a time with a zone."""
    return traces.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_summary(traces: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and length per set and window of event time, on a stream or a
    table; rows later than ``late`` are not counted by a stream."""
    kind = traces.schema["ts"].dataType
    return (
        _timed(traces, late)
        .groupBy(F.window("ts", every).alias("w"), "set_id")
        .agg(F.count("*").alias("n"), F.sum("len").alias("sum_len"))
        .select(F.col("w.start").cast(kind).alias("start"), "set_id", "n", "sum_len")
    )


def first_seen(traces: DataFrame, key: str = "trace_id", late: str = "1 hour") -> DataFrame:
    """Each key once, however often a stream delivers it."""
    return _timed(traces, late).dropDuplicatesWithinWatermark([key])
