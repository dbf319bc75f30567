"""Queries of the streaming and sampling operators on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from ..streaming import summaries
from .registry import query, r6, read


@query("SELECT date_trunc('hour', ts) AS start, event_type AS set_id, count(*) AS n, round(sum(value), 4) AS sum_len FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("ts", F.col("event_type").alias("set_id"), F.col("value").alias("len"))
    return summaries.windowed_summary(rows).withColumn("sum_len", F.round("sum_len", 4) + F.lit(0.0))


@query("""
WITH u AS (SELECT c_custkey AS k, (c_custkey * 7919 % 10007 + 0.5) / 10007.0::DOUBLE AS u FROM customer)
SELECT k, round((0.5::DOUBLE ** -1.6::DOUBLE + u * (50.0::DOUBLE ** -1.6::DOUBLE - 0.5::DOUBLE ** -1.6::DOUBLE)) ** (-1 / 1.6::DOUBLE), 5) AS powerlaw,
  round(-2.0::DOUBLE * ln(exp(-0.25::DOUBLE) - u * (exp(-0.25::DOUBLE) - exp(-25.0::DOUBLE))), 6) AS exponential FROM u
""")
def inverse_radii(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    u = (k * 7919 % 10007 + F.lit(0.5)) / 10007.0
    return read(spark, d, "customer").select(
        k.alias("k"), F.round(sampling.powerlaw_radius(u, 2.6, 0.5, 50.0), 5).alias("powerlaw"), r6(sampling.exponential_radius(u, 2.0, 0.5, 50.0), "exponential")
    )


@query()
def generated_discs(spark: SparkSession, d: str) -> DataFrame:
    """As many random discs as there are parts, the same in every run."""
    n = read(spark, d, "part").count()
    return sampling.discs(spark, n, 101, (100.0, 60.0, 60.0), 2.85, 0.5, 250.0, 20.0, 120.0, 35.0)


@query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Mean length per set with a bootstrap interval."""
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("set_id"), F.col("value").alias("len"))
    draws = sampling.bootstrap(rows, 100, 7, "event_id").groupBy("set_id", "draw").agg((F.sum(F.col("len") * F.col("weight")) / F.sum("weight")).alias("m"))
    return draws.groupBy("set_id").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
