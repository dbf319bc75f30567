"""Named queries with their SQL twins, and the roles that driver tables play.

The driver tables hold no traces, so ``events`` stand in for them: an event is
a trace, its type the set, its user modulo 12 the face, its value the observed
length and its id modulo 3 the censoring class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name; ``{t}`` in the SQL stands for
    the trace relation."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = plain_hypot(sql.replace("{t}", TRACES).replace("{n}", NORMALS).replace("{d}", DISCS))
        return f

    return register


def plain_hypot(sql: str) -> str:
    """``hypot(a, b)`` as a square root, for SQL without the function."""
    while (at := sql.rfind("hypot(")) >= 0:
        depth, k, comma = 1, at + 6, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                comma = k
            k += 1
        a, b = sql[at + 6 : comma], sql[comma + 1 : k - 1]
        sql = f"{sql[:at]}sqrt(({a})*({a})+({b})*({b})){sql[k:]}"
    return sql


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded as the SQL rounds: a number times a power of ten, to a whole
    number, and back.  Spark's own goes by the decimal digits, which differs
    where a number lies next to the middle of two."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 10.0**digits) / 10.0**digits


def r6(x: Column, name: str) -> Column:
    """Rounded, so that the order of a float sum doesn't show."""
    return (rounded(x, 6) + F.lit(0.0)).alias(name)


TRACES = (
    "(SELECT event_id AS trace_id, event_type AS set_id, (user_id % 12)::INT AS face_id,"
    " (user_id % 12) * 3.0::DOUBLE AS face_x, value AS len, (event_id % 3)::INT AS cls FROM events)"
)
NORMALS = (
    "(SELECT vec_id, label, embedding[1]::DOUBLE / sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) AS nx,"
    " embedding[2]::DOUBLE / sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) AS ny,"
    " embedding[3]::DOUBLE / sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) AS nz FROM embeddings)"
)
DISCS = (
    "(SELECT p_partkey AS disc_id, p_brand AS set_id, p_size / 4.0::DOUBLE AS radius, (p_partkey % 40)::DOUBLE AS cx,"
    " (p_partkey * 7 % 23)::DOUBLE - 11 AS cy, (p_partkey * 5 % 19)::DOUBLE - 9 AS cz,"
    " cos(p_partkey) AS nx, sin(p_partkey) * cos(p_partkey * 0.5::DOUBLE) AS ny, sin(p_partkey) * sin(p_partkey * 0.5::DOUBLE) AS nz FROM part)"
)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = F.col("user_id") % 12
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("trace_id"),
        F.col("event_type").alias("set_id"),
        face.cast("int").alias("face_id"),
        (face * 3.0).alias("face_x"),
        F.col("value").alias("len"),
        (F.col("event_id") % 3).cast("int").alias("cls"),
    )


def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, n``: the first three coordinates as a unit axis."""
    parts = read(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    size = F.sqrt(F.pow("x", F.lit(2.0)) + F.pow("y", F.lit(2.0)) + F.pow("z", F.lit(2.0)))
    return parts.select("vec_id", "label", F.struct(*[(F.col(c) / size).alias(c) for c in "xyz"]).alias("n"))


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``disc_id, set_id, radius, c, n``."""
    k = F.col("p_partkey")
    center = F.struct((k % 40).cast("double").alias("x"), ((k * 7 % 23).cast("double") - 11).alias("y"), ((k * 5 % 19).cast("double") - 9).alias("z"))
    normal = F.struct(vec.cosine(k).alias("x"), (vec.sine(k) * vec.cosine(k * 0.5)).alias("y"), (vec.sine(k) * vec.sine(k * 0.5)).alias("z"))
    return read(spark, sf_dir, "part").select(k.alias("disc_id"), F.col("p_brand").alias("set_id"), (F.col("p_size") / 4.0).alias("radius"), center.alias("c"), normal.alias("n"))
