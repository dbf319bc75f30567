"""Round trips: each query writes driver tables in a format of the library,
reads them back, and returns what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import graph
from ..sources import traces as source
from .graph_queries import VOXELS, _voxels
from .join_queries import segments
from .registry import discs, query, r6, read, traces


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{graph.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT face_id, cls, count(*) AS n, round(sum(len), 4) AS total, count(*) FILTER (trace_id % 5 = 0) AS n_unknown FROM {t} t GROUP BY ALL")
def trace_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Traces through CSV; text that is no number comes back as null."""
    path, k = _folder(spark, "csv"), F.col("trace_id")
    rows = segments(spark, d).select(
        F.length("set_id").alias("set_id"), "face_id", F.col("len").alias("observed_length_m"), F.col("cls").alias("censoring_class"),
        F.col("y0").alias("p0_y"), F.col("z0").alias("p0_z"), F.col("y1").alias("p1_y"), F.col("z1").alias("p1_z"), F.when(k % 5 == 0, "nan").otherwise("1.5").alias("radius_m"),
    )
    source.write_csv(rows, path, [*source.TRACE_FIELDS, "radius_m"])
    found = source.read_traces_csv(spark, path).groupBy("face_id", F.col("censoring_class").alias("cls"))
    return found.agg(F.count("*").alias("n"), F.round(F.sum("observed_length_m"), 4).alias("total"), F.count_if(F.col("radius_m").isNull()).alias("n_unknown"))


@query("SELECT set_id, count(*) AS n, round(sum(len), 4) AS total FROM {t} t GROUP BY ALL")
def trace_store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Traces through the Parquet store, a folder per set, two columns read."""
    path = _folder(spark, "traces")
    source.write_traces(traces(spark, d), path)
    return source.read_traces(spark, path, ["set_id", "len"]).groupBy("set_id").agg(F.count("*").alias("n"), F.round(F.sum("len"), 4).alias("total"))


@query("SELECT set_id, count(*) AS n, round(max(radius), 6) AS largest FROM (SELECT * FROM {d} d WHERE radius >= 2 ORDER BY radius DESC, disc_id LIMIT 50) x GROUP BY set_id")
def domain_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The largest discs of a domain document written and read."""
    path, k = _folder(spark, "domain"), F.col("disc_id")
    axis = lambda c: F.array(f"{c}.x", f"{c}.y", f"{c}.z")
    number = F.regexp_extract("set_id", "[0-9]+", 0).cast("int")
    rows = discs(spark, d).filter("radius >= 2").select(
        k.alias("id"), number.alias("set_id"), F.col("set_id").alias("label"), axis("c").alias("center_xyz_m"), axis("n").alias("normal_xyz"), F.col("radius").alias("radius_m"),
        F.lit("none").alias("reconstruction"), F.lit("lower").alias("radius_status"),
    )
    source.write_domain(rows, path, F.struct(F.lit(1).alias("seed")))
    found = source.read_domain(spark, path, 50)
    return found.groupBy(F.col("label").alias("set_id")).agg(F.count("*").alias("n"), r6(F.max("radius_m"), "largest"))


@query(f"SELECT run, count(*) AS n, sum(ix) AS sum_ix FROM {VOXELS} v GROUP BY run")
def runs_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Voxels of all runs, half of them appended later."""
    path, v = _folder(spark, "runs"), _voxels(spark, d)
    source.write_runs(v.filter("run % 2 = 0"), path)
    source.write_runs(v.join(source.missing_keys(v.select("run").distinct(), path, ["run"]), "run"), path, "append")
    return source.read_runs(spark, path).groupBy(F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"), F.sum("ix").alias("sum_ix"))


@query("SELECT s_nationkey AS nation, s_suppkey AS id, round(s_acctbal, 2) AS balance, s_suppkey * 2 AS twice FROM supplier")
def aligned_files(spark: SparkSession, d: str) -> DataFrame:
    """Two files per folder, row by row, with a key that has to agree."""
    left, right = _folder(spark, "left"), _folder(spark, "right")
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")).coalesce(1).sortWithinPartitions("nation", "id")
    rows.withColumn("face", F.col("nation")).write.partitionBy("face").csv(left, header=True)
    rows.select("id", (F.col("id") * 2).alias("twice"), F.col("nation").alias("face")).write.partitionBy("face").csv(right, header=True)
    found = source.read_aligned(spark, left, right, "id")
    return found.select(F.col("nation").cast("int").alias("nation"), F.col("id").cast("long").alias("id"), F.col("balance").cast("double").alias("balance"), F.col("twice").cast("long").alias("twice"))


@query("SELECT n_regionkey AS mesh, count(*) AS n, round(sum(sqrt(n_nationkey + 1.0)), 6) AS sum_x FROM nation GROUP BY 1")
def mesh_tables(spark: SparkSession, d: str) -> DataFrame:
    """A mesh from its vertex and triangle tables: a triangle per nation with
    corners of its own."""
    v, t, k = _folder(spark, "vertices"), _folder(spark, "triangles"), F.col("n_nationkey")
    rows = read(spark, d, "nation").select(F.col("n_regionkey").alias("mesh"), k)
    corner = F.explode(F.array(k * 3, k * 3 + 1, k * 3 + 2)).alias("vertex")
    rows.select("mesh", "n_nationkey", corner).select("mesh", "vertex", F.sqrt(k + 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).write.parquet(v)
    rows.select("mesh", k.alias("triangle"), (k * 3).alias("a"), (k * 3 + 1).alias("b"), (k * 3 + 2).alias("c")).write.parquet(t)
    return source.read_mesh(spark, v, t).groupBy("mesh").agg(F.count("*").alias("n"), r6(F.sum("a_at.x"), "sum_x"))


@query("SELECT set_id, count(*) AS n_faces, sum(n) AS n FROM (SELECT set_id, face_id, count(*) AS n FROM {t} t WHERE face_x IN (SELECT DISTINCT face_x FROM {t} t) GROUP BY ALL) x GROUP BY set_id")
def face_position_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = traces(spark, d)
    kept = rows.join(source.face_positions(rows), "face_x", "left_semi")
    return kept.groupBy("set_id", "face_id").agg(F.count("*").alias("n")).groupBy("set_id").agg(F.count("*").alias("n_faces"), F.sum("n").alias("n"))


@query("SELECT face_id, count(*) AS n, min(trace_id) AS first FROM {t} t GROUP BY face_id")
def observed_lists(spark: SparkSession, d: str) -> DataFrame:
    lists, _ = source.observed_by_face(traces(spark, d))
    return lists.select("face_id", F.size("traces").cast("long").alias("n"), F.element_at("traces", 1).alias("first"))


@query("SELECT i AS ring, 6.0::DOUBLE AS area FROM range(2) x(i)")
def ring_orientation(spark: SparkSession, d: str) -> DataFrame:
    """Rings are turned counter-clockwise, whichever way they came."""
    rings = [[(0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 2.0)], [(0.0, 0.0), (0.0, 2.0), (3.0, 2.0), (3.0, 0.0)]]
    rows = [(k, float(geom.signed_area(geom.counter_clockwise(r)))) for k, r in enumerate(rings)]
    return spark.createDataFrame(rows, "ring long, area double")


RELINKED = """WITH k AS (SELECT trace_id, (trace_id % 300) AS component, y0, z0, y1, z1 FROM {s} s), a AS (SELECT component, count(*) AS n,
  sum(hypot(y1 - y0, z1 - z0) * cos(2 * atan2(z1 - z0, y1 - y0))) AS c, sum(hypot(y1 - y0, z1 - z0) * sin(2 * atan2(z1 - z0, y1 - y0))) AS s FROM k GROUP BY component),
e AS (SELECT component, y0 AS y, z0 AS z FROM k UNION ALL SELECT component, y1, z1 FROM k),
p AS (SELECT e.component, n, y * cos(atan2(s, c) / 2) + z * sin(atan2(s, c) / 2) AS w FROM e JOIN a USING (component))
SELECT component, any_value(n) AS n_fragments, round(max(w) - min(w), 4) AS reach FROM p GROUP BY component"""


def _relinked_sql() -> str:
    from .join_queries import SEGMENTS

    return RELINKED.replace("{s}", SEGMENTS)


@query(_relinked_sql())
def relinked_traces(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of a group as one trace, and how far it reaches along its
    main direction."""
    rows = segments(spark, d)
    groups = rows.select(F.col("trace_id").alias("id"), (F.col("trace_id") % 300).alias("component"))
    found = graph.relink(rows, groups)
    return found.select("component", "n_fragments", F.round("reach", 4).alias("reach"))
