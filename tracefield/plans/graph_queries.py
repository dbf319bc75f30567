"""Graph, voxel and diagnostic queries.

Voxels are order lines: tens of orders modulo 20 are the run; part, supplier
and order give the cell.  A triangle of the stand-in mesh spans three consecutive numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, voxels
from .registry import query, r6, read, traces

VOXELS = (
    "(SELECT DISTINCT l_orderkey // 30 % 20 AS run, (l_partkey % 40)::INT AS ix, (l_suppkey % 25)::INT AS iy, (l_orderkey % 30)::INT AS iz FROM lineitem)"
)
RUNS = 20


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    order = F.col("l_orderkey")
    return read(spark, d, "lineitem").select(
        (F.floor(order / 30) % 20).alias("run"), (F.col("l_partkey") % 40).cast("int").alias("ix"), (F.col("l_suppkey") % 25).cast("int").alias("iy"), (order % 30).cast("int").alias("iz")
    ).distinct()


def _cell_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", ((F.col("run") * 40 + F.col("ix")) * 25 + F.col("iy")) * 30 + F.col("iz"))


@query(f"SELECT ix, iy, iz, round(count(*) / {RUNS}.0::DOUBLE, 6) AS p FROM {VOXELS} v GROUP BY ALL")
def voxel_hit_probability(spark: SparkSession, d: str) -> DataFrame:
    return voxels.hit_probability(_voxels(spark, d), RUNS).select("ix", "iy", "iz", r6(F.col("p"), "p"))


@query(f"""
WITH p AS (SELECT ix, iy, iz, count(*) / {RUNS}.0::DOUBLE AS p FROM {VOXELS} v GROUP BY ALL)
SELECT ix, round(count(*) FILTER (p >= 0.25) * 0.001::DOUBLE, 6) AS v25, round(count(*) FILTER (p >= 0.5) * 0.001::DOUBLE, 6) AS v50 FROM p GROUP BY ix
""")
def volume_by_slab(spark: SparkSession, d: str) -> DataFrame:
    found = voxels.volume_above(voxels.hit_probability(_voxels(spark, d), RUNS), [0.25, 0.5], 0.1)
    return found.select("ix", r6(F.col("v0"), "v25"), r6(F.col("v1"), "v50"))


@query(f"""
WITH a AS (SELECT ix, iy, iz FROM {VOXELS} v WHERE run = 3), b AS (SELECT ix, iy, iz FROM {VOXELS} v WHERE run = 4)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS any_of,
  round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))::DOUBLE / (SELECT nullif(count(*), 0) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS jaccard
""")
def voxel_jaccard(spark: SparkSession, d: str) -> DataFrame:
    v = _voxels(spark, d)
    return voxels.jaccard(v.filter("run = 3"), v.filter("run = 4")).select("both", F.col("any").alias("any_of"), r6(F.col("jaccard"), "jaccard"))


COMPONENTS = f"""
WITH RECURSIVE v AS (SELECT *, ((run * 40 + ix) * 25 + iy) * 30 + iz AS id FROM {VOXELS} x),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.run = b.run AND abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1),
r AS (SELECT id, id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
g AS (SELECT id, min(c) AS component FROM r GROUP BY id)
"""


@query(COMPONENTS + "SELECT id, component FROM g")
def voxel_components(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as face-connected voxels, in every run."""
    v = _cell_ids(_voxels(spark, d))
    return graph.components(v, voxels.neighbour_edges(v, "run"))


@query(COMPONENTS + """SELECT component, count(*) AS n_voxels, round(count(*) * 0.001::DOUBLE, 6) AS volume, round(avg(ix + 0.5) * 0.1::DOUBLE, 6) AS cx,
  round(avg(iy + 0.5) * 0.1::DOUBLE, 6) AS cy, round(avg(iz + 0.5) * 0.1::DOUBLE, 6) AS cz FROM v JOIN g USING (id) GROUP BY component""")
def block_table(spark: SparkSession, d: str) -> DataFrame:
    v = _cell_ids(_voxels(spark, d))
    found = v.join(graph.components(v, voxels.neighbour_edges(v, "run")), "id")
    stats = voxels.block_stats(found, "component", 0.1)
    return stats.select("component", "n_voxels", *[r6(F.col(c), c) for c in ("volume", "cx", "cy", "cz")])


LABELLED = "(SELECT (l_suppkey % 5)::INT AS label, (l_partkey % 40)::INT AS ix, (l_partkey // 40 % 25)::INT AS iy, (l_orderkey % 5)::INT AS iz FROM lineitem)"
OWNED = f"(SELECT min(label) AS label, ix, iy, iz FROM {LABELLED} o GROUP BY ix, iy, iz)"


@query(f"""
SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, round(count(*) * 0.01::DOUBLE, 6) AS area FROM {OWNED} a JOIN {OWNED} b
ON abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1 AND (b.ix, b.iy, b.iz) > (a.ix, a.iy, a.iz) WHERE a.label != b.label GROUP BY ALL
""")
def block_interfaces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    rows = read(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 5).cast("int").alias("label"), (k % 40).cast("int").alias("ix"), (F.floor(k / 40) % 25).cast("int").alias("iy"), (F.col("l_orderkey") % 5).cast("int").alias("iz")
    ).groupBy("ix", "iy", "iz").agg(F.min("label").alias("label"))
    return voxels.interface_area(rows, 0.1).select("a", "b", r6(F.col("area"), "area"))


TRIANGLES = "(SELECT n_regionkey AS mesh, n_nationkey AS a, n_nationkey + 1 AS b, n_nationkey + 5 AS c FROM nation)"


@query(f"""
WITH e AS (SELECT mesh, least(a, b) AS u, greatest(a, b) AS v FROM {TRIANGLES} t UNION ALL SELECT mesh, least(b, c), greatest(b, c) FROM {TRIANGLES} t
  UNION ALL SELECT mesh, least(a, c), greatest(a, c) FROM {TRIANGLES} t)
SELECT mesh, u, v FROM e GROUP BY ALL HAVING count(*) = 1
""")
def mesh_boundary_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return graph.boundary_edges(read(spark, d, "nation").select(F.col("n_regionkey").alias("mesh"), k.alias("a"), (k + 1).alias("b"), (k + 5).alias("c")))


POINTS = "(SELECT c_custkey AS id, c_nationkey AS k, c_acctbal / 100 AS x, (c_custkey * 37 % 101)::DOUBLE AS y FROM customer)"
GROWTH = f"""
WITH RECURSIVE p AS (SELECT * FROM {POINTS} q),
n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.k = b.k AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 20),
c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 3),
e AS (SELECT n.a, n.b FROM n JOIN c x ON n.a = x.id JOIN c y ON n.b = y.id WHERE n.a != n.b),
r AS (SELECT id, id AS g FROM c UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id WHERE r.g < e.b)
SELECT id, min(g) AS component FROM r GROUP BY id
"""


@query(GROWTH)
def region_growing(spark: SparkSession, d: str) -> DataFrame:
    """Density-based clusters of core points."""
    points = read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") * 37 % 101).cast("double").alias("y")
    )
    return graph.components(*graph.core_points(points, ["k"], 20.0, 3))


@query("""
WITH r AS (SELECT user_id % 12 AS face, event_id, value > 5 AS flag, row_number() OVER (PARTITION BY user_id % 12 ORDER BY event_id) AS n FROM events),
f AS (SELECT *, n - row_number() OVER (PARTITION BY face ORDER BY event_id) AS run FROM r WHERE flag)
SELECT face, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM f GROUP BY face, run
""")
def flag_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select((F.col("user_id") % 12).alias("face"), "event_id", (F.col("value") > 5).alias("flag"))
    return graph.islands(rows, "face", "event_id", "flag")


@query("""
WITH f AS (SELECT DISTINCT face_id FROM {t} t), s AS (SELECT DISTINCT set_id FROM {t} t),
c AS (SELECT s.set_id, f.face_id, count(t.trace_id) AS n FROM s CROSS JOIN f LEFT JOIN {t} t ON t.set_id = s.set_id AND t.face_id = f.face_id AND t.len > 40 GROUP BY ALL)
SELECT set_id, round(stddev_pop(n) / nullif(avg(n), 0), 6) AS cv FROM c GROUP BY set_id
""")
def face_count_cv(spark: SparkSession, d: str) -> DataFrame:
    """Spread of counts per face, faces without a trace included; faces and
    sets are counted, so their grid is small."""
    t = traces(spark, d)
    counts = t.filter("len > 40").groupBy("set_id", "face_id").agg(F.count("*").alias("n"))
    faces = t.agg(F.collect_set("face_id").alias("faces"), F.collect_set("set_id").alias("sets"))
    grid = faces.select(F.explode("sets").alias("set_id"), "faces").select("set_id", F.explode("faces").alias("face_id"))
    full = grid.join(counts, ["set_id", "face_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.groupBy("set_id").agg(r6(F.try_divide(F.stddev_pop("n"), F.avg("n")), "cv"))


@query("""
SELECT p_brand AS set_id, count(*) AS n, round(avg(p_size), 6) AS mean_radius, round(count(*) / sum(ln(p_size / 0.5::DOUBLE)), 6) AS alpha,
  round(sum(pi() * p_size * p_size) / 1e6::DOUBLE, 6) AS p32, round(count(*) / 1e6::DOUBLE, 6) AS p30 FROM part GROUP BY p_brand
""")
def set_extraction(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("p_size").cast("double")
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("set_id")).agg(
        F.count("*").alias("n"), r6(F.avg(r), "mean_radius"), r6(F.try_divide(F.count("*"), F.sum(F.log(r / 0.5))), "alpha"),
        r6(F.sum(F.lit(3.141592653589793) * r * r) / 1e6, "p32"), r6(F.count("*") / 1e6, "p30"),
    )


@query("""
WITH g AS (SELECT 2.05::DOUBLE + i * 0.05::DOUBLE AS a FROM range(60) x(i)),
s AS (SELECT set_id, count(*) AS n, sum(ln(len)) AS l FROM {t} t WHERE len >= 1 AND len <= 100 GROUP BY set_id),
q AS (SELECT set_id, a, n * ln((1 - a) / (100.0::DOUBLE ** (1 - a) - 1)) - a * l AS ll FROM s, g)
SELECT set_id, round(arg_max(a, ll), 4) AS exponent, round(max(ll), 4) AS ll FROM q GROUP BY set_id
""")
def truncated_powerlaw_mle(spark: SparkSession, d: str) -> DataFrame:
    """Grid likelihood from two sums per set; the grid has a fixed size."""
    s = traces(spark, d).filter("len >= 1 AND len <= 100").groupBy("set_id").agg(F.count("*").alias("n"), F.sum(F.log("len")).alias("l"))
    q = s.withColumn("a", F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.lit(2.05) + k * F.lit(0.05))))
    a = F.col("a")
    ll = F.col("n") * F.log((1 - a) / (F.pow(F.lit(100.0), 1 - a) - 1)) - a * F.col("l")
    return q.withColumn("ll", ll).groupBy("set_id").agg(F.round(F.max_by("a", "ll"), 4).alias("exponent"), F.round(F.max("ll"), 4).alias("ll"))
