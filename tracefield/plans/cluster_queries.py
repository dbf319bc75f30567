"""Sets of directions found by clustering.

Field data come without sets; these queries make them: from the directions of
a face's traces, from axes, and from the mean axes of sets on faces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import aggs, clustering, graph
from .association_queries import observed
from .join_queries import FRAGMENTS, SEGMENTS, fragment_groups, segments
from .registry import normals, query, r6, rounded

MOST, ROUNDS = 4, 6


def _unrolled(points: str, parts: str, apart: str, center: str) -> str:
    """SQL of the k-means of ``points(key, id, parts)``: seeds, ``ROUNDS``
    rounds, and each point's label and distance, ``near``."""
    cols = [f"{c}" for c in parts]
    listed = ", ".join(cols)
    both = lambda a, b: apart.replace("a.", f"{a}.").replace("b.", f"{b}.")
    out = [f"pts AS MATERIALIZED ({points})", "c0 AS MATERIALIZED (SELECT key, 0 AS label, " + ", ".join(f"arg_min({c}, id) AS {c}" for c in cols) + " FROM pts GROUP BY key)"]
    for k in range(1, MOST):
        far = f"SELECT p.key, p.id, {', '.join(f'any_value(p.{c}) AS {c}' for c in cols)}, min(round({both('p', 'c')}, 9)) AS d FROM pts p JOIN c{k - 1} c ON c.key = p.key GROUP BY p.key, p.id"
        out.append(f"c{k} AS MATERIALIZED (SELECT * FROM c{k - 1} UNION ALL SELECT key, {k}, {listed} FROM ({far}) f QUALIFY row_number() OVER (PARTITION BY key ORDER BY d DESC, id) = 1)")
    out.append(f"s0 AS (SELECT key, k, label, {listed} FROM c{MOST - 1}, range(1, {MOST + 1}) r(k) WHERE label < k)")

    def assigned(r: int) -> str:
        return f"""SELECT p.key, k, p.id, {', '.join(f'p.{c}' for c in cols)}, label, {both('p', 'c')} AS d FROM pts p JOIN s{r} c ON c.key = p.key
  QUALIFY row_number() OVER (PARTITION BY p.key, k, p.id ORDER BY round({both('p', 'c')}, 9), label) = 1"""

    for r in range(ROUNDS):
        out.append(f"a{r} AS MATERIALIZED ({assigned(r)})")
        moved = center.replace("{a}", f"a{r}")
        out.append(f"s{r + 1} AS MATERIALIZED (SELECT s.key, s.k, s.label, {', '.join(f'coalesce(m.{c}, s.{c}) AS {c}' for c in cols)} FROM s{r} s LEFT JOIN ({moved}) m USING (key, k, label))")
    return ",\n".join([*out, f"near AS MATERIALIZED ({assigned(ROUNDS)})"])


CIRCLE = _unrolled(
    f"SELECT face_id AS key, trace_id AS id, cos(2 * angle) AS x, sin(2 * angle) AS y FROM {SEGMENTS} s", "xy", "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))",
    "SELECT key, k, label, avg(x) AS x, avg(y) AS y FROM {a} GROUP BY key, k, label",
)
CIRCLE_MODELS = f"""{CIRCLE},
fit AS (SELECT key, k, count(*) AS n, sum(d) AS rss FROM near GROUP BY key, k HAVING k = 1 OR k * 5 <= count(*)),
models AS (SELECT *, CASE WHEN n > k THEN ln(n) * (k * 2 + k - 1) + n * 2 * (ln(2 * pi() * greatest(rss / (n * 2 + 1e-9::DOUBLE), 1e-9::DOUBLE)) + 1) ELSE 'inf'::DOUBLE END AS bic FROM fit),
best AS (SELECT key, k FROM models QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(bic, 9), k) = 1)"""


def _angles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Directions of each face's traces, labels of the different ones, and
    models."""
    points = segments(spark, d).select("face_id", F.col("trace_id").alias("id"), clustering.doubled(F.col("angle")).alias("p"))
    _, labels = clustering.lloyd(clustering.alike(points, ["face_id"]), ["face_id"], MOST, clustering.PLANE, ROUNDS)
    return points, labels, graph.cut_lineage(clustering.gaussian_models(labels, ["face_id"]))


@query(f"""
WITH {CIRCLE_MODELS} SELECT m.key AS face_id, m.k::INT AS k, n, round(rss, 6) AS rss, round(bic, 5) AS bic, b.k IS NOT NULL AS chosen FROM models m LEFT JOIN best b ON b.key = m.key AND b.k = m.k
""")
def angle_set_models(spark: SparkSession, d: str) -> DataFrame:
    """How well one to four sets of directions fit each face's traces."""
    models = _angles(spark, d)[2]
    best = clustering.best_model(models, ["face_id"]).withColumn("chosen", F.lit(True))
    return models.join(best, ["face_id", "k"], "left").select("face_id", "k", "n", r6(F.col("rss"), "rss"), F.round("bic", 5).alias("bic"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(f"WITH {CIRCLE_MODELS} SELECT id AS trace_id, key AS face_id, label + 1 AS set_number FROM near JOIN best USING (key, k)")
def angle_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each trace's set by its direction, in the number of sets that fits its
    face best."""
    points, labels, models = _angles(spark, d)
    best = clustering.best_model(models, ["face_id"])
    found = clustering.of_alike(points, labels.join(best, ["face_id", "k"]), ["face_id"])
    return found.select(F.col("id").alias("trace_id"), "face_id", (F.col("label") + 1).alias("set_number"))


SPHERE = _unrolled(
    "SELECT label AS key, vec_id AS id, nx AS x, ny AS y, nz AS z FROM {n} v", "xyz", "(1 - (a.x * b.x + a.y * b.y + a.z * b.z) * (a.x * b.x + a.y * b.y + a.z * b.z))",
    "SELECT key, k, label, px AS x, py AS y, pz AS z FROM " + vec.sql_axis("(SELECT key, k, label, sum(x * x) AS xx, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * y) AS yy, sum(y * z) AS yz, sum(z * z) AS zz FROM {a} GROUP BY key, k, label)", "p", False) + " ax",
)
SPHERE_MODELS = f"""{SPHERE},
each AS (SELECT key, k, label, count(*) AS n, sum(sqrt(greatest(1 - d, 0))) / count(*) AS r, sum(ln(greatest(sqrt(greatest(1 - d, 0)), 1e-12::DOUBLE))) AS fit FROM near GROUP BY key, k, label),
models AS (SELECT key, k, sum(n)::BIGINT AS n, CASE WHEN sum(n) > k THEN 4 * k * ln(sum(n)) - 2 * sum(CASE WHEN n >= 2 THEN fit * (CASE WHEN r < 1 - 1e-12::DOUBLE THEN least(100.0::DOUBLE, (3 * r - r * r * r) / (1 - r * r)) ELSE 100.0::DOUBLE END) ELSE 0 END)
  ELSE 1e10::DOUBLE END AS bic FROM each GROUP BY key, k),
best AS (SELECT key, k FROM models QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(bic, 9), k) = 1)"""


def _axes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = normals(spark, d).select("label", F.col("vec_id").alias("id"), F.col("n").alias("p")).withColumnRenamed("label", "family")
    return clustering.lloyd(points, ["family"], MOST, clustering.AXES, ROUNDS)


@query(f"""
WITH {SPHERE_MODELS} SELECT m.key AS family, m.k::INT AS k, n, round(bic, 5) AS bic, b.k IS NOT NULL AS chosen FROM models m LEFT JOIN best b ON b.key = m.key AND b.k = m.k
""")
def axis_set_models(spark: SparkSession, d: str) -> DataFrame:
    """How well one to four sets fit the axes of each family."""
    models = clustering.axial_models(_axes(spark, d)[1], ["family"])
    best = clustering.best_model(models, ["family"]).withColumn("chosen", F.lit(True))
    return models.join(best, ["family", "k"], "left").select("family", "k", "n", F.round("bic", 5).alias("bic"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(f"""
WITH {SPHERE_MODELS} SELECT id AS vec_id, key AS family, near.k::INT AS n_sets, near.label + 1 AS set_number, round(degrees(acos(least(1.0::DOUBLE, sqrt(greatest(1 - d, 0))))), 4) AS angle FROM near JOIN best USING (key, k)
""")
def axis_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each axis' set in the best number of sets, and its angle to the set's
    principal axis."""
    labels = _axes(spark, d)[1]
    best = clustering.best_model(clustering.axial_models(labels, ["family"]), ["family"])
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.sqrt(F.greatest(1 - F.col("d"), F.lit(0.0))))))
    found = labels.join(F.broadcast(best), ["family", "k"])
    return found.select(F.col("id").alias("vec_id"), "family", F.col("k").alias("n_sets"), (F.col("label") + 1).alias("set_number"), F.round(angle, 4).alias("angle"))


@query()
def linked_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of all faces from the mean axes of each face's sets, by average
    linkage cut at 30 degrees and numbered by falling number of traces; merges
    depend on each other, so without SQL."""
    rows = observed(spark, d).withColumn("unit", F.concat_ws("/", F.format_string("%04d", "face_id"), "set_id"))
    means = aggs.axial_mean(rows, "unit", "trace_id")
    units = means.select(F.col("unit").alias("id"), vec.vec(F.col("mx"), F.col("my"), F.col("mz")).alias("n"))
    names = clustering.linkage_cut(units, 30.0, []).join(means.select(F.col("unit").alias("id"), F.col("n").alias("n_traces")), "id")
    return clustering.numbered(names).select(F.split("id", "/")[0].cast("int").alias("face_id"), F.split("id", "/")[1].alias("source_set"), "n_traces", "set_number")


@query(f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {SEGMENTS} x), f AS MATERIALIZED ({FRAGMENTS}), e AS (SELECT i AS a, j AS b FROM f UNION ALL SELECT j, i FROM f),
r AS (SELECT trace_id AS id, trace_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b), g AS MATERIALIZED (SELECT id AS trace_id, min(c) AS component FROM r GROUP BY id),
k AS MATERIALIZED (SELECT component, y0, z0, y1, z1, face_id FROM s JOIN g USING (trace_id)),
m AS (SELECT component, any_value(face_id) AS face_id, count(*) AS n_fragments, sum(hypot(y1 - y0, z1 - z0) * cos(2 * atan2(z1 - z0, y1 - y0))) AS c, sum(hypot(y1 - y0, z1 - z0) * sin(2 * atan2(z1 - z0, y1 - y0))) AS s,
  sum(hypot(y1 - y0, z1 - z0)) AS total FROM k GROUP BY component),
p AS (SELECT x.component, y, z, y * cos(atan2(s, c) / 2) + z * sin(atan2(s, c) / 2) AS w FROM (SELECT component, y0 AS y, z0 AS z FROM k UNION ALL SELECT component, y1, z1 FROM k) x JOIN m USING (component)),
o AS (SELECT component, arg_min(y, w) AS ya, arg_min(z, w) AS za, arg_max(y, w) AS yb, arg_max(z, w) AS zb FROM p GROUP BY component)
SELECT component, face_id, n_fragments, round(hypot(yb - ya, zb - za), 5) AS length, round(total, 5) AS fragment_length FROM o JOIN m USING (component) WHERE n_fragments > 1
""")
def fragment_chains(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that are one trace as one: nearly collinear fragments of a set
    on a face with ends close together, all that such pairs connect, and the
    trace from the first to the last end along their main direction."""
    rows = graph.cut_lineage(segments(spark, d))
    groups = graph.cut_lineage(fragment_groups(rows, ["set_id", "face_id"], 2.0, 0.5, 0.3))
    each = rows.join(groups.withColumnRenamed("id", "trace_id"), "trace_id").groupBy("component").agg(F.min("face_id").alias("face_id"), F.sum(F.hypot(F.col("y1") - F.col("y0"), F.col("z1") - F.col("z0"))).alias("total"))
    found = graph.relink(rows, groups).filter("n_fragments > 1").join(each, "component")
    return found.select("component", "face_id", "n_fragments", rounded("length", 5).alias("length"), rounded("total", 5).alias("fragment_length"))
