"""Orientation statistics, plane geometry and closed-form moments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geom, vec
from ..operators import aggs
from .join_queries import CHORD, SEGMENTS, SQUARE, chords, segments, sql_clip
from .registry import discs, normals, query, r6, read, traces

AXIAL = """
f AS (SELECT *, first_value(nx) OVER w AS rx, first_value(ny) OVER w AS ry, first_value(nz) OVER w AS rz FROM {n} n WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
g AS (SELECT *, CASE WHEN nx * rx + ny * ry + nz * rz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM f),
m AS (SELECT label, count(*) AS n, sum({w}) AS w, sum(s * nx * {w}) AS sx, sum(s * ny * {w}) AS sy, sum(s * nz * {w}) AS sz FROM g GROUP BY label),
r AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS size FROM m)
"""
AX1, AXW = AXIAL.replace("{w}", "1.0::DOUBLE"), AXIAL.replace("{w}", "(1.0::DOUBLE + vec_id % 5)")


@query(f"WITH {AX1} SELECT label, n, round(sx / size, 6) AS mx, round(sy / size, 6) AS my, round(sz / size, 6) AS mz FROM r")
def axial_mean(spark: SparkSession, d: str) -> DataFrame:
    out = aggs.axial_mean(normals(spark, d), "label", "vec_id")
    return out.select("label", "n", *[r6(F.col(c), c) for c in ("mx", "my", "mz")])


@query(f"""
WITH {AX1} SELECT label, round(size / w, 6) AS r_bar, CASE WHEN n >= 2 AND size / w < 1 - 1e-12 THEN round((3 * (size / w) - (size / w) ** 3) / (1 - (size / w) ** 2), 6) END AS kappa FROM r
""")
def fisher_kappa(spark: SparkSession, d: str) -> DataFrame:
    out = aggs.axial_mean(normals(spark, d), "label", "vec_id")
    return out.select("label", r6(F.col("r_bar"), "r_bar"), r6(F.col("kappa"), "kappa"))


@query(f"WITH {AXW} SELECT label, round(sx / size, 6) AS mx, round(sy / size, 6) AS my, round(sz / size, 6) AS mz FROM r")
def length_weighted_normal(spark: SparkSession, d: str) -> DataFrame:
    out = aggs.axial_mean(normals(spark, d), "label", "vec_id", weight=1.0 + F.col("vec_id") % 5)
    return out.select("label", *[r6(F.col(c), c) for c in ("mx", "my", "mz")])


@query("SELECT label, count(*) AS n, round(avg(sqrt(greatest(1 - nx * nx, 0))), 6) AS factor FROM {n} n GROUP BY label")
def orientation_factor(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("n.x")
    return normals(spark, d).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(F.sqrt(F.greatest(1 - x * x, F.lit(0.0)))), "factor"))


@query("""
SELECT label, count(*) AS n, round(avg(nx * nx), 6) AS txx, round(avg(nx * ny), 6) AS txy, round(avg(nx * nz), 6) AS txz, round(avg(ny * ny), 6) AS tyy,
  round(avg(ny * nz), 6) AS tyz, round(avg(nz * nz), 6) AS tzz FROM {n} n GROUP BY label
""")
def orientation_tensor(spark: SparkSession, d: str) -> DataFrame:
    out = aggs.orientation_tensor(normals(spark, d), "label")
    return out.select("label", "n", *[r6(F.col(c), c) for c in out.columns if c.startswith("t")])


@query()
def principal_axis(spark: SparkSession, d: str) -> DataFrame:
    """Principal axis of each label's tensor; only the 3x3 tensors, one row a
    label, are solved in Python."""
    return aggs.principal_axes(aggs.orientation_tensor(normals(spark, d), "label"), "label")


@query("""
WITH a AS (SELECT label, avg(nx * nx) AS xx, avg(ny * ny) AS yy, avg(nx * ny) AS xy FROM {n} n GROUP BY label)
SELECT label, round(((xx + yy) + sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2, 6) AS largest FROM a
""")
def orientation_eig2d(spark: SparkSession, d: str) -> DataFrame:
    t = aggs.orientation_tensor(normals(spark, d), "label")
    xx, yy, xy = F.col("txx"), F.col("tyy"), F.col("txy")
    return t.select("label", r6(((xx + yy) + F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2, "largest"))


@query("""
SELECT vec_id, round(((degrees(atan2(ny * s, nx * s)) + 360) % 360), 5) AS trend, round(degrees(asin(least(abs(nz), 1.0::DOUBLE))), 5) AS plunge,
  round(((degrees(atan2(-nx * u, -ny * u)) + 360) % 360), 5) AS trend_ned, round(degrees(acos(least(abs(nz), 1.0::DOUBLE))), 5) AS dip,
  round(((degrees(atan2(nx * u, ny * u)) + 360) % 360), 5) AS dip_direction
FROM (SELECT *, CASE WHEN nz > 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s, CASE WHEN nz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS u FROM {n} n) x
""")
def trend_plunge(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    parts = {"trend": vec.trend_likelihood(n), "plunge": vec.plunge_likelihood(n), "trend_ned": vec.trend_ned(n), "dip": vec.dip(n), "dip_direction": vec.dip_direction(n)}
    return normals(spark, d).select("vec_id", *[F.round(x, 5).alias(c) for c, x in parts.items()])


@query("""
SELECT s_suppkey, round(cos(p) * sin(t), 6) AS gx, round(cos(p) * cos(t), 6) AS gy, round(-sin(p), 6) AS gz, round(cos(p) * cos(t), 6) AS lx, round(cos(p) * sin(t), 6) AS ly
FROM (SELECT s_suppkey, radians((s_suppkey * 37 % 360)::DOUBLE) AS t, radians((s_suppkey * 11 % 90)::DOUBLE) AS p FROM supplier) x
""")
def axis_conventions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    t, p = (k * 37 % 360).cast("double"), (k * 11 % 90).cast("double")
    rows = read(spark, d, "supplier").select("s_suppkey", vec.axis_generator(t, p).alias("g"), vec.axis_likelihood(t, p).alias("l"))
    return rows.select("s_suppkey", *[r6(F.col(f"g.{c}"), f"g{c}") for c in "xyz"], *[r6(F.col(f"l.{c}"), f"l{c}") for c in "xy"])


COS30, SIN30 = math.cos(math.radians(30)), 0.5
TURN = [[COS30, SIN30, 0.0], [-SIN30, COS30, 0.0], [0.0, 0.0, 1.0]]


@query(f"""
SELECT disc_id, round(cx * {COS30}::DOUBLE - cy * 0.5::DOUBLE, 6) AS x, round(cx * 0.5::DOUBLE + cy * {COS30}::DOUBLE, 6) AS y, round(cz, 6) AS z FROM {{d}} d
""")
def world_rotation(spark: SparkSession, d: str) -> DataFrame:
    turned = vec.rotate(F.col("c"), TURN)
    return discs(spark, d).select("disc_id", turned.alias("p")).select("disc_id", *[r6(F.col(f"p.{c}"), c) for c in "xyz"])


@query("""
SELECT disc_id, round(ny * uz - nz * uy, 6) AS kx, round(nz * ux - nx * uz, 6) AS ky, round(nx * uy - ny * ux, 6) AS kz, round(sqrt(cx * cx + cy * cy + cz * cz), 6) AS size
FROM (SELECT *, cx / sqrt(cx * cx + cy * cy + cz * cz) AS ux, cy / sqrt(cx * cx + cy * cy + cz * cz) AS uy, cz / sqrt(cx * cx + cy * cy + cz * cz) AS uz FROM {d} d) x
""")
def vector_algebra(spark: SparkSession, d: str) -> DataFrame:
    rows = discs(spark, d).withColumn("u", vec.normalize(F.col("c"))).withColumn("k", vec.cross(F.col("n"), F.col("u")))
    return rows.select("disc_id", *[r6(F.col(f"k.{c}"), f"k{c}") for c in "xyz"], r6(vec.norm(F.col("c")), "size"))


HEXAGON = [(8.0, 0.0), (4.0, 6.0), (-4.0, 6.0), (-8.0, 0.0), (-4.0, -6.0), (4.0, -6.0)]


def _sql_inside(y: str, z: str, polygon: list[tuple[float, float]]) -> str:
    edges = zip(polygon, polygon[1:] + polygon[:1])
    parts = [f"CASE WHEN ({b} > {z}) <> ({e} > {z}) AND {y} < ({c} - ({a})) * ({z} - ({b})) / ({e} - ({b}))::DOUBLE + ({a}) THEN 1 ELSE 0 END" for (a, b), (c, e) in edges if b != e]
    return f"(({' + '.join(parts)}) % 2 = 1)"


def _sql_distance(y: str, z: str, polygon: list[tuple[float, float]]) -> str:
    out = []
    for (a, b), (c, e) in zip(polygon, polygon[1:] + polygon[:1]):
        size = (c - a) ** 2 + (e - b) ** 2
        t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({y} - ({a})) * ({c - a}) + ({z} - ({b})) * ({e - b})) / {size}::DOUBLE))"
        out.append(f"hypot({y} - (({a}) + {t} * ({c - a})), {z} - (({b}) + {t} * ({e - b})))")
    return f"least({', '.join(out)})"


@query(f"SELECT trace_id, {_sql_inside('y0', 'z0', HEXAGON)} AS inside, round({_sql_distance('y0', 'z0', HEXAGON)}, 6) AS distance FROM {SEGMENTS} s")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    y, z = F.col("y0"), F.col("z0")
    return segments(spark, d).select("trace_id", geom.inside_polygon(y, z, HEXAGON).alias("inside"), r6(geom.distance_to_polygon(y, z, HEXAGON), "distance"))


@query(f"""
SELECT trace_id, CASE WHEN {_sql_distance('y0', 'z0', HEXAGON)} <= 0.5 THEN 'tunnel_boundary' ELSE 'disc_boundary' END AS p0_type,
  CASE WHEN {_sql_distance('y1', 'z1', HEXAGON)} <= 0.5 THEN 'tunnel_boundary' ELSE 'disc_boundary' END AS p1_type FROM {SEGMENTS} s
""")
def endpoint_types(spark: SparkSession, d: str) -> DataFrame:
    kinds = [geom.endpoint_type(F.col(f"y{k}"), F.col(f"z{k}"), HEXAGON, 0.5).alias(f"p{k}_type") for k in (0, 1)]
    return segments(spark, d).select("trace_id", *kinds)


BOXED = sql_clip(SEGMENTS, "y0", "z0", "y1", "z1")


@query(f"SELECT trace_id, round(vis, 6) AS visible, vcls AS clip_class FROM {BOXED} b")
def clip_bbox(spark: SparkSession, d: str) -> DataFrame:
    rows = geom.with_clip(segments(spark, d), [F.col(c) for c in ("y0", "z0", "y1", "z1")], geom.box(-8.0, -6.0, 8.0, 6.0))
    return rows.select("trace_id", r6(F.col("clip_length"), "visible"), "clip_class")


def _sql_convex(polygon: list[tuple[float, float]]) -> str:
    values = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for (a, b), (c, e) in zip(polygon, polygon[1:] + polygon[:1]))
    return f"""
e AS (SELECT -(d - b) AS ny, c - a AS nz, a, b FROM (VALUES {values}) v(a, b, c, d)),
p AS (SELECT s.*, (y1 - y0) * ny + (z1 - z0) * nz AS into_, (y0 - a) * ny + (z0 - b) * nz AS rest FROM {SEGMENTS} s, e),
q AS (SELECT trace_id, greatest(0, coalesce(max(-rest / into_) FILTER (into_ > 0), 0)) AS t0, least(1, coalesce(min(-rest / into_) FILTER (into_ < 0), 1)) AS t1,
  bool_or(into_ = 0 AND rest < 0) AS away, any_value(hypot(y1 - y0, z1 - z0)) AS whole FROM p GROUP BY trace_id)"""


@query(f"""
WITH {_sql_convex(HEXAGON)} SELECT trace_id, round(CASE WHEN away OR t0 >= t1 THEN 0 ELSE (t1 - t0) * whole END, 6) AS visible,
  CASE WHEN away OR t0 >= t1 THEN -1 ELSE (t0 > 0)::INT + (t1 < 1)::INT END AS clip_class FROM q
""")
def clip_convex(spark: SparkSession, d: str) -> DataFrame:
    rows = geom.with_clip(segments(spark, d), [F.col(c) for c in ("y0", "z0", "y1", "z1")], HEXAGON)
    return rows.select("trace_id", r6(F.col("clip_length"), "visible"), "clip_class")


ARROW = [(-8.0, -6.0), (8.0, -6.0), (0.0, 0.0), (8.0, 6.0), (-8.0, 6.0)]


def clip_any(rows: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Length of a segment inside a polygon of any shape: cut at all crossings
    and keep the pieces whose middle is inside."""
    ends = tuple(F.col(c) for c in ("y0", "z0", "y1", "z1"))
    edges = zip(polygon, polygon[1:] + polygon[:1])
    cuts = [geom.crossing(ends, (*p, *q)) for p, q in edges]
    rows = rows.withColumn("ts", F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit(0.0), F.lit(1.0), *cuts)))))
    pieces = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ts") - 1))).withColumn("a", F.col("ts")[F.col("k") - 1]).withColumn("b", F.col("ts")[F.col("k")])
    mid = (F.col("a") + F.col("b")) / 2
    y, z = F.col("y0") + mid * (F.col("y1") - F.col("y0")), F.col("z0") + mid * (F.col("z1") - F.col("z0"))
    whole = F.hypot(F.col("y1") - F.col("y0"), F.col("z1") - F.col("z0"))
    part = pieces.withColumn("y", y).withColumn("z", z).withColumn("part", (F.col("b") - F.col("a")) * whole)
    return part.groupBy("trace_id").agg(F.sum(F.when(geom.inside_polygon(F.col("y"), F.col("z"), polygon), F.col("part")).otherwise(0.0)).alias("length"))


def _sql_any(polygon: list[tuple[float, float]]) -> str:
    values = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for (a, b), (c, e) in zip(polygon, polygon[1:] + polygon[:1]))
    return f"""
e AS (SELECT * FROM (VALUES {values}) v(p, q, r, u)),
x AS (SELECT s.*, (y1 - y0) * (u - q) - (z1 - z0) * (r - p) AS det, (p - y0) * (u - q) - (q - z0) * (r - p) AS tn, (p - y0) * (z1 - z0) - (q - z0) * (y1 - y0) AS un FROM {SEGMENTS} s, e),
c AS (SELECT trace_id, tn / det AS t FROM x WHERE abs(det) > 1e-12 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1
  UNION SELECT trace_id, 0 FROM {SEGMENTS} s UNION SELECT trace_id, 1 FROM {SEGMENTS} s),
k AS (SELECT trace_id, t AS a, lead(t) OVER (PARTITION BY trace_id ORDER BY t) AS b FROM c),
m AS (SELECT k.*, y0 + (a + b) / 2 * (y1 - y0) AS y, z0 + (a + b) / 2 * (z1 - z0) AS z, hypot(y1 - y0, z1 - z0) AS whole FROM k JOIN {SEGMENTS} s USING (trace_id) WHERE b IS NOT NULL)"""


@query(f"WITH {_sql_any(ARROW)} SELECT trace_id, round(sum(CASE WHEN {_sql_inside('y', 'z', ARROW)} THEN (b - a) * whole ELSE 0 END), 5) AS length FROM m GROUP BY trace_id")
def clip_nonconvex(spark: SparkSession, d: str) -> DataFrame:
    return clip_any(segments(spark, d), ARROW).select("trace_id", F.round("length", 5).alias("length"))


@query(f"SELECT disc_id, face_id, round(2 * half, 6) AS length, round(my, 6) AS my, round(mz, 6) AS mz, round(dy, 6) AS dy, round(dz, 6) AS dz FROM {CHORD} c")
def chord_on_plane(spark: SparkSession, d: str) -> DataFrame:
    return chords(spark, d).select("disc_id", "face_id", r6(2 * F.col("half"), "length"), *[r6(F.col(c), c) for c in ("my", "mz", "dy", "dz")])


@query(f"""
SELECT disc_id, face_id, round(hypot(my - cy, mz - cz), 6) AS shift FROM {CHORD} c JOIN {{d}} d USING (disc_id) WHERE abs(c.face_id * 3 - d.cx) <= 3 AND c.face_id * 3 > d.cx
""")
def predicted_chord(spark: SparkSession, d: str) -> DataFrame:
    """Where a disc seen on a face shows on the next one."""
    ahead = F.col("face_id") * 3.0 - F.col("c.x")
    return chords(spark, d).filter((ahead > 0) & (ahead <= 3)).select("disc_id", "face_id", r6(F.hypot(F.col("my") - F.col("c.y"), F.col("mz") - F.col("c.z")), "shift"))


@query("""
SELECT face_id, count(DISTINCT (floor(y0 / 0.5), floor(z0 / 0.5))) * 0.25 AS area FROM """ + SEGMENTS + """ s GROUP BY face_id
""")
def occupancy_area(spark: SparkSession, d: str) -> DataFrame:
    cells = F.countDistinct(F.floor(F.col("y0") / 0.5), F.floor(F.col("z0") / 0.5))
    return segments(spark, d).groupBy("face_id").agg((cells * 0.25).alias("area"))


@query("""
WITH v AS (SELECT n_regionkey AS ring, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation),
p AS (SELECT *, (5.0::DOUBLE + k % 3) * cos(i * 2 * pi() / m) AS y, (5.0::DOUBLE + k % 3) * sin(i * 2 * pi() / m) AS z FROM v),
e AS (SELECT ring, y, z, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, coalesce(lead(z) OVER w, first_value(z) OVER w) AS z2 FROM p WINDOW w AS (PARTITION BY ring ORDER BY i))
SELECT ring, round(sum(y * z2 - y2 * z) / 2, 6) AS area, sum(y * z2 - y2 * z) > 0 AS ccw FROM e GROUP BY ring
""")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    group = Window.partitionBy("ring").orderBy("k")
    v = read(spark, d, "nation").select(F.col("n_regionkey").alias("ring"), F.col("n_nationkey").alias("k"))
    v = v.withColumn("i", F.row_number().over(group)).withColumn("m", F.count("*").over(Window.partitionBy("ring")))
    angle = F.col("i") * 2 * math.pi / F.col("m")
    v = v.withColumn("y", (5.0 + F.col("k") % 3) * F.cos(angle)).withColumn("z", (5.0 + F.col("k") % 3) * F.sin(angle))
    for c in "yz":
        v = v.withColumn(f"{c}2", F.coalesce(F.lead(c).over(group), F.first(c).over(group)))
    twice = F.sum(F.col("y") * F.col("z2") - F.col("y2") * F.col("z"))
    return v.groupBy("ring").agg(r6(twice / 2, "area"), (twice > 0).alias("ccw"))


@query("""
WITH v AS (SELECT s_suppkey AS id, (s_suppkey % 10)::DOUBLE AS x, (s_suppkey // 10)::DOUBLE AS y, (s_acctbal / 5000)::DOUBLE AS z FROM supplier),
t AS (SELECT a.id, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM v a JOIN v b ON b.id = a.id + 1 JOIN v c ON c.id = a.id + 10)
SELECT count(*) AS triangles, round(sum(sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2)) / 2, 6) AS area FROM t
""")
def mesh_area(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    v = read(spark, d, "supplier").select(k.alias("id"), vec.vec(k % 10, F.floor(k / 10), F.col("s_acctbal") / 5000).alias("p"))
    at = lambda name, step: v.select((F.col("id") - step).alias("id"), F.col("p").alias(name))
    t = at("a", 0).join(at("b", 1), "id").join(at("c", 10), "id")
    size = vec.norm(vec.cross(vec.sub(F.col("b"), F.col("a")), vec.sub(F.col("c"), F.col("a"))))
    return t.agg(F.count("*").alias("triangles"), r6(F.sum(size) / 2, "area"))


@query("""
WITH s AS (SELECT set_id, count(*) AS n, avg(y0) AS my, avg(z0) AS mz, avg(y0 * y0) AS yy, avg(y0 * z0) AS yz, avg(z0 * z0) AS zz FROM """ + SEGMENTS + """ s GROUP BY set_id)
SELECT set_id, round((yy - my * my + zz - mz * mz - sqrt((yy - my * my - zz + mz * mz) ** 2 + 4 * (yz - my * mz) ** 2)) / 2, 4) AS smallest, round(sqrt(greatest(0, (yy - my * my + zz - mz * mz - sqrt((yy - my * my - zz + mz * mz) ** 2 + 4 * (yz - my * mz) ** 2)) / 2)), 4) AS rmse FROM s
""")
def line_fit_rmse(spark: SparkSession, d: str) -> DataFrame:
    """Residual of the best line per set: least eigenvalue of the covariance."""
    y, z = F.col("y0"), F.col("z0")
    s = segments(spark, d).groupBy("set_id").agg(F.avg(y).alias("my"), F.avg(z).alias("mz"), F.avg(y * y).alias("yy"), F.avg(y * z).alias("yz"), F.avg(z * z).alias("zz"))
    a, b, c = F.col("yy") - F.col("my") * F.col("my"), F.col("zz") - F.col("mz") * F.col("mz"), F.col("yz") - F.col("my") * F.col("mz")
    low = (a + b - F.sqrt((a - b) * (a - b) + 4 * c * c)) / 2
    return s.select("set_id", F.round(low, 4).alias("smallest"), F.round(F.sqrt(F.greatest(F.lit(0.0), low)), 4).alias("rmse"))


@query("""
WITH p AS (SELECT label, 3 + (2 + label * 0.1::DOUBLE) * nx / hypot(nx, ny) + 0.05::DOUBLE * nz AS x, (2 + label * 0.1::DOUBLE) * ny / hypot(nx, ny) - 1 AS y FROM {n} n),
s AS (SELECT label, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy, sum(x * (x * x + y * y)) AS sxr, sum(y * (x * x + y * y)) AS syr, sum(x * x + y * y) AS sr FROM p GROUP BY label),
c AS (SELECT *, sxx - sx * sx / n AS a, sxy - sx * sy / n AS b, syy - sy * sy / n AS c, (sxr - sr * sx / n) / 2 AS e, (syr - sr * sy / n) / 2 AS f FROM s),
q AS (SELECT *, (e * c - f * b) / (a * c - b * b) AS ux, (a * f - b * e) / (a * c - b * b) AS uy FROM c)
SELECT label, round(ux, 5) AS cx, round(uy, 5) AS cy, round(sqrt((sr - 2 * ux * sx - 2 * uy * sy) / n + ux * ux + uy * uy), 5) AS radius FROM q
""")
def circle_fit(spark: SparkSession, d: str) -> DataFrame:
    """Kasa circle fit: linear least squares from sums."""
    n = F.col("n")
    flat, size = F.hypot(n["x"], n["y"]), 2 + F.col("label") * 0.1
    p = normals(spark, d).select("label", (3 + size * n["x"] / flat + 0.05 * n["z"]).alias("x"), (size * n["y"] / flat - 1).alias("y"))
    x, y = F.col("x"), F.col("y")
    r = x * x + y * y
    sums = {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y, "sxr": x * r, "syr": y * r, "sr": r}
    s = p.groupBy("label").agg(F.count("*").cast("double").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])
    sx, sy, m = F.col("sx"), F.col("sy"), F.col("n")
    s = s.withColumns({"a": F.col("sxx") - sx * sx / m, "b": F.col("sxy") - sx * sy / m, "k": F.col("syy") - sy * sy / m, "e": (F.col("sxr") - F.col("sr") * sx / m) / 2, "f": (F.col("syr") - F.col("sr") * sy / m) / 2})
    a, b, k, e, f = (F.col(c) for c in "abkef")
    s = s.withColumn("ux", (e * k - f * b) / (a * k - b * b)).withColumn("uy", (a * f - b * e) / (a * k - b * b))
    ux, uy = F.col("ux"), F.col("uy")
    radius = F.sqrt((F.col("sr") - 2 * ux * sx - 2 * uy * sy) / m + ux * ux + uy * uy)
    return s.select("label", F.round(ux, 5).alias("cx"), F.round(uy, 5).alias("cy"), F.round(radius, 5).alias("radius"))


def powerlaw_mean(k: "F.Column", low: float, high: float, power: float) -> "F.Column":
    """E[r ** power] of a density r ** -k on [low, high]."""
    term = lambda e: F.when(F.abs(e) < 1e-12, F.log(F.lit(high / low))).otherwise((F.pow(F.lit(high), e) - F.pow(F.lit(low), e)) / e)
    return term(power + 1 - k) / term(1 - k)


@query("""
WITH k AS (SELECT 2.15::DOUBLE + i * 0.1::DOUBLE AS kr FROM range(20) x(i)),
m AS (SELECT kr, (250.0::DOUBLE ** (2 - kr) - 0.5::DOUBLE ** (2 - kr)) / (2 - kr) / ((250.0::DOUBLE ** (1 - kr) - 0.5::DOUBLE ** (1 - kr)) / (1 - kr)) AS m1,
  (250.0::DOUBLE ** (3 - kr) - 0.5::DOUBLE ** (3 - kr)) / (3 - kr) / ((250.0::DOUBLE ** (1 - kr) - 0.5::DOUBLE ** (1 - kr)) / (1 - kr)) AS m2 FROM k)
SELECT round(kr, 4) AS kr, round(m1, 6) AS mean_r, round(m2, 5) AS mean_r2, round((2 * 0.8995::DOUBLE * m1 / (pi() * m2)) * (pi() / 2 * m2 / m1), 6) AS identity FROM m
""")
def powerlaw_moments(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(20).select((F.lit(2.15) + F.col("id") * F.lit(0.1)).alias("kr"))
    m1, m2 = powerlaw_mean(F.col("kr"), 0.5, 250.0, 1.0), powerlaw_mean(F.col("kr"), 0.5, 250.0, 2.0)
    same = (2 * 0.8995 * m1 / (math.pi * m2)) * (math.pi / 2 * m2 / m1)
    return grid.select(F.round("kr", 4).alias("kr"), r6(m1, "mean_r"), F.round(m2, 5).alias("mean_r2"), r6(same, "identity"))


@query("""
WITH s AS (SELECT set_id, avg(len) AS m, sum(len) / 1250 AS p21, 2.4::DOUBLE + count(DISTINCT face_id) * 0.05::DOUBLE AS kr FROM {t} t GROUP BY set_id)
SELECT set_id, round(p21 * CASE WHEN abs(3 - kr) < 1e-9 THEN ln(100.0::DOUBLE / 2) / ln(100.0::DOUBLE / 0.5)
  ELSE (100.0::DOUBLE ** (3 - kr) - 2.0::DOUBLE ** (3 - kr)) / (100.0::DOUBLE ** (3 - kr) - 0.5::DOUBLE ** (3 - kr)) END, 6) AS p32_scaled FROM s
""")
def support_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Intensity carried from one radius support to a narrower one."""
    s = traces(spark, d).groupBy("set_id").agg((F.sum("len") / 1250).alias("p21"), (2.4 + F.countDistinct("face_id") * 0.05).alias("kr"))
    power = lambda base: F.pow(F.lit(base), 3 - F.col("kr"))
    # the second moment of a density with exponent 3 is logarithmic
    share = F.when(F.abs(3 - F.col("kr")) < 1e-9, F.lit(math.log(100 / 2) / math.log(100 / 0.5))).otherwise(
        F.try_divide(power(100.0) - power(2.0), power(100.0) - power(0.5))
    )
    return s.select("set_id", r6(F.col("p21") * share, "p32_scaled"))


@query("""
WITH s AS (SELECT set_id, sum(len) / 1250 AS p21, avg((cls > 0)::INT)::DOUBLE AS c FROM {t} t GROUP BY set_id)
SELECT set_id, round(p21 / c, 6) AS p32, round(p21 / (c * 1.1::DOUBLE), 6) AS low, round(p21 / (c * 0.9::DOUBLE), 6) AS high,
  CASE WHEN c < 0.66 THEN 'weak' WHEN c < 0.67 THEN 'usable' ELSE 'good' END AS status FROM s
""")
def p32_division(spark: SparkSession, d: str) -> DataFrame:
    s = traces(spark, d).groupBy("set_id").agg((F.sum("len") / 1250).alias("p21"), F.avg((F.col("cls") > 0).cast("double")).alias("c"))
    c = F.col("c")
    status = F.when(c < 0.66, "weak").when(c < 0.67, "usable").otherwise("good")
    return s.select("set_id", r6(F.try_divide("p21", c), "p32"), r6(F.try_divide("p21", c * 1.1), "low"), r6(F.try_divide("p21", c * 0.9), "high"), status.alias("status"))


@query("""
WITH q AS (SELECT s_suppkey, 0.5::DOUBLE + s_acctbal % 7 / 10 AS l, 2.6::DOUBLE AS kr FROM supplier),
u AS (SELECT s_suppkey, l, i / 200.0::DOUBLE AS u FROM q, range(200) x(i)),
r AS (SELECT s_suppkey, u, l / sqrt(1 - u * u) AS r FROM u WHERE l / sqrt(1 - u * u) <= 50)
SELECT s_suppkey, round(sum(r ** (1 - 2.6::DOUBLE) * r) / sum(r ** (1 - 2.6::DOUBLE)), 6) AS mean_radius FROM r GROUP BY s_suppkey
""")
def posterior_mean_radius(spark: SparkSession, d: str) -> DataFrame:
    """Mean radius given a half chord, by quadrature over the offset."""
    q = read(spark, d, "supplier").select("s_suppkey", (0.5 + F.col("s_acctbal") % 7 / 10).alias("l"))
    u = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.col("l") / F.sqrt(1 - (k / 200.0) * (k / 200.0)))
    rs = q.withColumn("rs", F.filter(u, lambda r: r <= 50))
    total = lambda f: F.aggregate("rs", F.lit(0.0), lambda s, r: s + f(r))
    w = lambda r: F.pow(r, F.lit(1 - 2.6))
    return rs.select("s_suppkey", r6(total(lambda r: w(r) * r) / total(w), "mean_radius"))


@query("""
SELECT a.disc_id, round(sqrt(least(9e9, (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2)), 6) AS apart,
  sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) <= a.radius + b.radius AS reach
FROM {d} a JOIN {d} b ON b.disc_id = a.disc_id + 1
""")
def sphere_inclusion(spark: SparkSession, d: str) -> DataFrame:
    rows = discs(spark, d).select("disc_id", "c", "radius")
    after = rows.select((F.col("disc_id") - 1).alias("disc_id"), F.col("c").alias("e"), F.col("radius").alias("s"))
    apart = vec.norm(vec.sub(F.col("c"), F.col("e")))
    return rows.join(after, "disc_id").select("disc_id", r6(apart, "apart"), (apart <= F.col("radius") + F.col("s")).alias("reach"))


@query()
def segment_distances(spark: SparkSession, d: str) -> DataFrame:
    """Least distance between the axes of neighbouring discs, as segments."""
    rows = discs(spark, d).select("disc_id", F.col("c").alias("p0"), vec.add(F.col("c"), F.col("n")).alias("p1"))
    after = rows.select((F.col("disc_id") - 1).alias("disc_id"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    found = geom.segment_distance(*[F.col(c) for c in ("p0", "p1", "q0", "q1")])
    return rows.join(after, "disc_id").select("disc_id", r6(found, "distance"))


@query("""
WITH b AS (SELECT disc_id, least(abs(-20 - cx), 1) AS k, nx * (s.sx * 4) + ny * (s.sy * 6) + nz * (s.sz * 5) - (nx * cx + ny * cy + nz * cz) + nx * 20 AS v FROM {d} d,
  (SELECT x.v AS sx, y.v AS sy, z.v AS sz FROM (VALUES (-1), (1)) x(v), (VALUES (-1), (1)) y(v), (VALUES (-1), (1)) z(v)) s)
SELECT d.disc_id, abs(cx - 20) <= 4 + radius AND abs(cy) <= 6 + radius AND abs(cz) <= 5 + radius AS box_meets, min(v) <= 1e-9 AND max(v) >= -1e-9 AS straddles
FROM {d} d JOIN b USING (disc_id) GROUP BY d.disc_id, cx, cy, cz, radius
""")
def box_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Two-stage filter of discs against a box: ranges, then whether the
    plane parts the eight corners."""
    c, n, r = F.col("c"), F.col("n"), F.col("radius")
    meets = (F.abs(c["x"] - 20) <= 4 + r) & (F.abs(c["y"]) <= 6 + r) & (F.abs(c["z"]) <= 5 + r)
    corners = [vec.dot(n, vec.sub(vec.vec(20 + 4 * i, 6 * j, 5 * k), c)) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)]
    return discs(spark, d).select("disc_id", meets.alias("box_meets"), ((F.least(*corners) <= 1e-9) & (F.greatest(*corners) >= -1e-9)).alias("straddles"))
