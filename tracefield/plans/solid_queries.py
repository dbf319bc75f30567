"""Voxels by plane, tunnel and distance, and discs clipped to a box.

The grid is the cells of order lines, a metre each; the outline of the tunnel is
a ring of one point per nation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom, vec
from ..operators import graph, voxels
from .graph_queries import VOXELS, _voxels
from .registry import discs, query, r6, read

BOX = {"ix": (0, 39), "iy": (0, 24), "iz": (0, 29)}
CELLS = f"(SELECT DISTINCT ix, iy, iz, ix + 0.5::DOUBLE AS x, iy - 12.0::DOUBLE AS y, iz - 14.5::DOUBLE AS z FROM {VOXELS} v)"
RING = """(SELECT ay, az, lead(ay, 1, first) OVER (ORDER BY k) AS qy, lead(az, 1, start) OVER (ORDER BY k) AS qz FROM (SELECT *, first_value(ay) OVER (ORDER BY k) AS first, first_value(az) OVER (ORDER BY k) AS start
  FROM (SELECT n_nationkey AS k, (5 + n_regionkey * 0.37::DOUBLE) * cos(n_nationkey * pi() / 12.5::DOUBLE) AS ay, (4 + n_regionkey * 0.29::DOUBLE) * sin(n_nationkey * pi() / 12.5::DOUBLE) AS az FROM nation) n) r)"""
OWNERS = f"""SELECT ix, iy, iz, disc_id AS owner, off FROM (SELECT *, dx * dx + dy * dy + dz * dz - off * off AS far FROM (SELECT *, abs(dx * nx + dy * ny + dz * nz) AS off FROM (SELECT v.ix, v.iy, v.iz, d.*, x - cx AS dx, y - cy AS dy, z - cz AS dz FROM {CELLS} v, {{d}} d) a) b) c
  WHERE off <= 0.6 AND far <= radius * radius QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY off, disc_id) = 1"""
MASK = f"""SELECT iy, iz, sqrt(min(gy * gy + gz * gz)) AS gap, CASE WHEN sum(crossed) % 2 = 1 THEN 'tunnel' WHEN sqrt(min(gy * gy + gz * gz)) <= 2.5 THEN 'halo' ELSE 'rock' END AS mask FROM (
  SELECT iy, iz, y - ay - t * (qy - ay) AS gy, z - az - t * (qz - az) AS gz, CASE WHEN (az > z) != (qz > z) AND y < (qy - ay) * (z - az) / (qz - az) + ay THEN 1 ELSE 0 END AS crossed FROM (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((y - ay) * (qy - ay) + (z - az) * (qz - az)) / ((qy - ay) * (qy - ay) + (qz - az) * (qz - az)))) AS t FROM (SELECT DISTINCT iy, iz, y, z FROM {CELLS} v) c, {RING} e) s) m GROUP BY iy, iz"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    place = vec.vec(F.col("ix") + 0.5, F.col("iy") - 12.0, F.col("iz") - 14.5)
    return _voxels(spark, d).select(*voxels.CELL).distinct().withColumn("p", place)


def _outline(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the outline: each point and the next, joined by number."""
    k, region = F.col("n_nationkey"), F.col("n_regionkey")
    points = read(spark, d, "nation").select(
        k.alias("k"), ((5 + region * 0.37) * F.cos(k * math.pi / 12.5)).alias("ay"), ((4 + region * 0.29) * F.sin(k * math.pi / 12.5)).alias("az")
    )
    after = points.select(F.when(F.col("k") == 0, 24).otherwise(F.col("k") - 1).alias("k"), F.col("ay").alias("qy"), F.col("az").alias("qz"))
    return points.join(after, "k").drop("k")


def _mask(spark: SparkSession, d: str) -> DataFrame:
    places = _cells(spark, d).select("iy", "iz", F.col("p.y").alias("y"), F.col("p.z").alias("z")).distinct()
    return voxels.outline_mask(places, _outline(spark, d), 2.5)


@query(f"SELECT iy, iz, round(gap, 6) AS gap, mask FROM ({MASK}) q")
def tunnel_mask(spark: SparkSession, d: str) -> DataFrame:
    """Where a section of the grid lies: in the tunnel, in the halo around it,
    or in the rock."""
    return _mask(spark, d).select("iy", "iz", r6(F.col("gap"), "gap"), "mask")


@query(f"""
SELECT v.ix, v.iy, v.iz, CASE WHEN mask = 'tunnel' THEN 'tunnel' WHEN owner IS NOT NULL THEN 'fracture' ELSE 'rock' END AS state, coalesce(owner, -1) AS owner, round(off, 6) AS off
FROM {CELLS} v LEFT JOIN ({OWNERS}) o USING (ix, iy, iz) LEFT JOIN ({MASK}) m USING (iy, iz)
""")
def voxel_owners(spark: SparkSession, d: str) -> DataFrame:
    """Tunnel, fracture or rock for every cell of the grid, and the disc whose
    plane is nearest."""
    cells = _cells(spark, d)
    found = cells.join(voxels.plane_owners(cells, discs(spark, d), 0.6, 4.0), voxels.CELL, "left").join(_mask(spark, d).select("iy", "iz", "mask"), ["iy", "iz"], "left")
    state = F.when(F.col("mask") == "tunnel", "tunnel").when(F.col("owner").isNotNull(), "fracture").otherwise("rock")
    return found.select(*voxels.CELL, state.alias("state"), F.coalesce("owner", F.lit(-1)).alias("owner"), r6(F.col("off"), "off"))


@query(f"""
WITH v AS (SELECT * FROM {VOXELS} x), p AS (SELECT ix, iy, iz, count(*) AS hits FROM v GROUP BY ALL HAVING count(*) >= 2), a AS (SELECT ix, iy, iz FROM v WHERE run = 3)
SELECT p.ix, p.iy, p.iz, hits, min((p.ix - a.ix) * (p.ix - a.ix) + (p.iy - a.iy) * (p.iy - a.iy) + (p.iz - a.iz) * (p.iz - a.iz))::BIGINT AS d2 FROM p, a GROUP BY ALL
""")
def block_distances(spark: SparkSession, d: str) -> DataFrame:
    """How far each cell that two runs or more have is from the blocks of one
    run, as the square of a number of cells."""
    cells = _voxels(spark, d)
    likely = cells.groupBy(*voxels.CELL).agg(F.count("*").alias("hits")).filter("hits >= 2")
    return likely.join(voxels.squared_distances(cells.filter("run = 3"), BOX), voxels.CELL)


WALLS = (("x", 5.2, 1), ("x", 30.7, -1), ("y", -8.6, 1), ("y", 8.4, -1), ("z", -7.3, 1), ("z", 7.1, -1))


def _sql_clips() -> str:
    parts = ["r AS (SELECT disc_id, radius, cx, cy, cz, nx, ny, nz, CASE WHEN abs(nz) < 0.95 THEN -ny ELSE 0.0::DOUBLE END AS ax, CASE WHEN abs(nz) < 0.95 THEN nx ELSE -nz END AS ay, CASE WHEN abs(nz) < 0.95 THEN 0.0::DOUBLE ELSE ny END AS az FROM {d} d)",
             "u AS (SELECT *, ax / sqrt(ax * ax + ay * ay + az * az) AS ux, ay / sqrt(ax * ax + ay * ay + az * az) AS uy, az / sqrt(ax * ax + ay * ay + az * az) AS uz FROM r)",
             f"w0 AS (SELECT disc_id, list({{'x': cx + (ux * (radius * cos(t)) + vx * (radius * sin(t))), 'y': cy + (uy * (radius * cos(t)) + vy * (radius * sin(t))), 'z': cz + (uz * (radius * cos(t)) + vz * (radius * sin(t)))}} ORDER BY k) AS v FROM (SELECT *, ny * uz - nz * uy AS vx, nz * ux - nx * uz AS vy, nx * uy - ny * ux AS vz, k * {2 * math.pi / 16!r}::DOUBLE AS t FROM u, range(16) q(k)) s GROUP BY disc_id)"]
    for k, (c, at, s) in enumerate(WALLS):
        way = ", ".join(f"'{e}': p.{e} + (q.{e} - p.{e}) * (a / (a - b))" for e in "xyz")
        parts.append(f"""e{k} AS (SELECT disc_id, k, v[k] AS p, v[k % len(v) + 1] AS q, (v[k].{c} - {at}::DOUBLE) * {s} AS a, (v[k % len(v) + 1].{c} - {at}::DOUBLE) * {s} AS b FROM (SELECT disc_id, v, unnest(range(1, len(v) + 1)) AS k FROM w{k}) x),
w{k + 1} AS (SELECT disc_id, flatten(list(CASE WHEN a >= 0 AND b < 0 THEN [p, {{{way}}}] WHEN a >= 0 THEN [p] WHEN b >= 0 THEN [{{{way}}}] ELSE [] END ORDER BY k)) AS v FROM e{k} GROUP BY disc_id)""")
    n = len(WALLS)
    parts.append(f"""f AS (SELECT disc_id, len(v) AS n, v[1] AS o, unnest(v) AS p, unnest(list_concat([v[1]], v[1:len(v) - 1])) AS l FROM w{n}),
area AS (SELECT disc_id, any_value(n) AS n_points, sqrt(sum((l.y - o.y) * (p.z - o.z) - (l.z - o.z) * (p.y - o.y)) ** 2 + sum((l.z - o.z) * (p.x - o.x) - (l.x - o.x) * (p.z - o.z)) ** 2 + sum((l.x - o.x) * (p.y - o.y) - (l.y - o.y) * (p.x - o.x)) ** 2) / 2 AS area FROM f GROUP BY disc_id)""")
    return ",\n".join(parts)


@query(f"WITH {_sql_clips()} SELECT disc_id, coalesce(n_points, 0)::INT AS n_points, round(coalesce(CASE WHEN n_points >= 3 THEN area END, 0), 5) AS area FROM {{d}} d LEFT JOIN area USING (disc_id)")
def clipped_discs(spark: SparkSession, d: str) -> DataFrame:
    """What of each disc, as a ring of 16 points, lies in a box: the points and
    the area that six half spaces leave.  Discs are short rows of a small file
    that make much work, so they are dealt to all tasks."""
    rows = geom.with_disc_ring(graph.spread(discs(spark, d)), "ring", F.col("c"), F.col("n"), F.col("radius"), 16).select("disc_id", "ring")
    for c, at, s in WALLS:
        rows = geom.with_clipped_ring(rows, "ring", c, at, s)
    rows = geom.with_ring_area(rows, "area", "ring")
    return rows.select("disc_id", F.size("ring").alias("n_points"), F.round("area", 5).alias("area"))
