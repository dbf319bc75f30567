"""Plane and disc geometry as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import cross, dot, normalize, sub, vec

Polygon = list[tuple[float, float]]


def _edges(polygon: Polygon) -> list[tuple[float, float, float, float]]:
    return [(*p, *q) for p, q in zip(polygon, polygon[1:] + polygon[:1])]


def signed_area(polygon: Polygon) -> float:
    """Shoelace area, positive if counter-clockwise."""
    return sum(a * d - c * b for a, b, c, d in _edges(polygon)) / 2


def counter_clockwise(polygon: Polygon) -> Polygon:
    return polygon if signed_area(polygon) >= 0 else polygon[::-1]


def inside_polygon(y: Column, z: Column, polygon: Polygon) -> Column:
    """Even-odd rule."""
    crossings = [
        F.when((F.lit(b) > z) != (F.lit(d) > z), (y < (c - a) * (z - b) / (d - b) + a).cast("int")).otherwise(0)
        for a, b, c, d in _edges(polygon)
        if b != d
    ]
    return reduce(lambda p, q: p + q, crossings) % 2 == 1


def distance_to_segment(y: Column, z: Column, a: float, b: float, c: float, d: float) -> Column:
    length = (c - a) ** 2 + (d - b) ** 2
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((y - a) * (c - a) + (z - b) * (d - b)) / (length or 1.0)))
    return F.hypot(y - (a + t * (c - a)), z - (b + t * (d - b)))


def distance_to_polygon(y: Column, z: Column, polygon: Polygon) -> Column:
    return F.least(*[distance_to_segment(y, z, *e) for e in _edges(polygon)])


def with_clip(df: DataFrame, ends: list[Column], polygon: Polygon, name: str = "clip") -> DataFrame:
    """Cyrus-Beck clip of segments ``ends = [y0, z0, y1, z1]`` to a convex
    polygon, as columns ``clip_t0, clip_t1, clip_length, clip_class``.

    Class is the number of ends cut off, -1 if nothing is left.  Edges are
    literals, so the clip needs no join; the two parameters are columns of
    their own first, so that each is computed once.
    """
    y0, z0, y1, z1 = ends
    # plain columns: fields of a struct would be computed anew at each use
    df = df.withColumns({"_y0": y0, "_z0": z0, "_dy": y1 - y0, "_dz": z1 - z0})
    dy, dz = F.col("_dy"), F.col("_dz")
    edges = _edges(counter_clockwise(polygon))
    # (ny, nz): inward unit normal of a counter-clockwise edge; those of a box
    # are exact, so a segment through its corner alone leaves nothing
    normals = [(-(d - b) / (math.hypot(c - a, d - b) or 1.0), (c - a) / (math.hypot(c - a, d - b) or 1.0)) for a, b, c, d in edges]
    steps = {f"_into{k}": dy * ny + dz * nz for k, (ny, nz) in enumerate(normals)}
    steps |= {f"_rest{k}": (F.col("_y0") - e[0]) * ny + (F.col("_z0") - e[1]) * nz for k, (e, (ny, nz)) in enumerate(zip(edges, normals))}
    df = df.withColumns(steps)
    into, rest = ([F.col(f"_{c}{k}") for k in range(len(edges))] for c in ("into", "rest"))
    cut = [F.try_divide(-r, i) for i, r in zip(into, rest)]
    enter = [F.lit(0.0), *[F.when(i > 0, t) for i, t in zip(into, cut)]]
    leave = [F.lit(1.0), *[F.when(i < 0, t) for i, t in zip(into, cut)]]
    away = reduce(lambda p, q: p | q, [(i == 0) & (r < 0) for i, r in zip(into, rest)])
    df = df.withColumns({"_t0": F.greatest(*enter), "_t1": F.least(*leave), "_away": away})
    df = df.withColumn("_gone", F.col("_away") | (F.col("_t0") >= F.col("_t1")))
    t0, t1, gone = F.col("_t0"), F.col("_t1"), F.col("_gone")
    cls = F.when(gone, -1).otherwise((t0 > 0).cast("int") + (t1 < 1).cast("int"))
    length = F.when(gone, F.lit(0.0)).otherwise((t1 - t0) * F.hypot(dy, dz))
    names = ["_y0", "_z0", "_dy", "_dz", *steps, "_t0", "_t1", "_away", "_gone"]
    return df.withColumns({f"{name}_t0": t0, f"{name}_t1": t1, f"{name}_length": length, f"{name}_class": cls}).drop(*names)


def box(ymin: float, zmin: float, ymax: float, zmax: float) -> Polygon:
    return [(ymin, zmin), (ymax, zmin), (ymax, zmax), (ymin, zmax)]


def crossing(a: tuple[Column, Column, Column, Column], b: tuple[float, float, float, float]) -> Column:
    """Parameter on segment ``a`` where it crosses segment ``b``, else null."""
    y0, z0, y1, z1 = a
    p, q, r, s = b
    dy, dz, ey, ez = y1 - y0, z1 - z0, r - p, s - q
    det = dy * ez - dz * ey
    t = F.try_divide((p - y0) * ez - (q - z0) * ey, det)
    u = F.try_divide((p - y0) * dz - (q - z0) * dy, det)
    return F.when(F.abs(det) > 1e-12, F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), t))


def with_chord(df: DataFrame, center: Column, normal: Column, radius: Column, face_x: Column) -> DataFrame:
    """Chords of discs on planes ``x = face_x``, as columns ``half, my, mz, dy,
    dz``; rows whose plane misses the disc or is parallel to it are dropped.

    The chord's middle is the centre moved in the disc's plane along the
    steepest line towards the face; its direction is normal to both planes.
    """
    df = df.withColumns({"_flat": F.sqrt(normal["y"] * normal["y"] + normal["z"] * normal["z"]), "_gap": face_x - center["x"]})
    flat, gap = F.col("_flat"), F.col("_gap")
    df = df.filter((flat > 1e-9) & (F.abs(F.try_divide(gap, flat)) < radius)).withColumn("_reach", gap / flat)
    # in-plane direction towards x: (flat, -nx ny / flat, -nx nz / flat)
    return df.withColumns({
        "half": F.sqrt(radius * radius - F.col("_reach") * F.col("_reach")),
        "my": center["y"] - gap * normal["x"] * normal["y"] / (flat * flat),
        "mz": center["z"] - gap * normal["x"] * normal["z"] / (flat * flat),
        "dy": -normal["z"] / flat,
        "dz": normal["y"] / flat,
    }).drop("_flat", "_gap", "_reach")


def segment_distance(p0: Column, p1: Column, q0: Column, q1: Column) -> Column:
    """Least distance between two segments in space, by clamped parameters."""
    u, v, w = sub(p1, p0), sub(q1, q0), sub(p0, q0)
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    det = a * c - b * b
    s = clamp(F.when(det > 1e-12, F.try_divide(b * e - c * d, det)).otherwise(F.lit(0.0)))
    t = clamp(F.coalesce(F.try_divide(b * s + e, c), F.lit(0.0)))
    s = clamp(F.coalesce(F.try_divide(b * t - d, a), F.lit(0.0)))
    gap = [w[k] + s * u[k] - t * v[k] for k in ("x", "y", "z")]
    return F.sqrt(reduce(lambda m, n: m + n, [g * g for g in gap]))


def endpoint_type(y: Column, z: Column, polygon: Polygon, tolerance: float) -> Column:
    return F.when(distance_to_polygon(y, z, polygon) <= tolerance, "tunnel_boundary").otherwise("disc_boundary")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once, however often later columns
    use it: projections are merged, but not across a generator."""
    return df.withColumn("_settled", F.explode(F.array(value))).drop(name).withColumnRenamed("_settled", name)


def with_disc_ring(df: DataFrame, name: str, center: Column, normal: Column, radius: Column, points: int) -> DataFrame:
    """``df`` with a disc's rim as an array of ``points`` points."""
    up = F.when(F.abs(normal["z"]) < 0.95, vec(0.0, 0.0, 1.0)).otherwise(vec(1.0, 0.0, 0.0))
    df = settled(settled(df, "_up", up), "_u", cross(F.col("_up"), normal))
    df = settled(settled(df, "_u", normalize(F.col("_u"))), "_v", cross(normal, F.col("_u")))
    turns = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k * (2 * math.pi / points))
    part = lambda t, c: center[c] + (F.col(f"_u.{c}") * (radius * F.cos(t)) + F.col(f"_v.{c}") * (radius * F.sin(t)))
    return settled(df, name, F.transform(turns, lambda t: vec(*[part(t, c) for c in "xyz"]))).drop("_up", "_u", "_v")


def with_clipped_ring(df: DataFrame, name: str, axis: str, at: float, sign: int) -> DataFrame:
    """``df`` with the part of the convex ring ``name`` where ``sign * (axis -
    at) >= 0``: each point inside stays, and each side that crosses gives its
    crossing."""
    ring = F.col(name)
    nexts = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    sides = F.transform(F.arrays_zip(ring.alias("p"), nexts.alias("q")), lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), ((e["p"][axis] - at) * sign).alias("a"), ((e["q"][axis] - at) * sign).alias("b")))
    df = settled(df, "_sides", sides)

    def kept(e: Column) -> Column:
        share = e["a"] / (e["a"] - e["b"])
        crossing = vec(*[e["p"][c] + (e["q"][c] - e["p"][c]) * share for c in "xyz"])
        return F.when((e["a"] >= 0) & (e["b"] < 0), F.array(e["p"], crossing)).when(e["a"] >= 0, F.array(e["p"])).when(e["b"] >= 0, F.array(crossing)).otherwise(F.slice(F.array(e["p"]), 1, 0))

    return settled(df, name, F.flatten(F.transform("_sides", kept))).drop("_sides")


def with_ring_area(df: DataFrame, name: str, ring: str) -> DataFrame:
    """``df`` with the area of a plane ring of points in space; 0 of fewer than
    three."""
    points, first = F.col(ring), F.get(F.col(ring), F.lit(0))
    steps = F.transform(points, lambda p: vec(*[p[c] - first[c] for c in "xyz"]))
    df = settled(df, "_steps", steps)
    before = F.concat(F.slice("_steps", 1, 1), F.slice("_steps", 1, F.greatest(F.size("_steps") - 1, F.lit(0))))
    df = settled(df, "_turns", F.transform(F.arrays_zip(before.alias("a"), F.col("_steps").alias("b")), lambda e: cross(e["a"], e["b"])))

    def summed(c: str) -> Column:
        return F.aggregate("_turns", F.lit(0.0), lambda s, e: s + e[c])

    total = [summed(c) for c in "xyz"]
    area = F.sqrt(sum((x * x for x in total), F.lit(0.0))) / 2
    return df.withColumn(name, F.when(F.size(ring) >= 3, area).otherwise(0.0)).drop("_steps", "_turns")
