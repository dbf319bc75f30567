"""Diagnostics that compare tables of discs, traces and voxels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from . import graph, voxels


def share_labels(rows: DataFrame, seen: DataFrame, by: str, margin: float) -> DataFrame:
    """Shares of ``by`` among all rows and those seen, and whether those seen
    have more of it, less, or about as much."""
    total = lambda df: df.agg(F.count("*").alias("_total"))
    all_ = rows.groupBy(by).agg(F.count("*").alias("_n")).crossJoin(total(rows)).select(by, (F.col("_n") / F.col("_total")).alias("all_share"))
    some = seen.groupBy(by).agg(F.count("*").alias("_n")).crossJoin(total(seen)).select(by, (F.col("_n") / F.col("_total")).alias("seen_share"))
    both = all_.join(some, by, "left").withColumn("seen_share", F.coalesce("seen_share", F.lit(0.0)))
    more = F.col("seen_share") - F.col("all_share")
    return both.withColumn("label", F.when(more > margin, "over").when(more < -margin, "under").otherwise("balanced"))


def rotated(discs: DataFrame, turn: float) -> DataFrame:
    """Discs ``(c, n)`` turned about the vertical through their centroid."""
    middle = discs.agg(F.avg("c.x").alias("mx"), F.avg("c.y").alias("my"))
    cos, sin = math.cos(turn), math.sin(turn)
    x, y = F.col("c.x") - F.col("mx"), F.col("c.y") - F.col("my")
    center = vec.vec(F.col("mx") + x * cos - y * sin, F.col("my") + x * sin + y * cos, F.col("c.z"))
    normal = vec.vec(F.col("n.x") * cos - F.col("n.y") * sin, F.col("n.x") * sin + F.col("n.y") * cos, F.col("n.z"))
    return discs.crossJoin(F.broadcast(middle)).withColumns({"c": center, "n": normal}).drop("mx", "my")


def trace_loss(observed: DataFrame, simulated: DataFrame, length: str, cls: str) -> DataFrame:
    """Relative errors of total length, count and mean length, and the summed
    difference of censoring shares."""

    def sums(rows: DataFrame, name: str) -> DataFrame:
        shares = [F.avg((F.col(cls) == k).cast("double")).alias(f"{name}{k}") for k in range(3)]
        return rows.agg(F.count("*").alias(f"{name}_n"), F.sum(length).alias(f"{name}_sum"), F.avg(length).alias(f"{name}_mean"), *shares)

    one = sums(observed, "o").crossJoin(sums(simulated, "s"))
    part = lambda k: F.abs(F.col(f"o_{k}") - F.coalesce(F.col(f"s_{k}"), F.lit(0))) / F.col(f"o_{k}")
    gaps = sum((F.abs(F.col(f"o{k}") - F.coalesce(F.col(f"s{k}"), F.lit(0.0))) for k in range(3)), F.lit(0.0))
    return one.select(part("sum").alias("p21_error"), part("n").alias("count_error"), part("mean").alias("length_error"), gaps.alias("censoring_error"))


def lift(probability: DataFrame, actual: DataFrame, levels: list[float]) -> DataFrame:
    """Shares of the ``actual`` cells, and of all, at or above each level."""
    rows = probability.join(actual, voxels.CELL, "left").withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    at = (F.col("p") >= F.col("level") - 1e-9).cast("double")
    return rows.groupBy("level").agg(F.avg(F.when(F.col("actual"), at)).alias("actual_share"), F.avg(at).alias("all_share"))


def smoothed(field: DataFrame, value: str) -> DataFrame:
    """A sparse field spread by quarters to both neighbours, axis by axis."""
    for axis in voxels.CELL:
        spread = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in ((-1, 0.25), (0, 0.5), (1, 0.25))]))
        moved = field.withColumn("_s", spread).withColumn(axis, (F.col(axis) + F.col("_s.k")).cast("int"))
        field = moved.groupBy(*voxels.CELL).agg(F.sum(F.col(value) * F.col("_s.w")).alias(value))
    return field


def masked_blocks(cells: DataFrame, by: str, *keep: Column) -> DataFrame:
    """``component, n_voxels`` of the face-connected blocks of ``cells`` that
    all aggregates in ``keep`` are true for."""
    cells = graph.cut_lineage(cells)
    found = cells.join(graph.components(cells, voxels.neighbour_edges(cells, by)), "id")
    tests = [k.alias(f"_k{i}") for i, k in enumerate(keep)]
    counted = found.groupBy("component").agg(F.count("*").alias("n_voxels"), *tests)
    for i in range(len(keep)):
        counted = counted.filter(f"_k{i}")
    return counted.select("component", "n_voxels")


def bounding_planes(cells: DataFrame, planes: DataFrame, off: Column, share: float, near: float, least: int) -> DataFrame:
    """``label, plane, side, n_near``: planes with at least ``share`` of a
    block on one side and ``least`` cells within ``near``.  ``planes`` has to
    be a small table: it goes to every task."""
    rows = cells.crossJoin(F.broadcast(planes)).withColumn("_off", off)
    over = F.avg((F.col("_off") > 0).cast("double"))
    found = rows.groupBy("label", "plane").agg(F.greatest(over, 1 - over).alias("side"), F.count_if(F.abs("_off") <= near).alias("n_near"))
    return found.filter((F.col("side") >= share) & (F.col("n_near") >= least))


def cut_edges(cells: DataFrame, discs: DataFrame, block: int = 4) -> DataFrame:
    """``ix, iy, iz, axis, disc_id`` for edges from cell centres ``(x, y, z)``
    one step along an axis that a disc cuts.  A disc is dealt to the blocks of
    ``block`` steps that its plane crosses within its radius, so cells meet the
    discs near them only."""
    plain = [F.col(f"{v}.{c}").alias(f"_{v}{c}") for v in ("c", "n") for c in "xyz"]
    dealt = graph.spread(discs.select("disc_id", "radius", *plain), "disc_id")
    for c in "xyz":
        ends = [F.floor((F.col(f"_c{c}") + k * (F.col("radius") + 1)) / block) for k in (-1, 1)]
        dealt = dealt.withColumn(f"b{c}", F.explode(F.sequence(*ends)))
    middle = {c: (F.col(f"b{c}") + 0.5) * block - F.col(f"_c{c}") for c in "xyz"}
    off, far, wide = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        off, far, wide = off + middle[c] * F.col(f"_n{c}"), far + middle[c] * middle[c], wide + F.abs(F.col(f"_n{c}"))
    dealt = dealt.filter((F.abs(off) <= wide * (block / 2) + 1.001) & (F.sqrt(far) <= F.col("radius") + block * math.sqrt(3) / 2 + 1))
    rows = graph.join_dealt(cells.select("*", *[F.floor(F.col(c) / block).alias(f"b{c}") for c in "xyz"]), dealt, ["bx", "by", "bz"])
    at = {c: F.col(c) - F.col(f"_c{c}") for c in "xyz"}
    # a step can't cross a plane that is farther than the normal's longest part
    rows = rows.withColumn("_a", at["x"] * F.col("_nx") + at["y"] * F.col("_ny") + at["z"] * F.col("_nz"))
    rows = rows.filter(F.abs("_a") <= F.greatest(*[F.abs(f"_n{c}") for c in "xyz"]))
    rows = rows.withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = rows.withColumn("_b", F.col("_a") + F.element_at(F.array("_nx", "_ny", "_nz"), F.col("axis") + 1)).filter(F.col("_a") * F.col("_b") < 0)
    s = F.col("_a") / (F.col("_a") - F.col("_b"))
    hit = vec.vec(*[at[c] + F.when(F.col("axis") == i, s).otherwise(0.0) for i, c in enumerate("xyz")])
    return rows.filter(vec.norm(hit) <= F.col("radius")).select("ix", "iy", "iz", "axis", "disc_id")


def three_point_normal(rows: DataFrame, polyline: str, least: float = 0.005) -> DataFrame:
    """``rows`` with ``quality, reason, normal``: the normal of the plane
    through a polyline's ends and its vertex farthest from the line between
    them; quality is that distance as a share of the line's length."""
    v = F.col(polyline)
    rows = rows.withColumn("_p", F.element_at(v, 1)).withColumn("_q", vec.sub(F.element_at(v, -1), F.element_at(v, 1)))
    rows = rows.withColumn("_size", vec.norm(F.col("_q"))).withColumn("_q", vec.normalize(F.col("_q")))
    far = F.transform(v, lambda x: F.struct(vec.norm(vec.cross(vec.sub(x, F.col("_p")), F.col("_q"))).alias("off"), vec.sub(x, F.col("_p")).alias("to")))
    first = F.aggregate(far, F.element_at(far, 1), lambda best, x: F.when(x["off"] > best["off"], x).otherwise(best))
    rows = rows.withColumn("_far", first)
    size = F.col("_size")
    quality = F.coalesce(F.try_divide(F.col("_far.off"), size), F.lit(0.0))
    reason = (
        F.when(F.size(v) < 3, "not_enough_points").when(size < 1e-12, "zero_chord_length").when(quality < 1e-12, "collinear_points")
        .when(quality < least, "low_noncollinearity").otherwise("ok")
    )
    normal = F.when(reason.isin("ok", "low_noncollinearity"), vec.normalize(vec.cross(F.col("_q"), F.col("_far.to"))))
    return rows.withColumns({"quality": F.when(reason.isin("not_enough_points", "zero_chord_length"), 0.0).otherwise(quality), "reason": reason, "normal": normal}).drop("_p", "_q", "_size", "_far")


def posterior_radius(rows: DataFrame, half: str, draw: str, exponent: float, least: float, most: float, steps: int) -> DataFrame:
    """``rows`` with ``radius``, drawn from its posterior given a half chord at
    the quantile ``draw``: with ``r = half * cosh(u)`` the density is ``r **
    -(exponent + 1)``, tabulated at ``steps`` steps of u, summed and inverted."""
    a = F.col(half)
    low = F.greatest(a, F.lit(least))
    rows = rows.withColumn("_u0", F.when(low > a, F.acosh(low / a)).otherwise(0.0)).withColumn("_u1", F.acosh(F.greatest(F.lit(most) / a, F.lit(1.0))))
    node = lambda i: F.col("_u0") + (F.col("_u1") - F.col("_u0")) * i / steps
    weights = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.pow(a * F.cosh(node(i)), F.lit(-(exponent + 1))))
    rows = rows.withColumn("_w", weights)
    rows = rows.withColumn("_aim", F.col(draw) * F.aggregate("_w", F.lit(0.0), lambda s, x: s + x))
    # how many nodes lie below the quantile, and the sum up to there
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def walk(s: Column, x: Column) -> Column:
        on = s["on"] & (s["sum"] + x <= F.col("_aim"))
        return F.struct(F.when(on, s["sum"] + x).otherwise(s["sum"]).alias("sum"), (s["n"] + on.cast("int")).alias("n"), on.alias("on"))

    rows = rows.withColumn("_at", F.aggregate("_w", start, walk))
    n, next_ = F.col("_at.n"), F.get("_w", F.col("_at.n"))
    u = F.when(n == 0, F.col("_u0")).when(n > steps, F.col("_u1")).otherwise(node(n - 1) + (F.col("_aim") - F.col("_at.sum")) / next_ * (node(n) - node(n - 1)))
    return rows.withColumn("radius", F.when(low >= most, low).otherwise(a * F.cosh(u))).drop("_u0", "_u1", "_w", "_aim", "_at")


def wall_traces(discs: DataFrame, walls: list[tuple[float, float, float, float]], low: float, high: float, least: float) -> DataFrame:
    """``disc_id, wall, length`` of the lines that discs leave on walls: an
    edge of an outline ``(ay, az, by, bz)`` drawn along x from ``low`` to
    ``high``.  Positions on a wall are x and the way along its edge."""
    table = [(k, a, b, math.hypot(c - a, d - b), (c - a) / math.hypot(c - a, d - b), (d - b) / math.hypot(c - a, d - b)) for k, (a, b, c, d) in enumerate(walls)]
    edges = discs.sparkSession.createDataFrame(table, "wall int, ay double, az double, size double, ey double, ez double")
    rows = discs.crossJoin(F.broadcast(edges))
    nd = F.col("n.y") * F.col("ey") + F.col("n.z") * F.col("ez")
    nm = F.col("n.z") * F.col("ey") - F.col("n.y") * F.col("ez")
    gap = (F.col("az") - F.col("c.z")) * F.col("ey") - (F.col("ay") - F.col("c.y")) * F.col("ez")
    rows = rows.withColumns({"_nd": nd, "_nm": nm, "_gap": gap, "_flat": F.hypot(F.col("n.x"), nd)})
    flat, gap = F.col("_flat"), F.col("_gap")
    rows = rows.filter((flat > 1e-9) & (F.abs(F.try_divide(gap, flat)) < F.col("radius")))
    along = (F.col("c.y") - F.col("ay")) * F.col("ey") + (F.col("c.z") - F.col("az")) * F.col("ez")
    shift = gap * F.col("_nm") / (flat * flat)
    rows = rows.withColumns({
        "_px": F.col("c.x") - shift * F.col("n.x"), "_ps": along - shift * F.col("_nd"), "_tx": F.col("_nd") / flat, "_ts": -F.col("n.x") / flat,
        "_half": F.sqrt(F.col("radius") * F.col("radius") - (gap / flat) * (gap / flat)),
    })
    begin, end, fits = -F.col("_half"), F.col("_half"), F.lit(True)
    for p, t, a, b in (("_px", "_tx", F.lit(low), F.lit(high)), ("_ps", "_ts", F.lit(0.0), F.col("size"))):
        steep = F.abs(t) > 1e-12
        first, second = F.try_divide(a - F.col(p), F.col(t)), F.try_divide(b - F.col(p), F.col(t))
        begin = F.greatest(begin, F.when(steep, F.least(first, second)).otherwise(-1e9))
        end = F.least(end, F.when(steep, F.greatest(first, second)).otherwise(1e9))
        fits = fits & (steep | F.col(p).between(a, b))
    rows = rows.withColumn("length", end - begin).withColumn("_fits", fits)
    return rows.filter(F.col("_fits") & (F.col("length") >= least)).select("disc_id", "wall", "length")
