"""Voxel sets as sparse rows ``(run, ix, iy, iz)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

CELL = ["ix", "iy", "iz"]


def hit_probability(voxels: DataFrame, runs: int) -> DataFrame:
    """Share of all runs that have each voxel."""
    return voxels.groupBy(*CELL).agg((F.countDistinct("run") / runs).alias("p"))


def volume_above(probability: DataFrame, levels: list[float], size: float) -> DataFrame:
    """Volume per slab ``ix`` of the voxels at or above each level."""
    cells = [F.count_if(F.col("p") >= t).alias(f"n{k}") for k, t in enumerate(levels)]
    counted = probability.groupBy("ix").agg(*cells)
    return counted.select("ix", *[(F.col(f"n{k}") * size**3).alias(f"v{k}") for k in range(len(levels))])


def jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlap of two voxel sets."""
    a, b = (x.select(*CELL).distinct().withColumn(c, F.lit(1)) for x, c in ((left, "a"), (right, "b")))
    both = a.join(b, CELL, "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count("*").alias("any")).withColumn(
        "jaccard", F.try_divide("both", "any")
    )


def neighbour_edges(voxels: DataFrame, by: str) -> DataFrame:
    """Pairs ``a, b`` of voxel ids that share a face, within ``by``; each once."""
    steps = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    move = F.explode(F.array(*[F.struct(*[(F.col(c) + s).alias(c) for c, s in zip(CELL, step)]) for step in steps]))
    ahead = voxels.select(F.col("id").alias("a"), by, move.alias("q")).select("a", by, "q.*")
    return ahead.join(voxels.select(F.col("id").alias("b"), by, *CELL), [by, *CELL]).select("a", "b")


def interface_area(voxels: DataFrame, size: float) -> DataFrame:
    """Area between each pair of different labels, from voxels ``(label, ix,
    iy, iz)``."""
    ahead = F.explode(F.array(*[F.struct(*[(F.col(c) + int(c == d)).alias(c) for c in CELL]) for d in CELL]))
    left = voxels.select(F.col("label").alias("a"), ahead.alias("q")).select("a", "q.*")
    pairs = left.join(voxels.select(F.col("label").alias("b"), *CELL), CELL).filter("a != b")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.count("*") * size**2).alias("area"))


def block_stats(voxels: DataFrame, by: str, size: float) -> DataFrame:
    """Volume and centroid per block."""
    return voxels.groupBy(by).agg(
        F.count("*").alias("n_voxels"), (F.count("*") * size**3).alias("volume"), *[(F.avg(F.col(c) + 0.5) * size).alias(f"c{c[1]}") for c in CELL]
    )


def squared_distances(cells: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """``ix, iy, iz, d2`` for every cell of a ``box`` (first and last index by
    axis): the exact square of the distance, in cells, to the nearest of
    ``cells``, which may lie outside.  No rows if there are none.

    Squares of distances add up over axes, so one axis is done after the other:
    a row of cells is a group, which holds at most as many as the axis has, and
    each place takes the least of the squares from there.
    """
    found = cells.select(*CELL).distinct().withColumn("d2", F.lit(0).cast("long"))
    for axis in CELL:
        others = [c for c in CELL if c != axis]
        lines = found.groupBy(*others).agg(F.collect_list(F.struct(F.col(axis).alias("at"), "d2")).alias("line"))
        place = F.explode(F.sequence(*map(F.lit, box[axis]))).alias(axis)
        step = lambda e: F.col(axis) - e["at"]  # noqa: E731, B023
        found = lines.select(*others, "line", place).select(*others, axis, F.array_min(F.transform("line", lambda e: step(e) * step(e) + e["d2"])).alias("d2"))
    return found.select(*CELL, "d2")


def plane_owners(centres: DataFrame, discs: DataFrame, tolerance: float, block: float) -> DataFrame:
    """``ix, iy, iz, owner, off`` of cells with centre ``p`` within
    ``tolerance`` of a disc's plane and, in it, its radius: the disc of the
    least distance (``off``), the least id of ties.

    A disc is dealt to the cubes of side ``block`` that come so near its plane
    within its reach, so a cell meets only the discs that pass its cube; each
    task takes the least of its own discs before any shuffle.
    """
    plain = [F.col(f"{v}.{c}").alias(f"_{v}{c}") for v in ("c", "n") for c in "xyz"]
    dealt = graph.spread(discs.select("disc_id", "radius", *plain), "disc_id")
    for c in "xyz":
        reach = F.col("radius") + tolerance
        cubes = F.sequence(*[F.floor((F.col(f"_c{c}") + s * reach) / block) for s in (-1, 1)])
        dealt = dealt.withColumn(f"_{c}", F.explode(cubes))
    total = lambda parts: parts[0] + parts[1] + parts[2]
    middle = total([((F.col(f"_{c}") + 0.5) * block - F.col(f"_c{c}")) * F.col(f"_n{c}") for c in "xyz"])
    dealt = dealt.filter(F.abs(middle) <= total([F.abs(F.col(f"_n{c}")) for c in "xyz"]) * (block / 2) + tolerance)
    cells = centres.select(*CELL, *[F.col(f"p.{c}").alias(f"_p{c}") for c in "xyz"], *[F.floor(F.col(f"p.{c}") / block).alias(f"_{c}") for c in "xyz"])
    step = [F.col(f"_p{c}") - F.col(f"_c{c}") for c in "xyz"]
    pairs = graph.join_dealt(cells, dealt, ["_x", "_y", "_z"])
    pairs = pairs.withColumn("off", F.abs(total([x * F.col(f"_n{c}") for x, c in zip(step, "xyz")]))).filter(F.col("off") <= tolerance)
    hits = pairs.filter(total([x * x for x in step]) - F.col("off") * F.col("off") <= F.col("radius") * F.col("radius"))
    return hits.groupBy(*CELL).agg(F.min(F.struct("off", F.col("disc_id").alias("owner"))).alias("m")).select(*CELL, "m.owner", "m.off")


def outline_mask(places: DataFrame, edges: DataFrame, halo: float) -> DataFrame:
    """``places(y, z, ...)`` with ``gap``, the distance to an outline of
    ``edges(ay, az, qy, qz)``, and ``mask``: tunnel inside by the even-odd rule,
    halo within ``halo`` outside, else rock.

    An outline is a ring of a few edges; each place meets all of them, and
    places are summed over them before any shuffle.
    """
    keys = places.columns
    y, z, ay, az, qy, qz = (F.col(c) for c in ("y", "z", "ay", "az", "qy", "qz"))
    crossed = F.when((az > z) != (qz > z), (y < F.try_divide((qy - ay) * (z - az), qz - az) + ay).cast("int")).otherwise(0)
    size = (qy - ay) * (qy - ay) + (qz - az) * (qz - az)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((y - ay) * (qy - ay) + (z - az) * (qz - az), size), F.lit(0.0))))
    gy, gz = y - ay - t * (qy - ay), z - az - t * (qz - az)
    met = places.crossJoin(F.broadcast(edges)).groupBy(*keys).agg((F.sum(crossed) % 2 == 1).alias("inside"), F.sqrt(F.min(gy * gy + gz * gz)).alias("gap"))
    mask: Column = F.when(F.col("inside"), "tunnel").when(F.col("gap") <= halo, "halo").otherwise("rock")
    return met.withColumn("mask", mask).drop("inside")
