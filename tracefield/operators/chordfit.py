"""Discs fitted to the chords that they leave on several faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec

STEPS, STAGES, MARGIN = 60, 3, 3.0


def ends_of(traces: DataFrame, *keep: str) -> DataFrame:
    """Both end points ``p`` of traces with middle ``x, y, z``, half length
    ``h`` and direction ``dy, dz`` in the face."""
    end = lambda s: vec.vec(F.col("x"), F.col("y") + s * F.col("h") * F.col("dy"), F.col("z") + s * F.col("h") * F.col("dz"))
    return traces.select(*keep, "x", F.explode(F.array(end(-1), end(1))).alias("p"))


def cluster_planes(traces: DataFrame) -> DataFrame:
    """``cluster, n_traces, center, normal`` of clusters of two traces or more:
    the plane through their ends, or where those lie on a line, the least
    trace's own normal."""
    p = F.col("p")
    moments = ends_of(traces, "cluster").groupBy("cluster").agg(
        (F.count("*") / 2).cast("long").alias("n_traces"), *[F.avg(p[c]).alias(f"c{c}") for c in "xyz"], *[F.avg(p[c[0]] * p[c[1]]).alias(c) for c in vec.TENSOR]
    )
    spread = moments.filter("n_traces >= 2").withColumns({c: F.col(c) - F.col(f"c{c[0]}") * F.col(f"c{c[1]}") for c in vec.TENSOR})
    found = vec.with_axis(spread, "axis", least=True)
    own = traces.groupBy("cluster").agg(F.min_by("n", "trace_id").alias("own"))
    planes = found.join(own, "cluster")
    flip = lambda n: F.when(n["x"] < 0, vec.scale(n, -1.0)).otherwise(n)
    center = vec.vec(*[F.col(f"c{c}") for c in "xyz"])
    return planes.select("cluster", "n_traces", center.alias("center"), flip(F.coalesce("axis", "own")).alias("normal"))


def face_chords(traces: DataFrame, planes: DataFrame) -> DataFrame:
    """Each cluster's chord on each face, in its plane: ``h`` is how far up the
    plane the face cuts it, ``a`` the half length and ``u`` the middle along
    the cut.  Fragments on one face are one chord, from end to end."""
    n = F.col("normal")
    placed = ends_of(traces, "cluster").join(planes, "cluster").withColumn("flat", F.sqrt(F.greatest(1 - n["x"] * n["x"], F.lit(0.0)))).filter("flat >= 1e-6")
    # the direction of all cuts is the normal's cross product with the axis
    along = ((F.col("p.y") - F.col("center.y")) * n["z"] - (F.col("p.z") - F.col("center.z")) * n["y"]) / F.hypot(n["y"], n["z"])
    reach = placed.withColumn("along", along).groupBy("cluster", F.round("x", 3).alias("face"))
    chords = reach.agg(F.min("along").alias("low"), F.max("along").alias("high"), F.min("x").alias("x"), *[F.first(c).alias(c) for c in ("n_traces", "center", "normal", "flat")])
    return chords.select(
        "cluster", "n_traces", "center", "normal", "flat", ((F.col("x") - F.col("center.x")) / F.col("flat")).alias("h"),
        ((F.col("high") - F.col("low")) / 2).alias("a"), ((F.col("high") + F.col("low")) / 2).alias("u"),
    )


def chord_fit(traces: DataFrame) -> DataFrame:
    """Disc per cluster that is seen on two faces or more: ``cluster, n_traces,
    n_faces, c, n, radius, loss``.

    The chords of a disc are parallel, so its centre along them is the mean of
    their middles.  Across them it is searched: the radius that suits a position
    follows from sums, and the position is the one whose chords differ least
    from those seen, on a grid that is refined around the winner twice.  A
    cluster's chords, one a face, are one row, so all stages are expressions
    over that row and need no shuffle of their own.

    Traces are rows ``trace_id, cluster, x, y, z, n, h, dy, dz``; clusters on
    one face or parallel to the faces have no fit.
    """
    chords = face_chords(traces, cluster_planes(traces))
    fits = chords.groupBy("cluster").agg(
        *[F.first(c).alias(c) for c in ("n_traces", "center", "normal", "flat")], F.avg("u").alias("p"), F.avg("h").alias("mh"), F.avg(F.col("h") * F.col("h") + F.col("a") * F.col("a")).alias("ms"),
        F.count("*").alias("n_faces"), (F.min("h") - MARGIN).alias("low"), (F.max("h") + MARGIN).alias("high"), F.sort_array(F.collect_list(F.struct("h", "a"))).alias("chords"),
    ).filter("n_faces >= 2")

    def square(q: Column) -> Column:
        return F.col("ms") - 2 * q * F.col("mh") + q * q

    def loss(q: Column) -> Column:
        miss = lambda c: F.sqrt(F.greatest(square(q) - (c["h"] - q) * (c["h"] - q), F.lit(0.0))) - c["a"]
        return F.aggregate("chords", F.lit(0.0), lambda total, c: total + miss(c) * miss(c))

    for k in range(STAGES):
        low, high = F.col("low"), F.col("high")
        grid = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: low + (high - low) * i / STEPS)
        fits = fits.withColumn("grid", grid).withColumn("now", F.array_min(F.transform("grid", lambda q: F.struct(loss(q).alias("loss"), q.alias("q")))))
        better = F.col("now") if k == 0 else F.when(F.col("now.loss") < F.col("best.loss"), F.col("now")).otherwise(F.col("best"))
        fits = fits.withColumn("best", better).withColumn("span", (high - low) / STEPS)
        fits = fits.withColumn("low", F.col("best.q") - F.col("span")).withColumn("high", F.col("best.q") + F.col("span"))
    n, c, p, q = (F.col(x) for x in ("normal", "center", "p", "best.q"))
    flat = F.col("flat")
    center = vec.vec(c["x"] + q * flat, c["y"] + p * n["z"] / flat - q * n["x"] * n["y"] / flat, c["z"] - p * n["y"] / flat - q * n["x"] * n["z"] / flat)
    return fits.select("cluster", "n_traces", "n_faces", center.alias("c"), n.alias("n"), F.sqrt(square(q)).alias("radius"), F.col("best.loss").alias("loss"))
