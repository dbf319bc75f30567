"""Clusters of directions: k-means by sums, and average linkage by joins."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from . import graph

#: Rows of centres that are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Space:
    """How points and centres ``p`` are compared and how a cluster's centre
    follows from ``sums`` over points ``p`` with their numbers ``n``.  ``center`` takes the table of sums by name and gives it
    with a column ``p``, null where there is none."""

    apart: Callable[[Column, Column], Column]
    sums: tuple[str, ...]
    center: Callable[[DataFrame], DataFrame]


def _plane_center(sums: DataFrame) -> DataFrame:
    return sums.withColumn("p", F.struct((F.col("sx") / F.col("n")).alias("x"), (F.col("sy") / F.col("n")).alias("y")))


def _square(a: Column, b: Column) -> Column:
    return (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])


#: Points of the plane by squared distance; centres are means.
PLANE = Space(_square, ("sum(n * p.x) AS sx", "sum(n * p.y) AS sy"), _plane_center)


def _axis_center(sums: DataFrame) -> DataFrame:
    return vec.with_axis(sums, "p", least=False).drop("p_value")


#: Axes by one minus the squared cosine of their angle; centres are principal
#: axes of the cluster's orientation tensor.
AXES = Space(
    lambda a, b: 1 - vec.dot(a, b) * vec.dot(a, b),
    tuple(f"sum(n * p.{c[0]} * p.{c[1]}) AS {c}" for c in vec.TENSOR),
    _axis_center,
)


def doubled(angle: Column) -> Column:
    """An undirected angle (radians) as a point of the circle."""
    return F.struct(F.cos(2 * angle).alias("x"), F.sin(2 * angle).alias("y"))


def _few(seeds: DataFrame, most: int) -> bool:
    """Whether centres of all groups, from their counted seeds, can go to every
    task."""
    return seeds.limit(BROADCAST_ROWS // most + 1).count() <= BROADCAST_ROWS // most


def _with_centers(points: DataFrame, centers: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Each point with its group's centres, as a list ``c`` of ``label, p``:
    a row for each ``k`` there is."""
    lists = centers.groupBy(*keys, "k").agg(F.sort_array(F.collect_list(F.struct("label", F.col("p").alias("p")))).alias("c"))
    return points.join(F.broadcast(lists) if few else lists, keys)


def _nearest(space: Space, most: int) -> Column:
    """The nearest of up to ``most`` centres to nine digits (the first of ties)
    as ``near, label, d``.  Written out, for Spark compiles no lambdas."""

    def option(c: Column) -> Column:
        d = space.apart(F.col("p"), c["p"])
        return F.when(c.isNotNull(), F.struct(F.round(d, 9).alias("near"), c["label"].alias("label"), d.alias("d")))

    options = [option(F.get("c", F.lit(k))) for k in range(most)]
    return F.least(*options) if most > 1 else options[0]


def alike(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, p, id, n``: equal points of a group as one with their least id
    and their number, written once."""
    return graph.cut_lineage(points.groupBy(*keys, "p").agg(F.min("id").alias("id"), F.count("*").alias("n")))


def farthest_first(points: DataFrame, keys: list[str], most: int, space: Space) -> DataFrame:
    """Starting centres ``keys, label, p``: the point of the least ``id``, then
    again and again the point farthest from all before (to nine digits, ties to
    the least id).  One aggregation a centre; nothing is gathered."""
    first = points.groupBy(*keys).agg(F.min_by("p", "id").alias("p")).withColumn("label", F.lit(0))
    centers = graph.cut_lineage(first.select(*keys, "label", "p"))
    few = _few(centers, most)
    for label in range(1, most):
        near = _with_centers(points, centers.withColumn("k", F.lit(0)), keys, few).withColumn("d", F.round(_nearest(space, label)["d"], 9))
        far = near.groupBy(*keys).agg(F.max(F.struct("d", (-F.col("id")).alias("back"), "p")).alias("far"))
        found = far.select(*keys, F.lit(label).alias("label"), F.col("far.p").alias("p"))
        centers = graph.cut_lineage(centers.unionByName(found))
    return centers


def lloyd(points: DataFrame, keys: list[str], most: int, space: Space, rounds: int) -> tuple[DataFrame, DataFrame]:
    """K-means of ``points(keys, id, p)``, or of ``alike`` ones, in every group for every k from 1 to
    ``most``: centres ``keys, k, label, p``, and each point's ``label`` and
    distance ``d`` for each k.

    All groups and all k are one job a round: points meet their group's
    centres, equal points once, and only sums by cluster are shuffled, so a
    group may hold most rows.  It stops after ``rounds``, or once no centre moves.  A cluster that
    loses all points keeps its centre.
    """
    same = points if "n" in points.columns else alike(points, keys)
    seeds = farthest_first(same, keys, most, space)
    few = _few(seeds, most)
    ks = F.explode(F.sequence(F.lit(1), F.lit(most)))
    centers = seeds.withColumn("k", ks).filter("label < k")
    for _ in range(rounds):
        near = _with_centers(same, centers, keys, few).withColumn("label", _nearest(space, most)["label"])
        sums = near.groupBy(*keys, "k", "label").agg(F.sum("n").alias("n"), *map(F.expr, space.sums))
        moved = space.center(sums).select(*keys, "k", "label", F.col("p").alias("to"))
        after = centers.join(moved, [*keys, "k", "label"], "left").withColumn("to", F.coalesce("to", "p"))
        after = graph.cut_lineage(after.withColumn("moved", space.apart(F.col("p"), F.col("to")) > 1e-18))
        centers = after.select(*keys, "k", "label", F.col("to").alias("p"))
        if not after.filter("moved").limit(1).count():
            break
    return centers, labelled(points, centers, keys, most, space)


def labelled(points: DataFrame, centers: DataFrame, keys: list[str], most: int, space: Space) -> DataFrame:
    """``keys, id, k, label, d`` of ``points`` by the nearest of ``centers``, and
    ``p`` and ``n`` of those that are ``alike``."""
    few = centers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    near = _with_centers(points, centers, keys, few).withColumn("b", _nearest(space, most))
    number = ["p", "n"] if "n" in points.columns else []
    return near.select(*keys, "id", "k", F.col("b.label").alias("label"), F.col("b.d").alias("d"), *number)


def of_alike(points: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with the ``k, label`` of the ``alike`` ones: equal points are
    looked up, not measured again."""
    return graph.join_dealt(labels.select(*keys, "p", "k", "label"), points, [*keys, "p"]).select(*keys, "id", "k", "label")


def _number(labels: DataFrame) -> Column:
    """How many points a row of ``labels`` stands for."""
    return F.col("n") if "n" in labels.columns else F.lit(1).cast("long")


def gaussian_models(labels: DataFrame, keys: list[str], parts: int = 2, per_set: int = 5) -> DataFrame:
    """``keys, k, n, rss, bic`` per group and k, of spherical normal clusters
    with one variance in ``parts`` dimensions; a group of n points is tried with
    at most n / ``per_set`` clusters, or one."""
    number = _number(labels)
    found = labels.groupBy(*keys, "k").agg(F.sum(number).alias("n"), F.sum(F.col("d") * number).alias("rss"))
    found = found.filter((F.col("k") == 1) | (F.col("k") * per_set <= F.col("n")))
    n, k = F.col("n"), F.col("k")
    variance = F.greatest(F.col("rss") / (n * parts + 1e-9), F.lit(1e-9))
    free = k * parts + (k - 1)
    bic = F.log(n) * free + n * parts * (F.log(2 * math.pi * variance) + 1)
    return found.withColumn("bic", F.when(n > k, bic).otherwise(F.lit(math.inf)))


def axial_models(labels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, k, n, bic`` per group and k: the logarithms of the cosines to the
    cluster's axis, weighted by its Fisher concentration (at most 100), against
    four parameters a cluster."""
    cosine, number = F.sqrt(F.greatest(1 - F.col("d"), F.lit(0.0))), _number(labels)
    each = labels.groupBy(*keys, "k", "label").agg(
        F.sum(number).alias("n"), F.sum(cosine * number).alias("r"), F.sum(F.log(F.greatest(cosine, F.lit(1e-12))) * number).alias("fit")
    )
    mean = F.col("r") / F.col("n")
    kappa = F.when(mean < 1 - 1e-12, F.least(F.lit(100.0), (3 * mean - mean * mean * mean) / (1 - mean * mean))).otherwise(100.0)
    found = each.withColumn("kappa", kappa).groupBy(*keys, "k").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") >= 2, F.col("fit") * F.col("kappa")).otherwise(0.0)).alias("fit"))
    bic = 4 * F.col("k") * F.log("n") - 2 * F.col("fit")
    return found.withColumn("bic", F.when(F.col("n") > F.col("k"), bic).otherwise(F.lit(1e10))).drop("fit")


def best_model(models: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, k`` of the least ``bic``, to nine digits, the first of ties."""
    return models.groupBy(*keys).agg(F.min(F.struct(F.round("bic", 9).alias("bic"), "k")).alias("b")).select(*keys, F.col("b.k").alias("k"))


def linkage_cut(units: DataFrame, cut: float, keys: list[str]) -> DataFrame:
    """``keys, id, cluster`` of ``units(keys, id, n)`` (``n`` a unit axis) by average
    linkage of their axial angles, cut at ``cut`` degrees; a cluster is called
    by its least id.

    In a round all pairs of clusters that are each other's nearest, and no
    farther than the cut, merge.  Average linkage never brings a merged cluster
    nearer to a third than its parts were, so such merges are those of merging
    one pair at a time.  The distance of merged clusters is the mean over their
    parts' pairs, which are summed by a join on the new names.  Distances are
    compared to nine digits, ties by the smaller ids.

    Average linkage needs the angles of all pairs of a group's units: units are
    means of many rows, such as a set on a face, and not rows.
    """
    a = units.select(*keys, F.col("id").alias("a"), F.col("n").alias("na"))
    b = units.select(*keys, F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, keys) if keys else a.crossJoin(b)
    angle = vec.axial_angle(F.col("na"), F.col("nb"))
    links = graph.cut_lineage(pairs.filter("a != b").select(*keys, "a", "b", angle.alias("total"), F.lit(1).cast("long").alias("m")))
    names = graph.cut_lineage(units.select(*keys, "id", F.col("id").alias("cluster")))
    while True:
        mean = F.round(F.col("total") / F.col("m"), 9)
        order = F.struct(mean.alias("d"), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        nearest = links.withColumn("o", order).groupBy(*keys, "a").agg(F.min("o").alias("o")).filter(F.col("o.d") <= cut)
        # both ends of a pair have it as their nearest
        merges = nearest.groupBy(*keys, F.col("o.low").alias("low"), F.col("o.high").alias("high")).agg(F.count("*").alias("ends")).filter("ends = 2")
        merges = graph.cut_lineage(merges.select(*keys, F.col("high").alias("old"), F.col("low").alias("new")))
        if not merges.limit(1).count():
            return names

        def renamed(rows: DataFrame, name: str) -> DataFrame:
            moved = merges.select(*keys, F.col("old").alias(name), "new")
            return rows.join(moved, [*keys, name], "left").withColumn(name, F.coalesce("new", name)).drop("new")

        names = graph.cut_lineage(renamed(names, "cluster"))
        joined = renamed(renamed(links, "a"), "b").filter("a != b")
        links = graph.cut_lineage(joined.groupBy(*keys, "a", "b").agg(F.sum("total").alias("total"), F.sum("m").alias("m")))


def numbered(names: DataFrame) -> DataFrame:
    """``names(id, cluster, n_traces)`` with ``set_number``: clusters by falling
    number of traces, ties by name.  Ranked over the clusters, which are few."""
    sizes = names.groupBy("cluster").agg(F.sum("n_traces").alias("total"))
    ranks = sizes.withColumn("set_number", F.row_number().over(Window.orderBy(F.desc("total"), "cluster"))).drop("total")
    return names.join(ranks, "cluster")
