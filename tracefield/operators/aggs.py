"""Conditional, weighted and grid aggregations over traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import dot
from . import windows


def trace_summary(traces: DataFrame, area: float) -> DataFrame:
    """Per set: counts by censoring class, conditional means and medians, total
    length and length per area.  A class that is absent has null statistics."""
    length = F.col("len")
    of = lambda c: F.when(F.col("cls") == c, length)
    return traces.groupBy("set_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("cls") == c).alias(f"n_class{c}") for c in range(3)],
        F.avg((F.col("cls") > 0).cast("double")).alias("censor_ratio"),
        F.avg(length).alias("mean_len"),
        *[F.avg(of(c)).alias(f"mean_class{c}") for c in range(3)],
        *[F.median(of(c)).alias(f"median_class{c}") for c in range(3)],
        F.sum(length).alias("sum_len"),
        (F.sum(length) / (area if area > 0 else F.lit(None).cast("double"))).alias("p21"),
    )


def log_bins(length: Column, low: float, high: Column, bins: int) -> Column:
    """Index of the logarithmic bin, from 0; values above go to the last bin,
    values below ``low`` are null."""
    at = F.floor((F.log(length) - F.log(F.lit(low))) / (F.log(high) - F.log(F.lit(low))) * bins)
    return F.when(length >= low, F.least(at, F.lit(bins - 1)).cast("int"))


def histogram2d(traces: DataFrame, low: float, bins: int, weight: Column) -> DataFrame:
    """Weight per set, length bin and censoring class, with empty cells as 0.
    The upper edge is the largest length, just above it."""
    top = traces.agg((F.max("len") * 1.000001).alias("top"))
    binned = (
        traces.crossJoin(F.broadcast(top))
        .withColumn("bin", log_bins(F.col("len"), low, F.col("top"), bins))
        .filter("bin IS NOT NULL")
        .groupBy("set_id", "bin", "cls")
        .agg(F.sum(weight).alias("weight"))
    )
    grid = (
        traces.select("set_id").distinct()
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(2))))
    )
    return grid.join(binned, ["set_id", "bin", "cls"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def to_probability(cells: DataFrame, weight: str = "weight", by: str = "set_id") -> DataFrame:
    """Weights as shares of their group; a group without weight is uniform."""
    group = Window.partitionBy(by)
    total = F.sum(weight).over(group)
    uniform = 1.0 / F.count("*").over(group)
    return cells.withColumn("p", F.when(total > 0, F.col(weight) / total).otherwise(uniform))


def log_likelihood(counts: Column, p: Column) -> Column:
    return F.sum(counts * F.log(F.greatest(p, F.lit(1e-12))))


def profile(grid: DataFrame, by: str, value: str, tie: str, width: float = 2.0) -> DataFrame:
    """The best grid point per group (the least of ties), the width of the
    points within ``width`` of it, and whether that reaches the grid's ends."""
    group = Window.partitionBy(by)
    best = F.max(value).over(group)
    near = F.col(value) >= best - width
    shown = grid.withColumn("best", best).withColumn("near", near)
    ranked = shown.withColumn("rank", F.row_number().over(group.orderBy(F.desc(value), F.asc(tie))))
    return ranked.groupBy(by).agg(
        F.max(F.when(F.col("rank") == 1, F.col(tie))).alias("argmax"),
        F.max("best").alias("max_value"),
        (F.max(F.when(F.col("near"), F.col(tie))) - F.min(F.when(F.col("near"), F.col(tie)))).alias("width"),
        (
            (F.min(F.when(F.col("near"), F.col(tie))) == F.min(tie)) | (F.max(F.when(F.col("near"), F.col(tie))) == F.max(tie))
        ).alias("at_edge"),
    )


def axial_reference(rows: DataFrame, by: str, order: str, axis: str = "n") -> DataFrame:
    """Axes flipped to the hemisphere of their group's first row by ``order``."""
    first = F.min_by(axis, order).over(Window.partitionBy(by))
    sign = F.when(dot(F.col(axis), F.col("reference")) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return rows.withColumn("reference", first).withColumn("sign", sign)


def axial_mean(rows: DataFrame, by: str, order: str, axis: str = "n", weight: Column | None = None) -> DataFrame:
    """Mean axis, resultant length and Fisher concentration per group, from
    axes flipped to the first row's hemisphere.  Fewer than two rows have no
    concentration."""
    w = weight if weight is not None else F.lit(1.0)
    n = F.col(axis)
    sums = axial_reference(rows, by, order, axis).groupBy(by).agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), *[F.sum(F.col("sign") * n[c] * w).alias(f"s{c}") for c in "xyz"]
    )
    size = F.sqrt(sum((F.col(f"s{c}") * F.col(f"s{c}") for c in "xyz"), F.lit(0.0)))
    out = sums.withColumn("size", size).withColumn("r_bar", F.col("size") / F.col("w"))
    r = F.col("r_bar")
    return out.select(
        by, "n", *[(F.col(f"s{c}") / F.col("size")).alias(f"m{c}") for c in "xyz"], "r_bar",
        F.when((F.col("n") >= 2) & (r < 1 - 1e-12), (3 * r - F.pow(r, F.lit(3.0))) / (1 - r * r)).alias("kappa"),
    )


def orientation_tensor(rows: DataFrame, by: str, axis: str = "n") -> DataFrame:
    """The six means of products of axes per group."""
    n = F.col(axis)
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(n[a] * n[b]).alias(f"t{a}{b}") for a, b in pairs])


def principal_axes(tensors: DataFrame, by: str) -> DataFrame:
    """Largest eigenvalue and its axis of each tensor, pointing down."""
    import numpy as np
    import pandas as pd

    def solve(frames):
        for f in frames:
            m = np.stack([f[[f"t{a}" for a in row]].to_numpy() for row in (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))], axis=1)
            values, vectors = np.linalg.eigh(m)
            top = vectors[:, :, 2]
            top = np.where(top[:, 2:3] > 0, -top, top)
            yield pd.DataFrame({by: f[by], "value": values[:, 2], "ex": top[:, 0], "ey": top[:, 1], "ez": top[:, 2]})

    kind = tensors.schema[by].dataType.simpleString()
    return tensors.mapInPandas(solve, f"{by} {kind}, value double, ex double, ey double, ez double")


def pair_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Pair precision, recall and F1 of a clustering from its contingency
    counts; no pair is formed."""
    pairs = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    total = lambda df: df.agg(F.sum(pairs(F.col("n"))).alias("pairs"))
    both = total(cells).withColumnRenamed("pairs", "both")
    true = total(cells.groupBy(truth).agg(F.sum("n").alias("n"))).withColumnRenamed("pairs", "true_pairs")
    pred = total(cells.groupBy(predicted).agg(F.sum("n").alias("n"))).withColumnRenamed("pairs", "pred_pairs")
    one = both.crossJoin(true).crossJoin(pred)
    p, r = F.try_divide("both", "pred_pairs"), F.try_divide("both", "true_pairs")
    return one.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * p * r, p + r))


def ks_statistic(rows: DataFrame, sample: str, value: str) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic of ``sample`` 0 and 1."""
    cells = rows.groupBy(value).agg(*[F.count_if(F.col(sample) == k).alias(f"n{k}") for k in (0, 1)])
    cells = windows.running(cells, [], [value], {f"up_to{k}": F.col(f"n{k}") for k in (0, 1)})
    cdf = [F.col(f"up_to{k}") / F.col(f"up_to{k}_total") for k in (0, 1)]
    return cells.select(F.abs(cdf[0] - cdf[1]).alias("gap")).agg(F.max("gap").alias("ks"))


def rank_average(rows: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank."""
    ranked = windows.running(rows, [by], [value], {name: F.lit(1)}, peers=True)
    ties = F.count("*").over(Window.partitionBy(by, value))
    return ranked.withColumn(name, F.col(name) - (ties - 1) / 2).drop(f"{name}_total", "_part")
