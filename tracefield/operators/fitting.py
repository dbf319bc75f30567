"""Fits of size exponents: bin masses by quadrature, a window kernel from a
table of chords, and a likelihood that joins the two."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import aggs


def geometric_edges(low: float, high: float, bins: int) -> list[float]:
    return [low * (high / low) ** (k / bins) for k in range(bins + 1)]


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Index of the geometric bin, null outside ``[low, high)``."""
    at = F.floor(F.log(value / low) / math.log(high / low) * bins).cast("int")
    return F.when((value >= low) & (value < high) & (at < bins), at)


def chord_masses(spark: SparkSession, grid: list[float], low: float, high: float, bins: int, least: float, most: float, points: int = 5, steps: int = 100) -> DataFrame:
    """``(kr, j, mass)``: the mass of true chords in each geometric length bin
    for radii of density ``r ** -kr`` in ``[least, most]``.

    With ``r = l / 2 + t * t`` the chord density has no pole; both integrals
    are trapezoids, over ``steps`` in t and ``points`` in each bin.  The table
    has a fixed size: grid points times bins times nodes.
    """
    edges = geometric_edges(low, high, bins)
    nodes = spark.range(bins * points).select(F.floor(F.col("id") / points).cast("int").alias("j"), (F.col("id") % points).cast("int").alias("s"))
    begin, end = (F.element_at(F.array(*map(F.lit, edges)), F.col("j") + k) for k in (1, 2))
    length = lambda s: begin * F.pow(end / begin, s / (points - 1))
    s = F.col("s").cast("double")
    width = (length(F.least(s + 1, F.lit(points - 1.0))) - length(F.greatest(s - 1, F.lit(0.0)))) / 2
    nodes = nodes.select("j", length(s).alias("l"), width.alias("width")).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    half = F.col("l") / 2
    t0, t1 = F.sqrt(F.greatest(half, F.lit(least)) - half), F.sqrt(F.greatest(F.lit(most) - half, F.lit(0.0)))
    t = t0 + (t1 - t0) * F.col("u") / steps
    ends = F.when(F.col("u").isin(0, steps), 0.5).otherwise(1.0)
    r = half + F.col("t") * F.col("t")
    nodes = nodes.withColumn("t", t).withColumn("r", r).withColumn("w", F.col("width") * ends * (t1 - t0) / steps * F.col("l") / (2 * F.col("r") * F.sqrt(F.col("l") + F.col("t") * F.col("t"))))
    nodes = nodes.filter(F.greatest(half, F.lit(least)) < most)
    at = nodes.withColumn("kr", F.explode(F.array(*map(F.lit, grid))))
    return at.groupBy("kr", "j").agg(F.sum(F.col("w") * F.pow("r", -F.col("kr"))).alias("mass"))


def window_kernel(chords: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """``(j, i, cls, share)``: of chords ``(whole, visible, cls)`` in true bin
    ``j`` the share seen in visible bin ``i`` with censoring class ``cls``."""
    rows = chords.select(bin_of(F.col("whole"), low, high, bins).alias("j"), bin_of(F.col("visible"), low, high, bins).alias("i"), "cls").filter("j IS NOT NULL")
    all_ = rows.groupBy("j").agg(F.count("*").alias("n_j"))
    seen = rows.filter("i IS NOT NULL AND cls >= 0").groupBy("j", "i", "cls").agg(F.count("*").alias("n"))
    return seen.join(all_, "j").select("j", "i", "cls", (F.col("n") / F.col("n_j")).alias("share"))


def model_table(masses: DataFrame, kernel: DataFrame) -> DataFrame:
    """``(kr, i, cls, p)``: the kernel weighted by the masses, as shares."""
    joint = masses.join(kernel, "j").groupBy("kr", "i", "cls").agg(F.sum(F.col("mass") * F.col("share")).alias("weight"))
    return aggs.to_probability(joint, "weight", "kr").select("kr", "i", "cls", "p")


def likelihood(counts: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kr, ll``: log-likelihood of ``counts(keys, i, cls, n)``; cells
    that the model lacks have the least probability."""
    cells = model.select("kr").distinct().join(counts, F.lit(True)).join(model, ["kr", "i", "cls"], "left")
    return cells.groupBy(*keys, "kr").agg(aggs.log_likelihood(F.col("n"), F.coalesce("p", F.lit(0.0))).alias("ll"))


def best_exponent(likelihoods: DataFrame, keys: list[str]) -> DataFrame:
    """The grid point of the largest likelihood per group, the least of ties."""
    return likelihoods.groupBy(*keys).agg(F.min(F.struct((-F.col("ll")).alias("less"), "kr")).alias("m")).select(*keys, F.col("m.kr").alias("kr"), (-F.col("m.less")).alias("ll"))


def bootstrap_counts(rows: DataFrame, keys: list[str], id: str, draws: int) -> DataFrame:
    """``draw, keys, n``: counts of resampled rows.  A row's weight in a draw
    is Poisson(1), from a hash of both, so a row counts alike in a rerun and
    nothing is gathered; rows are summed per draw before any shuffle."""
    key = F.md5(F.concat_ws(":", F.col(id), F.col("draw")).cast("binary"))
    u = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    weight = F.lit(0)
    total, p = 0.0, math.exp(-1)
    # what is left beyond twelve has probability below 1e-10, less than a step of u
    for k in range(1, 13):
        total += p
        weight = weight + (u > total).cast("int")
        p /= k
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return drawn.groupBy("draw", *keys).agg(F.sum(weight).alias("n")).filter("n > 0")


def bootstrap_interval(best: DataFrame, by: str, ends: tuple[float, float]) -> DataFrame:
    """Mean, spread and 95 % interval of the draws' exponents, and the share of
    draws at the grid's ends."""
    return best.groupBy(by).agg(
        F.avg("kr").alias("mean"), F.stddev_pop("kr").alias("std"), F.percentile("kr", 0.025).alias("low"), F.percentile("kr", 0.975).alias("high"),
        F.avg((F.col("kr").isin(*ends)).cast("double")).alias("at_edge"),
    )


def mean_sine(spark: SparkSession, sets: DataFrame, nodes: int = 32, azimuths: int = 64) -> DataFrame:
    """``sets(set_id, mean_x, kappa)`` with ``calibration``: the mean sine of
    the angle between Fisher-distributed axes and the tunnel, by Gauss-Legendre
    nodes over the polar angle's distribution and even azimuths."""
    import numpy as np

    t, w = np.polynomial.legendre.leggauss(nodes)
    table = spark.createDataFrame([(float(0.5 * (a + 1)), float(0.5 * b)) for a, b in zip(t, w)], "t double, w double")
    turns = spark.range(azimuths).select((F.col("id") * (2 * math.pi / azimuths)).alias("psi"))
    rows = sets.crossJoin(F.broadcast(table)).crossJoin(F.broadcast(turns))
    u = F.when(F.col("kappa") > 1e-9, 1 + F.log(F.col("t") + (1 - F.col("t")) * F.exp(-2 * F.col("kappa"))) / F.col("kappa")).otherwise(2 * F.col("t") - 1)
    u = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u))
    cos_t = F.least(F.lit(1.0), F.abs("mean_x"))
    nx = cos_t * u + F.sqrt(1 - cos_t * cos_t) * F.sqrt(F.greatest(1 - u * u, F.lit(0.0))) * F.cos("psi")
    sine = F.sqrt(F.greatest(1 - nx * nx, F.lit(0.0)))
    return rows.groupBy(*sets.columns).agg((F.sum(F.col("w") * sine) / azimuths).alias("calibration"))


def discs_for_intensity(intensity: Column, volume: float, exponent: float, low: float, high: float) -> Column:
    """How many discs of a power-law radius give an area per volume."""
    moment = lambda k: math.log(high / low) if abs(k + 1 - exponent) < 1e-12 else (high ** (k + 1 - exponent) - low ** (k + 1 - exponent)) / (k + 1 - exponent)
    return intensity * volume / (math.pi * moment(2) / moment(0))


def concentration(resultant: Column) -> Column:
    """Fisher concentration of a resultant length."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1 - 1e-12), resultant))
    return (3 * r - r * r * r) / (1 - r * r)


def resultant(kappa: Column, steps: int = 60) -> Column:
    """The resultant length of a concentration, by bisection: each step is a
    fold over a fixed sequence, so it stays one expression."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(1 - 1e-12).alias("b"))

    def halve(x: Column, _: Column) -> Column:
        middle = (x["a"] + x["b"]) / 2
        low = concentration(middle) < kappa
        return F.struct(F.when(low, middle).otherwise(x["a"]).alias("a"), F.when(low, x["b"]).otherwise(middle).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda x: (x["a"] + x["b"]) / 2)
