"""Random discs from stored or hashed uniforms.

Draws are functions of ``(seed, id)``, so a lost partition is made again
alike and every chunk can be made on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom, vec
from . import graph


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def powerlaw_radius(u: Column, exponent: float, low: float, high: float) -> Column:
    """Inverse distribution of a density ``r ** -exponent`` on [low, high]."""
    if abs(exponent - 1) < 1e-12:
        return low * F.pow(F.lit(high / low), u)
    e = 1 - exponent
    return F.pow(F.lit(low**e) + u * (high**e - low**e), F.lit(1 / e))


def exponential_radius(u: Column, mean: float, low: float, high: float) -> Column:
    """Truncated exponential."""
    a, b = math.exp(-low / mean), math.exp(-high / mean)
    return -mean * F.log(F.lit(a) - u * (a - b))


def fisher_axis(u: Column, v: Column, kappa: float, trend: float, plunge: float) -> Column:
    """A Fisher-distributed axis about a mean direction, by inverse
    distribution and rotation."""
    c = 1 + F.log(u + (1 - u) * math.exp(-2 * kappa)) / kappa
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - c * c))
    t, p = math.radians(trend), math.radians(plunge)
    mean = (math.cos(p) * math.sin(t), math.cos(p) * math.cos(t), -math.sin(p))
    side = (math.cos(t), -math.sin(t), 0.0)
    third = (mean[1] * side[2] - mean[2] * side[1], mean[2] * side[0] - mean[0] * side[2], mean[0] * side[1] - mean[1] * side[0])
    x, y = s * F.cos(2 * math.pi * v), s * F.sin(2 * math.pi * v)
    return vec.vec(*[c * mean[k] + x * side[k] + y * third[k] for k in range(3)])


def discs(spark: SparkSession, n: int, seed: int, box: tuple[float, float, float], exponent: float, low: float, high: float, kappa: float, trend: float, plunge: float) -> DataFrame:
    """``n`` discs ``(disc_id, c, n, radius)`` with uniform centres in a box."""
    k = F.col("id")
    u = lambda name: uniform(seed, name, k)
    return spark.range(n).select(
        k.alias("disc_id"),
        vec.vec(*[(u(f"c{c}") - 0.5) * size for c, size in zip("xyz", box)]).alias("c"),
        fisher_axis(u("n1"), u("n2"), kappa, trend, plunge).alias("n"),
        powerlaw_radius(u("r"), exponent, low, high).alias("radius"),
    )


def bootstrap(rows: DataFrame, draws: int, seed: int, key: str) -> DataFrame:
    """Every row with a Poisson(1) weight per draw; rows of weight 0 go.
    Sums over ``draw`` are bootstrap replicates.  Weights above eighteen, of
    probability below 1e-17, are less than a step of the uniform."""
    rows = graph.spread(rows).withColumn("_key", F.col(key).cast("string"))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    # behind a generator, or else each step and the filter would hash again
    rows = geom.settled(rows, "_u", uniform(seed, "bootstrap", F.col("_key"), F.col("draw")))
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(18):
        total += p
        steps.append((F.col("_u") <= total, k))
        p /= k + 1
    weight = F.when(*steps[0])
    for step in steps[1:]:
        weight = weight.when(*step)
    return rows.withColumn("weight", weight.otherwise(18)).filter("weight > 0").drop("_key", "_u")
