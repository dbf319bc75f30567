"""Vectors as ``struct<x,y,z>`` columns, and orientation conventions.

Three trend/plunge conventions are in use for the same words, so each function
names its own.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def cosine(x: pd.Series) -> pd.Series:
    """The C library's cosine, which SQL engines use too: Java's differs in the
    last digit for one number in 500, and a line that only touches a corner or
    a rim then falls on the other side."""
    return x.map(lambda v: math.cos(v) if math.isfinite(v) else math.nan).astype("float64")


@F.pandas_udf(DoubleType())
def sine(x: pd.Series) -> pd.Series:
    """The C library's sine (see ``cosine``)."""
    return x.map(lambda v: math.sin(v) if math.isfinite(v) else math.nan).astype("float64")


def vec(x: Column | float, y: Column | float, z: Column | float) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lift(x).cast("double").alias("x"), lift(y).cast("double").alias("y"), lift(z).cast("double").alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scale(a: Column, s: Column | float) -> Column:
    return vec(a["x"] * s, a["y"] * s, a["z"] * s)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """The unit vector, or null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, vec(a["x"] / n, a["y"] / n, a["z"] / n))


def axial_angle(a: Column, b: Column) -> Column:
    """Degrees between two undirected unit axes, 0 to 90."""
    return F.degrees(F.acos(F.least(F.abs(dot(a, b)), F.lit(1.0))))


def axis_generator(trend: Column, plunge: Column) -> Column:
    """Generator convention: x = cos P sin T, y = cos P cos T, z = -sin P."""
    t, p = F.radians(trend), F.radians(plunge)
    return vec(F.cos(p) * F.sin(t), F.cos(p) * F.cos(t), -F.sin(p))


def axis_likelihood(trend: Column, plunge: Column) -> Column:
    """Likelihood convention: x = cos P cos T, y = cos P sin T, z = -sin P."""
    t, p = F.radians(trend), F.radians(plunge)
    return vec(F.cos(p) * F.cos(t), F.cos(p) * F.sin(t), -F.sin(p))


def trend_likelihood(n: Column) -> Column:
    """Trend of the downward end in the likelihood convention, 0 to 360."""
    s = F.when(n["z"] > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.pmod(F.degrees(F.atan2(n["y"] * s, n["x"] * s)), F.lit(360.0))


def plunge_likelihood(n: Column) -> Column:
    return F.degrees(F.asin(F.least(F.abs(n["z"]), F.lit(1.0))))


def trend_ned(n: Column) -> Column:
    """Lower-hemisphere trend with north = -y, east = -x, down = z."""
    s = F.when(n["z"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.pmod(F.degrees(F.atan2(-n["x"] * s, -n["y"] * s)), F.lit(360.0))


def dip(n: Column) -> Column:
    """Dip of the plane with normal ``n``, degrees from horizontal."""
    return F.degrees(F.acos(F.least(F.abs(n["z"]), F.lit(1.0))))


def dip_direction(n: Column) -> Column:
    s = F.when(n["z"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.pmod(F.degrees(F.atan2(n["x"] * s, n["y"] * s)), F.lit(360.0))


def rotate(a: Column, m: list[list[float]]) -> Column:
    """Row vector times matrix: ``a @ m``."""
    return vec(*[a["x"] * m[0][k] + a["y"] * m[1][k] + a["z"] * m[2][k] for k in range(3)])


TENSOR = ("xx", "xy", "xz", "yy", "yz", "zz")


def with_axis(df: DataFrame, name: str, least: bool, tensor: tuple[str, ...] = TENSOR) -> DataFrame:
    """``df`` with the unit eigenvector ``name`` of the least or the greatest
    eigenvalue of a symmetric ``tensor`` of columns, and that value as
    ``name_value``.

    Both have a closed form: the value is a root of a cubic, and the vector is
    the longest cross product of two rows of what is left.  It is null where
    the value is not a single one; its sign is that of its first part that is
    not 0.
    """
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in tensor)
    t = lambda c: f"_{name}_{c}"
    df = df.withColumn(t("q"), (xx + yy + zz) / 3)
    q = F.col(t("q"))
    square = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    df = df.withColumn(t("p"), F.sqrt(square / 6))
    p = F.col(t("p"))
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))) / 3
    df = df.withColumn(f"{name}_value", F.when(p > 0, q + 2 * p * F.cos(turn + (2 * math.pi / 3 if least else 0.0))).otherwise(q))
    e = F.col(f"{name}_value")
    rows = [vec(xx - e, xy, xz), vec(xy, yy - e, yz), vec(xz, yz, zz - e)]
    df = df.withColumns({t(f"c{k}"): cross(rows[k], rows[(k + 1) % 3]) for k in range(3)})
    df = df.withColumns({t(f"n{k}"): dot(F.col(t(f"c{k}")), F.col(t(f"c{k}"))) for k in range(3)})
    sizes = [F.col(t(f"n{k}")) for k in range(3)]
    longest = F.when((sizes[0] >= sizes[1]) & (sizes[0] >= sizes[2]), F.col(t("c0"))).when(sizes[1] >= sizes[2], F.col(t("c1"))).otherwise(F.col(t("c2")))
    df = df.withColumn(t("v"), F.when(F.greatest(*sizes) > 1e-14 * F.pow(F.abs(3 * q), F.lit(4.0)), longest)).withColumn(t("u"), normalize(F.col(t("v"))))
    u = F.col(t("u"))
    back = F.when(u["x"] != 0, u["x"] < 0).when(u["y"] != 0, u["y"] < 0).otherwise(u["z"] < 0)
    df = df.withColumn(name, F.when(back, scale(u, -1.0)).otherwise(u))
    return df.drop(*[t(c) for c in ("q", "p", "c0", "c1", "c2", "n0", "n1", "n2", "v", "u")])


def sql_axis(source: str, name: str, least: bool) -> str:
    """SQL twin of ``with_axis`` for a relation with columns ``xx`` to ``zz``:
    adds ``{name}_value`` and ``{name}x``, ``{name}y``, ``{name}z``."""
    turn = " + 2 * pi() / 3" if least else ""
    det = "((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz))"
    return f"""(SELECT * EXCLUDE (q, p, e, c0x, c0y, c0z, c1x, c1y, c1z, c2x, c2y, c2z, n0, n1, n2, vx, vy, vz, s), e AS {name}_value, s * vx AS {name}x, s * vy AS {name}y, s * vz AS {name}z FROM (
SELECT *, CASE WHEN (CASE WHEN vx != 0 THEN vx < 0 WHEN vy != 0 THEN vy < 0 ELSE vz < 0 END) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END / sqrt(vx * vx + vy * vy + vz * vz) AS s FROM (
SELECT *, CASE WHEN greatest(n0, n1, n2) <= 1e-14::DOUBLE * pow(abs(3 * q), 4) THEN NULL WHEN n0 >= n1 AND n0 >= n2 THEN c0x WHEN n1 >= n2 THEN c1x ELSE c2x END AS vx,
  CASE WHEN n0 >= n1 AND n0 >= n2 THEN c0y WHEN n1 >= n2 THEN c1y ELSE c2y END AS vy, CASE WHEN n0 >= n1 AND n0 >= n2 THEN c0z WHEN n1 >= n2 THEN c1z ELSE c2z END AS vz FROM (
SELECT *, c0x * c0x + c0y * c0y + c0z * c0z AS n0, c1x * c1x + c1y * c1y + c1z * c1z AS n1, c2x * c2x + c2y * c2y + c2z * c2z AS n2 FROM (
SELECT *, xy * yz - xz * (yy - e) AS c0x, xz * xy - (xx - e) * yz AS c0y, (xx - e) * (yy - e) - xy * xy AS c0z, (yy - e) * (zz - e) - yz * yz AS c1x, yz * xz - xy * (zz - e) AS c1y,
  xy * yz - (yy - e) * xz AS c1z, yz * xz - (zz - e) * xy AS c2x, (zz - e) * (xx - e) - xz * xz AS c2y, xz * xy - yz * (xx - e) AS c2z FROM (
SELECT *, CASE WHEN p > 0 THEN q + 2 * p * cos(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {det} / (2 * p * p * p)))) / 3{turn}) ELSE q END AS e FROM (
SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM (
SELECT *, (xx + yy + zz) / 3 AS q FROM {source} t0) t1) t2) t3) t4) t5) t6) t7)"""
