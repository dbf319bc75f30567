"""Exponent fits, their bootstrap, and calibrations by quadrature."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggs, fitting, graph
from .join_queries import VISIBLE, clipped
from .registry import query, r6, read

LOW, HIGH, BINS = 0.9, 26.0, 10
LEAST, MOST = 0.25, 12.5
GRID = [0.25 * k for k in range(14)]
DRAWS = 25


def _chords(spark: SparkSession, d: str) -> DataFrame:
    """Checkpointed: filters on the clip would be pushed down with all of its
    expressions inlined."""
    return graph.cut_lineage(clipped(spark, d).select("disc_id", "face_id", "set_id", (2 * F.col("half")).alias("whole"), F.col("clip_length").alias("visible"), F.col("clip_class").alias("cls")))


def _model(spark: SparkSession, d: str) -> DataFrame:
    masses = fitting.chord_masses(spark, GRID, LOW, HIGH, BINS, LEAST, MOST)
    return fitting.model_table(masses, fitting.window_kernel(_chords(spark, d), LOW, HIGH, BINS))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Traces of five groups of sets with their length bin."""
    group = F.pmod(F.regexp_extract("set_id", "[0-9]+", 0).cast("int"), F.lit(5))
    rows = _chords(spark, d).filter("cls >= 0").select((F.col("disc_id") * 12 + F.col("face_id")).alias("trace_id"), group.alias("set_id"), fitting.bin_of(F.col("visible"), LOW, HIGH, BINS).alias("i"), "cls")
    return rows.filter("i IS NOT NULL")


def _sql_bin(x: str) -> str:
    return f"(CASE WHEN {x} >= {LOW} AND {x} < {HIGH} AND floor(ln({x} / {LOW}::DOUBLE) / {math.log(HIGH / LOW)}::DOUBLE * {BINS}) < {BINS} THEN floor(ln({x} / {LOW}::DOUBLE) / {math.log(HIGH / LOW)}::DOUBLE * {BINS})::INT END)"


_EDGES = "[" + ", ".join(f"{x}::DOUBLE" for x in fitting.geometric_edges(LOW, HIGH, BINS)) + "]"
MASSES = f"""g AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in GRID)}]) AS kr),
a AS (SELECT j, s, {_EDGES}[j + 1] AS b, {_EDGES}[j + 2] AS e FROM range({BINS}) x(j), range(5) y(s)),
l AS (SELECT j, b * pow(e / b, s / 4.0::DOUBLE) AS l, (b * pow(e / b, least(s + 1, 4) / 4.0::DOUBLE) - b * pow(e / b, greatest(s - 1, 0) / 4.0::DOUBLE)) / 2 AS width FROM a),
n AS (SELECT *, sqrt(greatest(l / 2, {LEAST}) - l / 2) AS t0, sqrt(greatest({MOST} - l / 2, 0)) AS t1 FROM l, range(101) z(u) WHERE greatest(l / 2, {LEAST}) < {MOST}),
t AS (SELECT *, t0 + (t1 - t0) * u / 100 AS t FROM n),
w AS (SELECT j, l / 2 + t * t AS r, width * (CASE WHEN u IN (0, 100) THEN 0.5 ELSE 1 END) * (t1 - t0) / 100 * l / (2 * (l / 2 + t * t) * sqrt(l + t * t)) AS w FROM t),
mass AS (SELECT kr, j, sum(w * pow(r, -kr)) AS mass FROM w, g GROUP BY kr, j)"""
KERNEL = f"""c AS (SELECT disc_id, face_id, set_id, {_sql_bin("(2 * half)")} AS j, {_sql_bin("vis")} AS i, vcls AS cls FROM {VISIBLE} v),
k AS (SELECT j, i, cls, count(*)::DOUBLE / (SELECT count(*) FROM c b WHERE b.j = c.j) AS share FROM c WHERE j IS NOT NULL AND i IS NOT NULL AND cls >= 0 GROUP BY j, i, cls),
y AS (SELECT kr, i, cls, sum(mass * share) AS weight FROM mass JOIN k USING (j) GROUP BY kr, i, cls),
model AS (SELECT kr, i, cls, weight / sum(weight) OVER (PARTITION BY kr) AS p FROM y),
cells AS (SELECT disc_id * 12 + face_id AS trace_id, regexp_extract(set_id, '[0-9]+')::INT % 5 AS set_id, i, cls FROM c WHERE i IS NOT NULL AND cls >= 0)"""


@query(f"WITH {MASSES} SELECT kr, j, round(mass, 8) AS mass FROM mass")
def chord_bin_masses(spark: SparkSession, d: str) -> DataFrame:
    return fitting.chord_masses(spark, GRID, LOW, HIGH, BINS, LEAST, MOST).select("kr", "j", F.round("mass", 8).alias("mass"))


@query(f"""
WITH {MASSES}, {KERNEL}, n AS (SELECT set_id, i, cls, count(*) AS n FROM cells GROUP BY ALL)
SELECT set_id, kr, round(sum(n * ln(greatest(coalesce(p, 0), 1e-12))), 4) AS ll FROM n CROSS JOIN g LEFT JOIN model USING (kr, i, cls) GROUP BY ALL
""".replace("n AS (SELECT *, sqrt", "nodes AS (SELECT *, sqrt").replace("u / 100 AS t FROM n)", "u / 100 AS t FROM nodes)"))
def exponent_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood of each exponent: masses and kernel meet once, then a
    weighted sum per grid point."""
    counts = _cells(spark, d).groupBy("set_id", "i", "cls").agg(F.count("*").alias("n"))
    return fitting.likelihood(counts, _model(spark, d), ["set_id"]).select("set_id", "kr", F.round("ll", 4).alias("ll"))


@query(f"""
WITH {MASSES}, {KERNEL}, n AS (SELECT set_id, i, cls, count(*) AS n FROM cells GROUP BY ALL),
q AS (SELECT set_id, kr, sum(n * ln(greatest(coalesce(p, 0), 1e-12))) AS ll FROM n CROSS JOIN g LEFT JOIN model USING (kr, i, cls) GROUP BY ALL),
x AS (SELECT *, max(ll) OVER (PARTITION BY set_id) AS best FROM q)
SELECT set_id, arg_min(kr, -ll) AS argmax, round(max(best), 4) AS max_value, max(kr) FILTER (ll >= best - 2) - min(kr) FILTER (ll >= best - 2) AS width,
  (min(kr) FILTER (ll >= best - 2) = min(kr) OR max(kr) FILTER (ll >= best - 2) = max(kr)) AS at_edge FROM x GROUP BY set_id
""".replace("n AS (SELECT *, sqrt", "nodes AS (SELECT *, sqrt").replace("u / 100 AS t FROM n)", "u / 100 AS t FROM nodes)"))
def exponent_fit(spark: SparkSession, d: str) -> DataFrame:
    """The best exponent per set, the width of those within two of it, and
    whether they reach the grid's ends."""
    counts = _cells(spark, d).groupBy("set_id", "i", "cls").agg(F.count("*").alias("n"))
    likelihoods = fitting.likelihood(counts, _model(spark, d), ["set_id"])
    return aggs.profile(likelihoods, "set_id", "ll", "kr").withColumn("max_value", F.round("max_value", 4))


def _poisson_steps() -> list[float]:
    out, total, p = [], 0.0, math.exp(-1)
    for k in range(1, 13):
        total += p
        out.append(total)
        p /= k
    return out


_U = "((('0x' || substr(md5(trace_id::VARCHAR || ':' || draw::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)"
_WEIGHT = " + ".join(f"({_U} > {x!r}::DOUBLE)::INT" for x in _poisson_steps())


@query(f"""
WITH {MASSES}, {KERNEL}, n AS (SELECT draw, set_id, i, cls, sum({_WEIGHT}) AS n FROM cells, range({DRAWS}) z(draw) GROUP BY ALL),
q AS (SELECT draw, set_id, kr, sum(n * ln(greatest(coalesce(p, 0), 1e-12))) AS ll FROM n CROSS JOIN g LEFT JOIN model USING (kr, i, cls) WHERE n > 0 GROUP BY ALL),
best AS (SELECT draw, set_id, arg_min(kr, (-ll, kr)) AS kr FROM q GROUP BY ALL)
SELECT set_id, round(avg(kr), 6) AS mean, round(stddev_pop(kr), 6) AS std, round(quantile_cont(kr, 0.025), 6) AS low, round(quantile_cont(kr, 0.975), 6) AS high,
  round(avg((kr IN ({GRID[0]}, {GRID[-1]}))::INT), 6) AS at_edge FROM best GROUP BY set_id
""".replace("n AS (SELECT *, sqrt", "nodes AS (SELECT *, sqrt").replace("u / 100 AS t FROM n)", "u / 100 AS t FROM nodes)"))
def exponent_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Exponents of resampled traces on the same model table."""
    counts = fitting.bootstrap_counts(_cells(spark, d), ["set_id", "i", "cls"], "trace_id", DRAWS)
    best = fitting.best_exponent(fitting.likelihood(counts, _model(spark, d), ["draw", "set_id"]), ["draw", "set_id"])
    found = fitting.bootstrap_interval(best, "set_id", (GRID[0], GRID[-1]))
    return found.select("set_id", *[r6(F.col(c), c) for c in ("mean", "std", "low", "high", "at_edge")])


_T, _W = np.polynomial.legendre.leggauss(32)
NODES = "(VALUES " + ", ".join(f"({0.5 * (float(t) + 1)!r}::DOUBLE, {0.5 * float(w)!r}::DOUBLE)" for t, w in zip(_T, _W)) + ") q(t, w)"
SETS = "(SELECT r_regionkey AS set_id, cos(r_regionkey * 0.3::DOUBLE) AS mean_x, r_regionkey * 8.0::DOUBLE AS kappa, 0.2::DOUBLE + r_regionkey * 0.1::DOUBLE AS p32 FROM region)"
SINE = f"""u AS (SELECT *, greatest(-1, least(1, CASE WHEN kappa > 1e-9 THEN 1 + ln(t + (1 - t) * exp(-2 * kappa)) / kappa ELSE 2 * t - 1 END)) AS u FROM {SETS} s, {NODES}),
x AS (SELECT set_id, p32, w, least(1.0, abs(mean_x)) * u + sqrt(1 - least(1.0, abs(mean_x)) ** 2) * sqrt(greatest(1 - u * u, 0)) * cos(k * {2 * math.pi / 64}::DOUBLE) AS nx FROM u, range(64) z(k)),
c AS (SELECT set_id, p32, sum(w * sqrt(greatest(1 - nx * nx, 0))) / 64 AS calibration FROM x GROUP BY ALL)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    return read(spark, d, "region").select(k.alias("set_id"), F.cos(k * 0.3).alias("mean_x"), (k * 8.0).alias("kappa"), (k * 0.1 + 0.2).alias("p32"))


@query(f"WITH {SINE} SELECT set_id, round(calibration, 6) AS calibration FROM c")
def sine_calibration(spark: SparkSession, d: str) -> DataFrame:
    return fitting.mean_sine(spark, _sets(spark, d)).select("set_id", r6(F.col("calibration"), "calibration"))


_MEAN = math.pi * ((10.0**0.5 - 0.5**0.5) / 0.5) / ((10.0**-1.5 - 0.5**-1.5) / -1.5)


@query(f"WITH {SINE} SELECT set_id, round(p32 * calibration, 6) AS p21, round(p32 * 1000 / {_MEAN!r}::DOUBLE, 4) AS n_discs FROM c")
def discs_for_intensity(spark: SparkSession, d: str) -> DataFrame:
    """Trace length per area that an intensity gives, and the number of discs
    that give the intensity in a volume."""
    rows = fitting.mean_sine(spark, _sets(spark, d))
    count = fitting.discs_for_intensity(F.col("p32"), 1000.0, 2.5, 0.5, 10.0)
    return rows.select("set_id", r6(F.col("p32") * F.col("calibration"), "p21"), F.round(count, 4).alias("n_discs"))


@query("""
WITH k AS (SELECT r_regionkey AS set_id, 2.0::DOUBLE + r_regionkey * 7 AS kappa_obs, 60.0::DOUBLE AS kappa_noise FROM region),
b AS (SELECT i, (i + 0.5::DOUBLE) / 200000 AS r FROM range(200000) x(i)), q AS (SELECT r, (3 * r - r ** 3) / (1 - r * r) AS k FROM b),
o AS (SELECT set_id, arg_min(r, abs(q.k - kappa_obs)) AS ro, arg_min(r, abs(q.k - kappa_noise)) AS rn FROM k, q GROUP BY set_id)
SELECT set_id, round(ro, 3) AS r_obs, round((3 * (ro / rn) - (ro / rn) ** 3) / (1 - (ro / rn) ** 2), 1) AS kappa FROM o WHERE set_id < 4
""")
def deconvolved_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Concentrations freed of measurement noise: resultant lengths divide.
    The SQL looks lengths up in a fine table instead of bisecting."""
    k = F.col("r_regionkey")
    observed, noise = fitting.resultant(2.0 + k * 7), fitting.resultant(F.lit(60.0))
    rows = read(spark, d, "region").filter(k < 4).select(k.alias("set_id"), observed.alias("ro"), noise.alias("rn"))
    return rows.select("set_id", F.round("ro", 3).alias("r_obs"), F.round(fitting.concentration(F.col("ro") / F.col("rn")), 1).alias("kappa"))
