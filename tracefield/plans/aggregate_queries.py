"""Aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggs, windows
from .registry import query, r6, read, traces

AREA = 1250.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(F.col(c), c) if c in names else F.col(c) for c in df.columns])


@query("""
SELECT set_id, count(*) AS n, count(*) FILTER (cls = 0) AS n_class0, count(*) FILTER (cls = 1) AS n_class1,
  count(*) FILTER (cls = 2) AS n_class2, round(avg((cls > 0)::INT), 6) AS censor_ratio, round(avg(len), 6) AS mean_len,
  round(avg(len) FILTER (cls = 0), 6) AS mean_class0, round(avg(len) FILTER (cls = 1), 6) AS mean_class1,
  round(avg(len) FILTER (cls = 2), 6) AS mean_class2, round(median(len) FILTER (cls = 0), 6) AS median_class0,
  round(median(len) FILTER (cls = 1), 6) AS median_class1, round(median(len) FILTER (cls = 2), 6) AS median_class2,
  round(sum(len), 6) AS sum_len, round(sum(len) / 1250.0::DOUBLE, 6) AS p21
FROM {t} t GROUP BY set_id
""")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    out = aggs.trace_summary(traces(spark, d), AREA)
    return rounded(out, *[c for c in out.columns if c != "set_id" and not c.startswith("n")])


@query("""
SELECT set_id, face_id, count(*) AS n, round(avg(len), 6) AS mean_len, round(quantile_cont(len, 0.9), 6) AS p90,
  round(quantile_cont(len, 0.9) / quantile_cont(len, 0.5), 6) AS p90_ratio
FROM {t} t GROUP BY set_id, face_id
""")
def face_summary_p90(spark: SparkSession, d: str) -> DataFrame:
    p90, p50 = F.percentile("len", 0.9), F.percentile("len", 0.5)
    return traces(spark, d).groupBy("set_id", "face_id").agg(
        F.count("*").alias("n"), r6(F.avg("len"), "mean_len"), r6(p90, "p90"), r6(p90 / p50, "p90_ratio")
    )


@query("""
SELECT set_id, count(*) AS n, count(DISTINCT face_id) AS n_faces FROM {t} t WHERE len >= 20
GROUP BY set_id HAVING count(*) >= 100 AND count(DISTINCT face_id) >= 3
""")
def target_sets_having(spark: SparkSession, d: str) -> DataFrame:
    found = traces(spark, d).filter("len >= 20").groupBy("set_id").agg(F.count("*").alias("n"), F.countDistinct("face_id").alias("n_faces"))
    return found.filter("n >= 100 AND n_faces >= 3")


@query("""
SELECT set_id, round(avg((cls = 0)::INT), 6) AS f0, round(avg((cls = 1)::INT), 6) AS f1, round(avg((cls = 2)::INT), 6) AS f2
FROM {t} t GROUP BY set_id
""")
def class_fraction(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d).groupBy("set_id").agg(*[r6(F.avg((F.col("cls") == c).cast("double")), f"f{c}") for c in range(3)])


HIST = """
b AS (SELECT t.*, least(7, floor((ln(len) - ln(1.0)) / (ln((SELECT max(len) * 1.000001::DOUBLE FROM {t} m)) - ln(1.0)) * 8))::INT AS bin,
      1.0::DOUBLE + face_id % 3 AS w FROM {t} t WHERE len >= 1.0),
g AS (SELECT DISTINCT set_id, i::INT AS bin, c::INT AS cls FROM {t} t, range(8) x(i), range(3) y(c)),
h AS (SELECT g.set_id, g.bin, g.cls, coalesce(sum(b.w), 0)::DOUBLE AS weight FROM g LEFT JOIN b USING (set_id, bin, cls) GROUP BY ALL)
"""


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggs.histogram2d(traces(spark, d), 1.0, 8, 1.0 + F.col("face_id") % 3)


@query(f"WITH {HIST} SELECT set_id, bin, cls, round(weight, 6) AS weight FROM h")
def hist2d_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_histogram(spark, d).select("set_id", "bin", "cls", "weight"), "weight")


@query(f"""
WITH {HIST} SELECT set_id, bin, cls, round(CASE WHEN sum(weight) OVER s > 0 THEN weight / sum(weight) OVER s
  ELSE 1.0::DOUBLE / count(*) OVER s END, 6) AS p FROM h WINDOW s AS (PARTITION BY set_id)
""")
def prob_table(spark: SparkSession, d: str) -> DataFrame:
    return aggs.to_probability(_histogram(spark, d)).select("set_id", "bin", "cls", r6(F.col("p"), "p"))


@query(f"""
WITH {HIST} SELECT set_id, bin, cls, grouping(bin)::INT AS no_bin, round(sum(weight), 6) AS weight FROM h
GROUP BY GROUPING SETS ((set_id, bin), (set_id, cls))
""")
def hist_marginals_gsets(spark: SparkSession, d: str) -> DataFrame:
    cells = _histogram(spark, d)
    sets = [[F.col("set_id"), F.col("bin")], [F.col("set_id"), F.col("cls")]]
    return cells.groupingSets(sets, "set_id", "bin", "cls").agg(
        F.grouping("bin").cast("int").alias("no_bin"), r6(F.sum("weight"), "weight")
    ).select("set_id", "bin", "cls", "no_bin", "weight")


@query(f"""
WITH {HIST}, m AS (SELECT set_id, bin, sum(weight) AS w FROM h GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY set_id ORDER BY bin) / sum(w) OVER (PARTITION BY set_id) AS cdf,
      w / sum(w) OVER (PARTITION BY set_id) AS p FROM m)
SELECT set_id, min(bin) FILTER (cdf >= 0.9) AS bin90,
  round(arg_min(bin + (0.9::DOUBLE - (cdf - p)) / p, bin) FILTER (cdf >= 0.9), 6) AS q90 FROM c GROUP BY set_id
""")
def binned_quantile(spark: SparkSession, d: str) -> DataFrame:
    mass = _histogram(spark, d).groupBy("set_id", "bin").agg(F.sum("weight").alias("w"))
    group = Window.partitionBy("set_id")
    mass = mass.withColumn("cdf", F.sum("w").over(group.orderBy("bin")) / F.sum("w").over(group)).withColumn("p", F.col("w") / F.sum("w").over(group))
    hit = mass.filter("cdf >= 0.9")
    at = F.col("bin") + (0.9 - (F.col("cdf") - F.col("p"))) / F.col("p")
    return hit.groupBy("set_id").agg(F.min("bin").alias("bin90"), r6(F.min_by(at, "bin"), "q90"))


GRID = """
k AS (SELECT 2.0::DOUBLE + i * 0.25::DOUBLE AS kr FROM range(13) x(i)),
m AS (SELECT kr, b::INT AS bin, exp(-kr * b * 0.2::DOUBLE) / (SELECT sum(exp(-k2.kr * j * 0.2::DOUBLE)) FROM range(8) y(j), k k2 WHERE k2.kr = k.kr) AS p
      FROM k, range(8) z(b)),
l AS (SELECT h.set_id, m.kr, sum(h.weight * ln(greatest(m.p, 1e-12))) AS ll FROM h JOIN m USING (bin) GROUP BY ALL)
"""


def kr_grid(spark: SparkSession, points: int = 13, low: float = 2.0, step: float = 0.25) -> DataFrame:
    return spark.range(points).select((F.lit(low) + F.col("id") * F.lit(step)).alias("kr"))


def _likelihood(spark: SparkSession, d: str) -> DataFrame:
    model = kr_grid(spark).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(7))))
    raw = F.exp(-F.col("kr") * F.col("bin") * 0.2)
    model = model.withColumn("p", raw / F.sum(raw).over(Window.partitionBy("kr")))
    joined = _histogram(spark, d).join(F.broadcast(model), "bin")
    return joined.groupBy("set_id", "kr").agg(aggs.log_likelihood(F.col("weight"), F.col("p")).alias("ll"))


@query(f"WITH {HIST}, {GRID} SELECT set_id, kr, round(ll, 4) AS ll FROM l")
def loglik_grid(spark: SparkSession, d: str) -> DataFrame:
    return _likelihood(spark, d).select("set_id", "kr", F.round("ll", 4).alias("ll"))


@query(f"""
WITH {HIST}, {GRID}, x AS (SELECT *, max(ll) OVER (PARTITION BY set_id) AS best FROM l)
SELECT set_id, arg_min(kr, -ll) AS argmax, round(max(best), 4) AS max_value,
  max(kr) FILTER (ll >= best - 2) - min(kr) FILTER (ll >= best - 2) AS width,
  (min(kr) FILTER (ll >= best - 2) = min(kr) OR max(kr) FILTER (ll >= best - 2) = max(kr)) AS at_edge
FROM x GROUP BY set_id
""")
def profile_argmax(spark: SparkSession, d: str) -> DataFrame:
    return aggs.profile(_likelihood(spark, d), "set_id", "ll", "kr").withColumn("max_value", F.round("max_value", 4))


@query("""
SELECT set_id, round(quantile_cont(len, 0.5), 6) AS q50, round(quantile_cont(len, 0.9), 6) AS q90, round(quantile_cont(len, 0.95), 6) AS q95,
  round(quantile_cont(len, 0.025), 6) AS ci_low, round(quantile_cont(len, 0.975), 6) AS ci_high, round(stddev_pop(len), 6) AS std0
FROM {t} t GROUP BY set_id
""")
def exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    names = {"q50": 0.5, "q90": 0.9, "q95": 0.95, "ci_low": 0.025, "ci_high": 0.975}
    found = windows.quantiles(traces(spark, d), ["set_id"], "len", list(names.values()))
    spread = traces(spark, d).groupBy("set_id").agg(r6(F.stddev_pop("len"), "std0"))
    return found.join(spread, "set_id").select("set_id", *[r6(F.col(f"q{k}"), c) for k, c in enumerate(names)], "std0")


@query("SELECT cls, count(*) AS n FROM {t} t GROUP BY cls")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d).groupBy("cls").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT set_id, avg((cls = 0)::INT) AS f0, avg((cls = 1)::INT) AS f1, avg((cls = 2)::INT) AS f2 FROM {t} t GROUP BY set_id)
SELECT set_id, 0 AS cls, round(f0, 6) AS share FROM f UNION ALL SELECT set_id, 1, round(f1, 6) FROM f UNION ALL SELECT set_id, 2, round(f2, 6) FROM f
""")
def class_rows_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = class_fraction(spark, d)
    return wide.unpivot("set_id", ["f0", "f1", "f2"], "name", "share").select("set_id", F.substring("name", 2, 1).cast("int").alias("cls"), "share")


@query("""
SELECT coalesce(set_id, 'ALL') AS set_id, count(*) AS n, count(*) FILTER (len >= 50) AS hits,
  round(count(*) FILTER (len >= 50) / count(*), 6) AS recall FROM {t} t GROUP BY ROLLUP (set_id)
""")
def rollup_all(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.grouping("set_id") == 1, F.lit("ALL")).otherwise(F.col("set_id"))
    hits = F.count_if(F.col("len") >= 50)
    return traces(spark, d).rollup("set_id").agg(label.alias("label"), F.count("*").alias("n"), hits.alias("hits"), r6(hits / F.count("*"), "recall")).select(
        F.col("label").alias("set_id"), "n", "hits", "recall"
    )


@query("""
WITH q AS (SELECT set_id, lmin, quantile_cont(len, 0.9) AS p90 FROM {t} t, (VALUES (1.0::DOUBLE), (5.0::DOUBLE), (20.0::DOUBLE)) v(lmin) WHERE len >= lmin GROUP BY ALL)
SELECT set_id, lmin, round(p90, 6) AS p90, round(max(p90) OVER (PARTITION BY set_id) / min(p90) OVER (PARTITION BY set_id), 6) AS ratio FROM q
""")
def lmin_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(x) for x in (1.0, 5.0, 20.0)]))
    p90 = traces(spark, d).withColumn("lmin", grid).filter("len >= lmin").groupBy("set_id", "lmin").agg(F.percentile("len", 0.9).alias("p90"))
    group = Window.partitionBy("set_id")
    return p90.select("set_id", "lmin", r6(F.col("p90"), "p90"), r6(F.max("p90").over(group) / F.min("p90").over(group), "ratio"))


@query("""
SELECT set_id, round(regr_slope(ln(len), face_x), 8) AS slope, round(regr_intercept(ln(len), face_x), 6) AS intercept FROM {t} t WHERE len > 0 GROUP BY set_id
""")
def loglinear_fit(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d).filter("len > 0").groupBy("set_id").agg(
        F.round(F.regr_slope(F.log("len"), F.col("face_x")), 8).alias("slope"), r6(F.regr_intercept(F.log("len"), F.col("face_x")), "intercept")
    )


@query("""
WITH k AS (SELECT set_id, k, var_pop(len) AS v, count(*) AS n FROM (SELECT set_id, len, face_id % k AS c, k FROM {t} t, (VALUES (1), (2), (3)) x(k)) GROUP BY set_id, k, c)
SELECT set_id, k, round(sum(n * ln(greatest(v, 1e-12))) + 2 * k * ln(sum(n)), 4) AS bic FROM k GROUP BY set_id, k
""")
def bic_by_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = traces(spark, d).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("c", F.col("face_id") % F.col("k"))
    each = rows.groupBy("set_id", "k", "c").agg(F.var_pop("len").alias("v"), F.count("*").alias("n"))
    fit = F.sum(F.col("n") * F.log(F.greatest("v", F.lit(1e-12)))) + 2 * F.col("k") * F.log(F.sum("n"))
    return each.groupBy("set_id", "k").agg(F.round(fit, 4).alias("bic"))


@query("""
SELECT set_id, CASE WHEN len < 10 THEN 'short' WHEN len < 100 THEN 'middle' ELSE 'long' END AS band, count(*) AS n,
  round(avg(len), 6) AS mean_len, round(stddev_samp(len), 6) AS std_len FROM {t} t GROUP BY ALL HAVING count(*) > 20
""")
def banded_stats(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("len") < 10, "short").when(F.col("len") < 100, "middle").otherwise("long")
    rows = traces(spark, d).withColumn("band", band).groupBy("set_id", "band")
    return rows.agg(F.count("*").alias("n"), r6(F.avg("len"), "mean_len"), r6(F.stddev_samp("len"), "std_len")).filter("n > 20")


@query("""
SELECT face_id, cut, count(*) FILTER (len > cut) AS n_gt, round(avg((len > cut)::INT), 6) AS frac_gt, round(max(len), 6) AS max_len,
  round(quantile_cont(len, 0.99), 6) AS p99, round(avg(face_x) FILTER (len > cut), 6) AS mean_x
FROM {t} t, (VALUES (20.0), (50.0), (100.0), (200.0)) v(cut) GROUP BY face_id, cut
""")
def overbreak_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = traces(spark, d).withColumn("cut", F.explode(F.array(*[F.lit(x) for x in (20.0, 50.0, 100.0, 200.0)])))
    above = F.col("len") > F.col("cut")
    return rows.groupBy("face_id", "cut").agg(
        F.count_if(above).alias("n_gt"), r6(F.avg(above.cast("double")), "frac_gt"), r6(F.max("len"), "max_len"),
        r6(F.percentile("len", 0.99), "p99"), r6(F.avg(F.when(above, F.col("face_x"))), "mean_x"),
    )


@query("SELECT set_id, round(avg((len < 50)::INT), 6) AS rank50 FROM {t} t GROUP BY set_id")
def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d).groupBy("set_id").agg(r6(F.avg((F.col("len") < 50).cast("double")), "rank50"))


@query("""
WITH c AS (SELECT len, count(*) FILTER (cls = 0) AS n0, count(*) FILTER (cls = 1) AS n1 FROM {t} t WHERE cls < 2 GROUP BY len)
SELECT round(max(g), 6) AS ks FROM (SELECT abs(sum(n0) OVER (ORDER BY len) / sum(n0) OVER () - sum(n1) OVER (ORDER BY len) / sum(n1) OVER ()) AS g FROM c)
""")
def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    return aggs.ks_statistic(traces(spark, d).filter("cls < 2"), "cls", "len").select(r6(F.col("ks"), "ks"))


@query("""
WITH r AS (SELECT set_id, face_x, len, rank() OVER (PARTITION BY set_id ORDER BY face_x) + (count(*) OVER (PARTITION BY set_id, face_x) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY set_id ORDER BY len) + (count(*) OVER (PARTITION BY set_id, len) - 1) / 2.0::DOUBLE AS b FROM {t} t)
SELECT set_id, round(corr(a, b), 6) AS spearman, round(corr(face_x, len), 6) AS pearson FROM r GROUP BY set_id
""")
def spearman_pearson(spark: SparkSession, d: str) -> DataFrame:
    ranked = aggs.rank_average(aggs.rank_average(traces(spark, d), "face_x", "set_id", "a"), "len", "set_id", "b")
    return ranked.groupBy("set_id").agg(r6(F.corr("a", "b"), "spearman"), r6(F.corr("face_x", "len"), "pearson"))


RUNS = "(SELECT (o_orderkey % 12)::INT AS seed, o_totalprice AS v FROM orders)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select((F.col("o_orderkey") % 12).cast("int").alias("seed"), F.col("o_totalprice").alias("v"))


@query(f"""
WITH s AS (SELECT seed, count(*) AS n, sum(v) AS total FROM {RUNS} r GROUP BY seed)
SELECT count(*) AS runs, round(avg(n), 6) AS mean_n, round(stddev_samp(n), 6) AS std_n, round(stddev_samp(n) / avg(n), 6) AS cv_n,
  min(n) AS min_n, max(n) AS max_n, round(avg(total), 4) AS mean_total, round(stddev_samp(total), 4) AS std_total, round(quantile_cont(total, 0.9), 4) AS p90_total FROM s
""")
def mc_run_stats(spark: SparkSession, d: str) -> DataFrame:
    each = runs(spark, d).groupBy("seed").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return each.agg(
        F.count("*").alias("runs"), r6(F.avg("n"), "mean_n"), r6(F.stddev_samp("n"), "std_n"), r6(F.stddev_samp("n") / F.avg("n"), "cv_n"),
        F.min("n").alias("min_n"), F.max("n").alias("max_n"), r4(F.avg("total"), "mean_total"), r4(F.stddev_samp("total"), "std_total"),
        r4(F.percentile("total", 0.9), "p90_total"),
    )


@query(f"""
WITH g AS (SELECT i * 50000.0::DOUBLE AS x FROM range(11) y(i)),
c AS (SELECT x, seed, count(*) FILTER (v >= x) AS n FROM {RUNS} r, g GROUP BY x, seed)
SELECT x, round(avg(n), 6) AS mean_n, round(quantile_cont(n, 0.05), 6) AS p5, round(quantile_cont(n, 0.95), 6) AS p95 FROM c GROUP BY x
""")
def ccdf_band(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).withColumn("x", F.explode(F.array(*[F.lit(i * 50000.0) for i in range(11)])))
    counts = rows.groupBy("x", "seed").agg(F.count_if(F.col("v") >= F.col("x")).alias("n"))
    return counts.groupBy("x").agg(r6(F.avg("n"), "mean_n"), r6(F.percentile("n", 0.05), "p5"), r6(F.percentile("n", 0.95), "p95"))


@query("""
WITH c AS (SELECT labels.quality AS a, labels.toxic AS b, count(*) AS n FROM labels GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS both_, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS t,
             (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS p)
SELECT round(both_ / p, 6) AS "precision", round(both_ / t, 6) AS recall, round(2 * (both_ / p) * (both_ / t) / (both_ / p + both_ / t), 6) AS f1 FROM s
""")
def pair_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return aggs.pair_scores(read(spark, d, "labels"), "quality", "toxic").select(*[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query("""
WITH f AS (SELECT set_id, face_id, sum(len) AS total, 40.0::DOUBLE + face_id AS area FROM {t} t GROUP BY ALL),
w AS (SELECT i AS draw, j AS pick, ((i * 7 + j * 5 + i * j) % 12)::INT AS face_id FROM range(50) x(i), range(12) y(j)),
e AS (SELECT set_id, draw, sum(total) / sum(area) AS p21 FROM f JOIN w USING (face_id) GROUP BY ALL)
SELECT set_id, round(avg(p21), 6) AS mean_p21, round(quantile_cont(p21, 0.025), 6) AS low, round(quantile_cont(p21, 0.975), 6) AS high FROM e GROUP BY set_id
""")
def block_bootstrap_p21(spark: SparkSession, d: str) -> DataFrame:
    """Faces are resampled whole; draws are a table, so results repeat."""
    faces = traces(spark, d).groupBy("set_id", "face_id").agg(F.sum("len").alias("total"), F.first(40.0 + F.col("face_id")).alias("area"))
    draws = spark.range(50).select(F.col("id").alias("draw")).withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(11))))
    draws = draws.withColumn("face_id", ((F.col("draw") * 7 + F.col("pick") * 5 + F.col("draw") * F.col("pick")) % 12).cast("int"))
    each = faces.join(F.broadcast(draws), "face_id").groupBy("set_id", "draw").agg((F.sum("total") / F.sum("area")).alias("p21"))
    return each.groupBy("set_id").agg(r6(F.avg("p21"), "mean_p21"), r6(F.percentile("p21", 0.025), "low"), r6(F.percentile("p21", 0.975), "high"))


@query("""
WITH b AS (SELECT draw, set_id, avg(len) AS m FROM {t} t, (SELECT i AS draw FROM range(20) x(i)) w
  WHERE ('0x' || substr(md5(trace_id::VARCHAR || ':' || draw::VARCHAR), 1, 6))::BIGINT % 2 = 0 GROUP BY ALL)
SELECT set_id, round(avg(m), 6) AS mean_m, round(stddev_pop(m), 6) AS std_m, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b GROUP BY set_id
""")
def hash_bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    """Half-sample bootstrap whose draws are hashes of the row and the draw."""
    rows = traces(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    key = F.md5(F.concat_ws(":", "trace_id", "draw").cast("binary"))
    drawn = rows.filter(F.conv(F.substring(key, 1, 6), 16, 10).cast("long") % 2 == 0)
    each = drawn.groupBy("set_id", "draw").agg(F.avg("len").alias("m"))
    return each.groupBy("set_id").agg(r6(F.avg("m"), "mean_m"), r6(F.stddev_pop("m"), "std_m"), r6(F.percentile("m", 0.025), "low"), r6(F.percentile("m", 0.975), "high"))
