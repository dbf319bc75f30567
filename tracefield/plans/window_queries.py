"""Ranking, survival, sequential windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows
from .registry import query, r6, read, traces


@query("""
WITH k AS (SELECT set_id, face_id, count(*) AS n, CASE WHEN count(*) > 170 THEN 0 WHEN count(*) > 160 THEN 1 ELSE 2 END AS tier,
  abs(avg((cls = 0)::INT) - 1.0::DOUBLE / 3) AS l1, abs(quantile_cont(len, 0.9) / 100 - 1) AS q FROM {t} t GROUP BY ALL)
SELECT set_id, face_id, tier, round(l1, 6) AS l1, round(q, 6) AS q FROM k
QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY tier, round(l1, 9), q NULLS LAST, face_id) = 1
""")
def best_row(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    rows = traces(spark, d).groupBy("set_id", "face_id").agg(
        F.when(n > 170, 0).when(n > 160, 1).otherwise(2).alias("tier"),
        F.abs(F.avg((F.col("cls") == 0).cast("double")) - 1.0 / 3).alias("l1"),
        F.abs(F.percentile("len", 0.9) / 100 - 1).alias("q"),
    )
    best = windows.best_row(rows, "set_id", F.asc("tier"), F.round("l1", 9).asc(), F.asc_nulls_last("q"), F.asc("face_id"))
    return best.select("set_id", "face_id", "tier", r6(F.col("l1"), "l1"), r6(F.col("q"), "q"))


BLOCKS = """(SELECT (l_partkey % 10)::INT AS ix, (l_suppkey % 10)::INT AS iy, l_linenumber::INT AS iz, (l_orderkey % 97)::INT AS label,
  (l_orderkey % 12)::INT AS seed FROM lineitem)"""


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """``ix, iy, iz, label, seed`` from line items."""
    return read(spark, d, "lineitem").select(
        (F.col("l_partkey") % 10).cast("int").alias("ix"), (F.col("l_suppkey") % 10).cast("int").alias("iy"), F.col("l_linenumber").cast("int").alias("iz"),
        (F.col("l_orderkey") % 97).cast("int").alias("label"), (F.col("l_orderkey") % 12).cast("int").alias("seed"),
    )


@query(f"""
WITH b AS (SELECT label, count(*) AS n FROM {BLOCKS} v GROUP BY label)
SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS rank FROM b
""")
def block_rank(spark: SparkSession, d: str) -> DataFrame:
    sizes = voxels(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


@query("""
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), k AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS new_label FROM c)
SELECT vec_id, new_label FROM embeddings JOIN k USING (label)
""")
def relabel_by_size(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").select("vec_id", "label")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    ranks = sizes.select("label", F.row_number().over(Window.orderBy(F.desc("n"), "label")).alias("new_label"))
    return rows.join(ranks, "label").select("vec_id", "new_label")


@query("""
SELECT DISTINCT set_id, len, round(1 - cume_dist() OVER (PARTITION BY set_id ORDER BY len), 9) + 0.0 AS survival FROM {t} t
""")
def ecdf(spark: SparkSession, d: str) -> DataFrame:
    return windows.ecdf(traces(spark, d), "set_id", "len").select("set_id", "len", F.round("survival", 9).alias("survival"))


KM = """
s AS (SELECT set_id, len, sum({w}) AS leaving, sum({w}) FILTER (cls = 0) AS events, count(*) AS n FROM {t} t GROUP BY ALL),
r AS (SELECT *, sum(leaving) OVER (PARTITION BY set_id ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS risk FROM s),
f AS (SELECT *, 1 - coalesce(events, 0) / risk AS lft FROM r),
k AS (SELECT set_id, len, CASE WHEN max((lft <= 1e-12)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN lft > 1e-12 THEN ln(lft) ELSE 0 END) OVER w) END AS survival
  FROM f WINDOW w AS (PARTITION BY set_id ORDER BY len ROWS UNBOUNDED PRECEDING))
"""
KM1, KMW = KM.replace("{w}", "1.0::DOUBLE"), KM.replace("{w}", "least(5.0::DOUBLE, 1.0::DOUBLE / abs(sin(1.0::DOUBLE + face_id)))")


def _km(spark: SparkSession, d: str) -> DataFrame:
    return windows.kaplan_meier(traces(spark, d), "set_id", "len", F.col("cls") == 0)


@query(f"WITH {KM1} SELECT set_id, len, round(survival, 8) AS survival FROM k")
def kaplan_meier(spark: SparkSession, d: str) -> DataFrame:
    return _km(spark, d).select("set_id", "len", F.round("survival", 8).alias("survival"))


@query(f"WITH {KMW} SELECT set_id, len, round(survival, 8) AS survival FROM k")
def km_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Weights against sampling bias, 1 / sin of the angle, at most 5."""
    weight = F.least(F.lit(5.0), 1.0 / F.abs(F.sin(1.0 + F.col("face_id"))))
    curve = windows.kaplan_meier(traces(spark, d), "set_id", "len", F.col("cls") == 0, weight)
    return curve.select("set_id", "len", F.round("survival", 8).alias("survival"))


@query(f"""
WITH {KM1} SELECT set_id, coalesce(min(len) FILTER (survival <= 0.5 + 1e-12), max(len)) AS median_len,
  coalesce(min(len) FILTER (survival <= 0.1 + 1e-12), max(len)) AS p90_len FROM k GROUP BY set_id
""")
def km_quantile(spark: SparkSession, d: str) -> DataFrame:
    curve = _km(spark, d)
    half = windows.survival_quantile(curve, "set_id", "len", 0.5).withColumnRenamed("quantile", "median_len")
    return half.join(windows.survival_quantile(curve, "set_id", "len", 0.9).withColumnRenamed("quantile", "p90_len"), "set_id")


@query(f"""
WITH {KM1}, e AS (SELECT DISTINCT set_id, len, 1 - cume_dist() OVER (PARTITION BY set_id ORDER BY len) AS s FROM {{t}} t),
g AS (SELECT DISTINCT set_id, len FROM k)
SELECT g.set_id, round(max(abs(k.survival - e.s)), 6) AS max_gap, count(*) AS points FROM g
ASOF LEFT JOIN k ON g.set_id = k.set_id AND g.len >= k.len ASOF LEFT JOIN e ON g.set_id = e.set_id AND g.len >= e.len GROUP BY g.set_id
""")
def km_compare(spark: SparkSession, d: str) -> DataFrame:
    """Largest gap of two step curves on the union of their steps."""
    t = traces(spark, d)
    km, emp = _km(spark, d).select("set_id", "len", "survival"), windows.ecdf(t, "set_id", "len").select("set_id", "len", F.col("survival").alias("other"))
    grid = km.select("set_id", "len").union(emp.select("set_id", "len")).distinct()
    both = windows.as_of(grid, km, "set_id", "len", "survival", 1.0).join(windows.as_of(grid, emp, "set_id", "len", "other", 1.0), ["set_id", "len"])
    return both.groupBy("set_id").agg(r6(F.max(F.abs(F.col("survival") - F.col("other"))), "max_gap"), F.count("*").alias("points"))


@query(f"""
WITH {KM1}, q AS (SELECT DISTINCT set_id, i * 25.0::DOUBLE AS len FROM {{t}} t, range(21) x(i))
SELECT q.set_id, q.len, round(coalesce(k.survival, 1), 8) AS survival FROM q ASOF LEFT JOIN k ON q.set_id = k.set_id AND q.len >= k.len
""")
def asof_step(spark: SparkSession, d: str) -> DataFrame:
    points = traces(spark, d).select("set_id").distinct().withColumn("len", F.explode(F.array(*[F.lit(i * 25.0) for i in range(21)])))
    found = windows.as_of(points, _km(spark, d), "set_id", "len", "survival", 1.0)
    return found.select("set_id", "len", F.round("survival", 8).alias("survival"))


@query("""
WITH c AS (SELECT set_id, face_x, avg(len) AS y FROM {t} t WHERE face_id % 2 = 0 GROUP BY ALL),
q AS (SELECT DISTINCT set_id, i * 1.25::DOUBLE AS face_x FROM {t} t, range(30) x(i)),
b AS (SELECT q.*, (SELECT max(c.face_x) FROM c WHERE c.set_id = q.set_id AND c.face_x <= q.face_x) AS xa,
  (SELECT min(c.face_x) FROM c WHERE c.set_id = q.set_id AND c.face_x >= q.face_x) AS xb FROM q)
SELECT b.set_id, b.face_x, round(CASE WHEN xa IS NULL THEN cb.y WHEN xb IS NULL THEN ca.y WHEN xa = xb THEN ca.y
  ELSE ca.y + (b.face_x - xa) / (xb - xa) * (cb.y - ca.y) END, 6) AS y
FROM b LEFT JOIN c ca ON ca.set_id = b.set_id AND ca.face_x = xa LEFT JOIN c cb ON cb.set_id = b.set_id AND cb.face_x = xb
""")
def interp_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d)
    curve = t.filter("face_id % 2 = 0").groupBy("set_id", "face_x").agg(F.avg("len").alias("y"))
    points = t.select("set_id").distinct().withColumn("face_x", F.explode(F.array(*[F.lit(i * 1.25) for i in range(30)])))
    return windows.interpolate(points, curve, "set_id", "face_x", "y").select("set_id", "face_x", r6(F.col("y"), "y"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def running_offset(spark: SparkSession, d: str) -> DataFrame:
    """Start of each order's lines in its customer's flat array of lines."""
    sizes = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = read(spark, d, "orders").join(sizes, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", "o_totalprice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


@query("""
WITH f AS (SELECT set_id, face_id, avg(len) AS m FROM {t} t GROUP BY ALL)
SELECT set_id, face_id, round(abs(m - lag(m) OVER (PARTITION BY set_id ORDER BY face_id)), 6) AS step FROM f
""")
def lag_change(spark: SparkSession, d: str) -> DataFrame:
    means = traces(spark, d).groupBy("set_id", "face_id").agg(F.avg("len").alias("m"))
    return means.select("set_id", "face_id", r6(F.abs(F.col("m") - F.lag("m").over(Window.partitionBy("set_id").orderBy("face_id"))), "step"))


FACE_LL = """
fl AS (SELECT set_id, face_id, kr, count(*) * ln(kr - 1) - kr * sum(ln(len)) AS ll
  FROM {t} t, (SELECT 1.05::DOUBLE + i * 0.05::DOUBLE AS kr FROM range(20) x(i)) g WHERE len >= 1 GROUP BY set_id, face_id, kr),
rs AS (SELECT *, sum(ll) OVER (PARTITION BY set_id, kr ORDER BY face_id ROWS UNBOUNDED PRECEDING) AS total FROM fl),
pw AS (SELECT *, exp(total - max(total) OVER (PARTITION BY set_id, face_id)) AS w FROM rs),
pc AS (SELECT *, sum(w) OVER (PARTITION BY set_id, face_id ORDER BY kr ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY set_id, face_id) AS cdf FROM pw)
"""


def face_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood of a power law per set, face and exponent."""
    grid = spark.range(20).select((F.lit(1.05) + F.col("id") * F.lit(0.05)).alias("kr"))
    sums = traces(spark, d).filter("len >= 1").groupBy("set_id", "face_id").agg(F.count("*").alias("n"), F.sum(F.log("len")).alias("s"))
    ll = F.col("n") * F.log(F.col("kr") - 1) - F.col("kr") * F.col("s")
    return sums.crossJoin(F.broadcast(grid)).select("set_id", "face_id", "kr", ll.alias("ll"))


@query(f"WITH {FACE_LL} SELECT set_id, face_id, round(arg_min(kr, -total), 6) AS argmax FROM rs GROUP BY set_id, face_id")
def expanding_posterior(spark: SparkSession, d: str) -> DataFrame:
    found = windows.sequential_posterior(face_likelihoods(spark, d), "set_id", "kr", "face_id", "ll")
    return found.select("set_id", "face_id", r6(F.col("argmax"), "argmax"))


@query(f"""
WITH {FACE_LL} SELECT set_id, face_id, round(min(kr) FILTER (cdf >= 0.025), 6) AS low, round(min(kr) FILTER (cdf >= 0.975), 6) AS high FROM pc GROUP BY set_id, face_id
""")
def credible_interval(spark: SparkSession, d: str) -> DataFrame:
    found = windows.sequential_posterior(face_likelihoods(spark, d), "set_id", "kr", "face_id", "ll")
    return found.select("set_id", "face_id", r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query("SELECT trace_id, round(max(len) OVER (PARTITION BY set_id) - len, 6) AS delta FROM {t} t")
def delta_from_max(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d).select("trace_id", r6(F.max("len").over(Window.partitionBy("set_id")) - F.col("len"), "delta"))


@query("""
WITH w AS (SELECT s AS window_start, face_id FROM range(9) x(s), range(12) y(face_id) WHERE face_id BETWEEN s AND s + 3)
SELECT window_start, set_id, count(*) AS n, round(avg(len), 6) AS mean_len FROM {t} t JOIN w USING (face_id) GROUP BY ALL
""")
def rolling_faces(spark: SparkSession, d: str) -> DataFrame:
    """Four consecutive faces at a time, one face further each."""
    rows = windows.rolling_windows(traces(spark, d), "face_id", 4)
    return rows.groupBy("window_start", "set_id").agg(F.count("*").alias("n"), r6(F.avg("len"), "mean_len"))


@query("""
WITH f AS (SELECT set_id, face_id, count(*) AS n, sum(len) AS s FROM {t} t GROUP BY ALL)
SELECT set_id, face_id, (sum(n) OVER w)::BIGINT AS n, round(sum(s) OVER w / sum(n) OVER w, 6) AS mean_len FROM f WINDOW w AS (PARTITION BY set_id ORDER BY face_id)
""")
def expanding_faces(spark: SparkSession, d: str) -> DataFrame:
    each = traces(spark, d).groupBy("set_id", "face_id").agg(F.count("*").alias("n"), F.sum("len").alias("s"))
    so_far = Window.partitionBy("set_id").orderBy("face_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("set_id", "face_id", F.sum("n").over(so_far).alias("n"), r6(F.sum("s").over(so_far) / F.sum("n").over(so_far), "mean_len"))


@query("""
WITH a AS (SELECT DISTINCT set_id, floor(len * len % 360 * 4) / 4 AS angle FROM {t} t),
g AS (SELECT set_id, coalesce(lead(angle) OVER w, first_value(angle) OVER w + 360) - angle AS gap FROM a WINDOW w AS (PARTITION BY set_id ORDER BY angle))
SELECT set_id, max(gap) AS max_gap, 360 - max(gap) AS arc FROM g GROUP BY set_id
""")
def arc_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = traces(spark, d).withColumn("angle", F.floor(F.col("len") * F.col("len") % 360 * 4) / 4)
    return windows.arc_gap(rows, "set_id", "angle")


@query("""
SELECT set_id, trace_id, len FROM {t} t
QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY len, trace_id) = count(*) OVER (PARTITION BY set_id) // 2 + 1
""")
def median_position_row(spark: SparkSession, d: str) -> DataFrame:
    ranked = windows.running(traces(spark, d), ["set_id"], ["len", "trace_id"], {"rank": F.lit(1)})
    return ranked.filter("rank = rank_total div 2 + 1").select("set_id", "trace_id", "len")


@query("SELECT set_id, trace_id, row_number() OVER (PARTITION BY set_id ORDER BY face_id, trace_id) AS local_id FROM {t} t")
def surrogate_id(spark: SparkSession, d: str) -> DataFrame:
    rows = traces(spark, d).select("set_id", "face_id", "trace_id")
    numbered = windows.running(rows, ["set_id"], ["face_id", "trace_id"], {"local_id": F.lit(1)})
    return numbered.select("set_id", "trace_id", "local_id")


@query("SELECT set_id, trace_id, round(100 * (1 - cume_dist() OVER (PARTITION BY set_id ORDER BY len)), 6) AS percent_above FROM {t} t")
def percent_above(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.running(traces(spark, d).select("set_id", "trace_id", "len"), ["set_id"], ["len"], {"n": F.lit(1)}, peers=True)
    return rows.select("set_id", "trace_id", r6(100 * (1 - F.col("n") / F.col("n_total")), "percent_above"))


@query("SELECT disc_id, set_id, radius FROM {d} d ORDER BY radius DESC, disc_id LIMIT 40")
def topn_radius(spark: SparkSession, d: str) -> DataFrame:
    from .registry import discs

    return discs(spark, d).orderBy(F.desc("radius"), "disc_id").limit(40).select("disc_id", "set_id", "radius")


@query("""
WITH r AS (SELECT disc_id, radius, (disc_id % 40 = 0)::INT AS observed, row_number() OVER (PARTITION BY (disc_id % 40 = 0) ORDER BY radius DESC, disc_id) AS rank FROM {d} d),
q AS (SELECT count(*) FILTER (observed = 1) AS n1, count(*) FILTER (observed = 0) AS n0 FROM r),
z AS (SELECT greatest(least(n1, 80), least(n1, 200 - least(n0, 120))) AS k1 FROM q)
SELECT disc_id, radius, observed FROM r, z WHERE rank <= CASE WHEN observed = 1 THEN k1 ELSE 200 - k1 END
""")
def stratified_topk(spark: SparkSession, d: str) -> DataFrame:
    from .registry import discs

    rows = discs(spark, d).select("disc_id", "radius", (F.col("disc_id") % 40 == 0).cast("int").alias("observed"))
    return windows.stratified_top(rows, "observed", [F.desc("radius"), F.asc("disc_id")], 200, 80)


@query("SELECT set_id, face_id, arg_min(trace_id, (-len, trace_id)) AS trace_id, max(len) AS len FROM {t} t GROUP BY ALL")
def keep_longest(spark: SparkSession, d: str) -> DataFrame:
    first = F.min_by("trace_id", F.struct(-F.col("len"), F.col("trace_id")))
    return traces(spark, d).groupBy("set_id", "face_id").agg(first.alias("trace_id"), F.max("len").alias("len"))


@query("SELECT set_id, face_id, arg_min(trace_id, md5('17:' || trace_id::VARCHAR)) AS trace_id FROM {t} t GROUP BY ALL")
def keep_random(spark: SparkSession, d: str) -> DataFrame:
    """One trace per set and face, by a seeded hash, so reruns agree."""
    key = F.md5(F.concat(F.lit("17:"), F.col("trace_id")).cast("binary"))
    return traces(spark, d).groupBy("set_id", "face_id").agg(F.min_by("trace_id", key).alias("trace_id"))


@query("SELECT set_id, trace_id FROM {t} t QUALIFY (row_number() OVER (PARTITION BY set_id ORDER BY trace_id) - 1) % 20 = 0")
def even_downsample(spark: SparkSession, d: str) -> DataFrame:
    numbered = windows.running(traces(spark, d).select("set_id", "trace_id"), ["set_id"], ["trace_id"], {"k": F.lit(1)})
    return numbered.filter("(k - 1) % 20 = 0").select("set_id", "trace_id")


@query("SELECT DISTINCT set_id, round(len, 0) AS len FROM {t} t")
def rounded_dedup(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d).select("set_id", F.round("len", 0).alias("len")).dropDuplicates()


@query("""
SELECT disc_id, radius, 'visible' AS source FROM {d} d WHERE radius >= 6 UNION ALL SELECT disc_id, radius / 2, 'hidden' FROM {d} d WHERE radius < 6
""")
def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    from .registry import discs

    rows = discs(spark, d).select("disc_id", "radius")
    seen = rows.filter("radius >= 6").withColumn("source", F.lit("visible"))
    return seen.unionByName(rows.filter("radius < 6").withColumn("radius", F.col("radius") / 2).withColumn("source", F.lit("hidden")))


@query(f"""
(SELECT label FROM {BLOCKS} v WHERE ix = 3 INTERSECT SELECT label FROM {BLOCKS} v GROUP BY label HAVING count(*) >= 600) EXCEPT SELECT label FROM {BLOCKS} v WHERE ix = 0 AND iy = 0 AND iz = 7
""")
def label_set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Labels that touch a face and are large, less those at the boundary."""
    v = voxels(spark, d)
    big = v.groupBy("label").agg(F.count("*").alias("n")).filter("n >= 600").select("label")
    return v.filter("ix = 3").select("label").intersect(big).subtract(v.filter("ix = 0 AND iy = 0 AND iz = 7").select("label"))


@query("SELECT s_nationkey AS nationkey FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return a.union(read(spark, d, "customer").select("c_nationkey")).distinct()
