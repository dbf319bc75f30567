"""Association of traces into discs, and how well it does.

Observed traces are the chords of discs on faces whose middle lies in the
window; the disc is the truth.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import aggs, association, chordfit, joins, windows
from .join_queries import CHORD, chords
from .registry import discs, query, r6

WINDOW = "abs(my) <= 8 AND abs(mz) <= 6"


def observed(spark: SparkSession, d: str) -> DataFrame:
    rows = chords(spark, d).filter(WINDOW)
    return rows.select(
        (F.col("disc_id") * 12 + F.col("face_id")).alias("trace_id"), "disc_id", "set_id", "face_id", (F.col("face_id") * 3.0).alias("x"),
        F.col("my").alias("y"), F.col("mz").alias("z"), "n", F.col("half").alias("h"), "dy", "dz",
    )


OBSERVED = f"""(SELECT c.disc_id * 12 + c.face_id AS trace_id, c.disc_id, c.set_id, c.face_id, c.face_id * 3.0::DOUBLE AS x, c.my AS y, c.mz AS z, c.half AS h,
  c.dy, c.dz, d.nx, d.ny, d.nz FROM {CHORD} c JOIN {{d}} d USING (disc_id) WHERE {WINDOW})"""
NEAR = """abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) >= cos(radians(12.0::DOUBLE))
  AND greatest(abs((b.x - a.x) * a.nx + (b.y - a.y) * a.ny + (b.z - a.z) * a.nz), abs((b.x - a.x) * b.nx + (b.y - a.y) * b.ny + (b.z - a.z) * b.nz)) <= 0.5"""
APART = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"
SINE = "sqrt(greatest(1 - least(0.97::DOUBLE, greatest(abs(a.nx), abs(b.nx))) ** 2, 1e-6::DOUBLE))"
FIXED = f"SELECT a.trace_id AS i, b.trace_id AS j, {APART} AS apart FROM {OBSERVED} a JOIN {OBSERVED} b ON a.set_id = b.set_id AND a.trace_id < b.trace_id WHERE {APART} <= 5 AND {NEAR}"
GATED = f"""SELECT a.trace_id AS i, b.trace_id AS j, {APART} AS apart FROM {OBSERVED} a JOIN {OBSERVED} b ON a.set_id = b.set_id AND a.trace_id < b.trace_id
  WHERE abs(b.x - a.x) <= 3.2 AND {APART} <= least(8.0::DOUBLE, greatest(2.0::DOUBLE, 1.4::DOUBLE * abs(b.x - a.x) / {SINE})) AND {NEAR}"""
CLUSTERS = f"""p AS (SELECT i, j FROM ({GATED}) q), e AS (SELECT i AS a, j AS b FROM p UNION ALL SELECT j, i FROM p),
r AS (SELECT trace_id AS id, trace_id AS c FROM {OBSERVED} o UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
g AS (SELECT id AS trace_id, min(c) AS cluster FROM r GROUP BY id)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return association.gated_pairs(observed(spark, d), 12.0, 0.5)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return association.connected(observed(spark, d), _gated(spark, d))


@query(f"SELECT i, j, round(apart, 6) AS apart FROM ({FIXED}) q")
def coplanar_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = association.coplanar_pairs(observed(spark, d), 12.0, 0.5, 5.0)
    return found.select("i", "j", r6(F.col("apart"), "apart"))


@query(f"SELECT i, j, round(apart, 6) AS apart FROM ({GATED}) q")
def gated_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("i", "j", r6(F.col("apart"), "apart"))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT trace_id, cluster FROM g")
def associated_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces grouped by the components of their gated pairs."""
    return _clusters(spark, d)


@query(f"""
WITH RECURSIVE {CLUSTERS}, x AS (SELECT disc_id, cluster, count(*) AS n FROM g JOIN {OBSERVED} o USING (trace_id) GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM x) AS joint, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM x GROUP BY disc_id)) AS t,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM x GROUP BY cluster)) AS p)
SELECT round(joint / p, 6) AS precision, round(joint / t, 6) AS recall FROM s
""")
def association_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _clusters(spark, d).join(observed(spark, d).select("trace_id", "disc_id"), "trace_id")
    return aggs.pair_scores(rows, "disc_id", "cluster").select(r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"))


@query()
def verified_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Agglomeration that verifies each merge; sequential, so without SQL."""
    return association.agglomerate(observed(spark, d), _gated(spark, d))


@query(f"""
WITH RECURSIVE {CLUSTERS}, x AS (SELECT dense_rank() OVER (ORDER BY face_id) AS k, disc_id, cluster FROM g JOIN {OBSERVED} o USING (trace_id)),
s AS (SELECT (SELECT count(*) FROM x a JOIN x b ON b.k = a.k + 1 AND a.disc_id = b.disc_id AND a.cluster = b.cluster)::DOUBLE AS joint,
  (SELECT count(*) FROM x a JOIN x b ON b.k = a.k + 1 AND a.disc_id = b.disc_id) AS t, (SELECT count(*) FROM x a JOIN x b ON b.k = a.k + 1 AND a.cluster = b.cluster) AS p)
SELECT round(joint / p, 6) AS precision, round(joint / t, 6) AS recall FROM s
""")
def adjacent_face_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _clusters(spark, d).join(observed(spark, d).select("trace_id", "disc_id", "face_id"), "trace_id")
    scores = association.adjacent_pair_scores(rows, "disc_id", "cluster", "face_id")
    return scores.select(r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"))


@query(f"""
WITH RECURSIVE {CLUSTERS}, x AS (SELECT cluster, disc_id, nx, ny, nz FROM g JOIN {OBSERVED} o USING (trace_id)),
m AS (SELECT cluster, disc_id, count(*) AS votes FROM x GROUP BY cluster, disc_id QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, disc_id) = 1),
f AS (SELECT cluster, arg_min(nx, trace_id) AS nx, arg_min(ny, trace_id) AS ny, arg_min(nz, trace_id) AS nz, count(*) AS n FROM g JOIN {OBSERVED} o USING (trace_id) GROUP BY cluster)
SELECT cluster, m.disc_id, votes, n, round(degrees(acos(least(1.0::DOUBLE, abs(f.nx * d.nx + f.ny * d.ny + f.nz * d.nz)))), 4) AS angle FROM m JOIN f USING (cluster) JOIN {{d}} d ON d.disc_id = m.disc_id
""")
def majority_truth(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's most frequent disc, its votes, and the angle between that
    disc and the cluster's first trace."""
    rows = _clusters(spark, d).join(observed(spark, d).select("trace_id", "disc_id", "n"), "trace_id")
    votes = rows.groupBy("cluster", "disc_id").agg(F.count("*").alias("votes"))
    best = votes.groupBy("cluster").agg(F.min(F.struct((-F.col("votes")).alias("less"), "disc_id")).alias("b"))
    first = rows.groupBy("cluster").agg(F.min_by("n", "trace_id").alias("axis"), F.count("*").alias("n"))
    joined = best.select("cluster", "b.disc_id", (-F.col("b.less")).alias("votes")).join(first, "cluster")
    joined = joined.join(discs(spark, d).select("disc_id", F.col("n").alias("true_axis")), "disc_id")
    return joined.select("cluster", "disc_id", "votes", "n", F.round(vec.axial_angle(F.col("axis"), F.col("true_axis")), 4).alias("angle"))


COVARIANCE = """c AS (SELECT set_id, count(*) AS n, avg(x * x) - avg(x) * avg(x) AS xx, avg(x * y) - avg(x) * avg(y) AS xy, avg(x * z) - avg(x) * avg(z) AS xz,
  avg(y * y) - avg(y) * avg(y) AS yy, avg(y * z) - avg(y) * avg(z) AS yz, avg(z * z) - avg(z) * avg(z) AS zz FROM (SELECT set_id, x, y, z + trace_id * 13 % 7 * 0.2::DOUBLE AS z FROM {o} o) r GROUP BY set_id HAVING count(*) > 5),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
e AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3)))) / 3 + 2 * pi() / 3) AS e FROM p),
m AS (SELECT *, greatest(0, (yy - e) * (zz - e) - yz * yz) AS mx, greatest(0, (xx - e) * (zz - e) - xz * xz) AS my, greatest(0, (xx - e) * (yy - e) - xy * xy) AS mz FROM e)""".replace("{o}", OBSERVED)


@query(f"""
WITH {COVARIANCE}
SELECT set_id, n, round(sqrt(greatest(e, 0)), 5) AS rmse, round(sqrt(mx / (mx + my + mz)), 4) AS nx, round(sqrt(my / (mx + my + mz)), 4) AS ny, round(sqrt(mz / (mx + my + mz)), 4) AS nz FROM m
""")
def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    """Plane through the middles, made uneven, of each set of six traces or
    more."""
    rows = observed(spark, d).select("set_id", "x", "y", (F.col("z") + F.col("trace_id") * 13 % 7 * 0.2).alias("z"))
    found = association.plane_fit(rows, "set_id").filter("n > 5")
    return found.select("set_id", "n", F.round("rmse", 5).alias("rmse"), *[F.round(c, 4).alias(c) for c in ("nx", "ny", "nz")])


HELD = f"""o AS (SELECT * FROM {OBSERVED} o), k AS (SELECT f AS held, disc_id FROM range(12) x(f) JOIN o ON round(o.x, 3) != round(f * 3.0::DOUBLE, 3) GROUP BY ALL),
p AS (SELECT o.face_id, o.set_id, o.trace_id, o.y + (o.disc_id % 13) * 0.1::DOUBLE AS y, o.z, o.h, o.dy, o.dz FROM o JOIN k ON k.held = o.face_id AND k.disc_id = o.disc_id),
h AS (SELECT o.face_id, o.set_id, count(*) AS n_observed, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.face_id = o.face_id AND p.set_id = o.set_id
    AND hypot(p.y - o.y, p.z - o.z) <= 0.5 AND abs(p.dy * o.dz - p.dz * o.dy) <= 0.3)) AS hits, sum(2 * h) AS len_observed FROM o GROUP BY ALL),
w AS (SELECT p.face_id, p.set_id, count(*) AS n_predicted, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE p.face_id = o.face_id AND p.set_id = o.set_id
    AND hypot(p.y - o.y, p.z - o.z) <= 0.5 AND abs(p.dy * o.dz - p.dz * o.dy) <= 0.3)) AS right_ones, sum(2 * h) AS len_predicted FROM p GROUP BY ALL)"""


@query(f"""
WITH {HELD} SELECT h.face_id, h.set_id, n_observed, coalesce(n_predicted, 0) AS n_predicted, round(hits / n_observed, 6) AS recall, round(right_ones / n_predicted, 6) AS precision,
  round(coalesce(len_predicted, 0) / len_observed, 6) AS length_ratio FROM h LEFT JOIN w USING (face_id, set_id)
""")
def held_out_faces(spark: SparkSession, d: str) -> DataFrame:
    """Each face held out in turn: discs seen on other faces predict its
    traces.  Only discs seen twice predict anything, so a disc's number of
    faces tells it, and no face is left out of a scan in turn."""
    rows = observed(spark, d)
    faces = rows.groupBy("disc_id").agg(F.countDistinct(F.round("x", 3)).alias("seen"))
    known = rows.join(faces.filter("seen > 1"), "disc_id").drop("seen").withColumn("y", F.col("y") + (F.col("disc_id") % 13) * 0.1)

    def matched(left: DataFrame, right: DataFrame, n: str, hit: str, length: str) -> DataFrame:
        pairs = joins.grid_pairs(left, right, ["face_id", "set_id"], {"y": 0.5, "z": 0.5})
        near = F.hypot(F.col("a.y") - F.col("b.y"), F.col("a.z") - F.col("b.z")) <= 0.5
        turned = F.abs(F.col("a.dy") * F.col("b.dz") - F.col("a.dz") * F.col("b.dy")) <= 0.3
        hits = pairs.filter(near & turned).select(F.col("a.trace_id").alias("trace_id")).distinct().withColumn("hit", F.lit(1))
        return left.join(hits, "trace_id", "left").groupBy("face_id", "set_id").agg(F.count("*").alias(n), F.count("hit").alias(hit), F.sum(2 * F.col("h")).alias(length))

    seen = matched(rows, known, "n_observed", "hits", "len_observed")
    told = matched(known, rows, "n_predicted", "right", "len_predicted")
    joined = seen.join(told, ["face_id", "set_id"], "left")
    return joined.select(
        "face_id", "set_id", "n_observed", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), r6(F.col("hits") / F.col("n_observed"), "recall"),
        r6(F.col("right") / F.col("n_predicted"), "precision"), r6(F.coalesce("len_predicted", F.lit(0.0)) / F.col("len_observed"), "length_ratio"),
    )


@query(f"""
SELECT set_id, trace_id, face_id FROM {OBSERVED} o WHERE round(x, 3) NOT IN (0.0, 9.0) AND abs(nx * nx + ny * ny + nz * nz - 1) < 1e-6
""")
def training_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces with a valid normal that are not on a face held out."""
    rows = observed(spark, d).filter(~F.round("x", 3).isin(0.0, 9.0))
    return rows.filter(F.abs(vec.dot(F.col("n"), F.col("n")) - 1) < 1e-6).select("set_id", "trace_id", "face_id")


COST = "(a.y - b.y) ** 2 + (a.z - b.z) ** 2 + (2 * a.h - 2 * b.h) ** 2 / 2 + abs(a.dy * b.dz - a.dz * b.dy)"
LINKS = f"""l AS (SELECT b.trace_id AS cur, a.trace_id AS prev, {COST} AS cost FROM {OBSERVED} a JOIN {OBSERVED} b ON a.set_id = b.set_id AND b.face_id = a.face_id + 1
  WHERE {COST} < 10 QUALIFY row_number() OVER (PARTITION BY b.trace_id ORDER BY {COST}, a.trace_id) = 1)"""


def _predecessors(spark: SparkSession, d: str) -> DataFrame:
    rows = observed(spark, d).select("trace_id", "set_id", "y", "z", "h", "dy", "dz", F.col("face_id").alias("at"))
    before = rows.withColumn("at", F.col("at") + 1)
    step = lambda c, k=1.0: (k * (F.col(f"a.{c}") - F.col(f"b.{c}"))) * (k * (F.col(f"a.{c}") - F.col(f"b.{c}")))
    turned = F.abs(F.col("a.dy") * F.col("b.dz") - F.col("a.dz") * F.col("b.dy"))
    cost = step("y") + step("z") + step("h", 2.0) / 2 + turned
    reach = {"y": math.sqrt, "z": math.sqrt, "h": lambda x: math.sqrt(x / 2)}
    found = joins.cheapest(rows, before, ["set_id", "at"], "trace_id", reach, F.when(cost < 10, cost), 10.0)
    return found.select(F.col("trace_id").alias("cur"), F.col("other").alias("prev"), "cost")


@query(f"WITH {LINKS} SELECT cur, prev, round(cost, 6) AS cost FROM l")
def nearest_predecessor(spark: SparkSession, d: str) -> DataFrame:
    """Each trace's cheapest trace on the face before, if its cost is under 10."""
    return _predecessors(spark, d).select("cur", "prev", r6(F.col("cost"), "cost"))


@query(f"""
WITH RECURSIVE {LINKS}, t AS (SELECT trace_id AS head, trace_id, 1 AS length FROM {OBSERVED} o WHERE trace_id NOT IN (SELECT cur FROM l)
  UNION ALL SELECT t.head, l.cur, t.length + 1 FROM t JOIN l ON l.prev = t.trace_id)
SELECT head, max(length)::BIGINT AS n_faces, count(*) AS n_traces FROM t GROUP BY head HAVING max(length) >= 3
""")
def tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of predecessors over three faces or more: pointers to the head
    are doubled, so a chain of n links takes log n joins."""
    found = windows.chains(observed(spark, d).select("trace_id"), _predecessors(spark, d), "trace_id", "cur", "prev")
    return found.groupBy("head").agg((F.max("depth") + 1).alias("n_faces"), F.count("*").alias("n_traces")).filter("n_faces >= 3")


@query(f"""
WITH p AS (SELECT i, j, apart FROM ({GATED}) q), x AS (SELECT term, weight FROM (VALUES ('all', 1.0::DOUBLE), ('no_gate', 0.0::DOUBLE), ('half', 0.5::DOUBLE)) v(term, weight))
SELECT term, count(*) AS n_pairs, count(*) FILTER (weight * apart <= 1.5) AS kept FROM p, x GROUP BY term
""")
def term_ablation(spark: SparkSession, d: str) -> DataFrame:
    """How many candidate pairs remain as the distance term's weight changes;
    the settings are a table of fixed size."""
    terms = spark.createDataFrame([("all", 1.0), ("no_gate", 0.0), ("half", 0.5)], "term string, weight double")
    pairs = _gated(spark, d).crossJoin(F.broadcast(terms))
    return pairs.groupBy("term").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("weight") * F.col("apart") <= 1.5).alias("kept"))


@query(f"""
WITH RECURSIVE {CLUSTERS}, x AS (SELECT cluster, set_id, face_id, sum(2 * h) AS chord FROM g JOIN {OBSERVED} o USING (trace_id) GROUP BY ALL),
k AS (SELECT cluster, set_id, count(*) FILTER (chord >= 1.0) AS k FROM x GROUP BY ALL) SELECT set_id, k, count(*) AS n FROM k WHERE k >= 1 GROUP BY ALL
""")
def faces_per_disc(spark: SparkSession, d: str) -> DataFrame:
    """How many faces show each reconstructed disc; fragments on one face are
    one chord."""
    rows = _clusters(spark, d).join(observed(spark, d).select("trace_id", "set_id", "face_id", "h"), "trace_id")
    each = rows.groupBy("cluster", "set_id", "face_id").agg(F.sum(2 * F.col("h")).alias("chord"))
    counted = each.groupBy("cluster", "set_id").agg(F.count_if(F.col("chord") >= 1.0).alias("k")).filter("k >= 1")
    return counted.groupBy("set_id", "k").agg(F.count("*").alias("n"))


@query()
def greedy_links(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one links between neighbouring faces in order of cost;
    sequential, so without SQL."""
    rows = observed(spark, d).withColumn("at", F.col("face_id") + 1)
    later = observed(spark, d).withColumn("at", F.col("face_id"))
    apart = F.hypot(F.col("a.y") - F.col("b.y"), F.col("a.z") - F.col("b.z"))
    needed = ["trace_id", "set_id", "at", "y", "z"]
    return joins.greedy_near(rows.select(needed), later.select(needed), ["set_id", "at"], "trace_id", ["y", "z"], F.round(apart, 6), 2.0)


def _stage(k: int) -> str:
    """SQL of one stage of the chord search: 61 positions a cluster, the best
    of them and of the stages before, and the next bounds."""
    loss = "sum((sqrt(greatest(ms - 2 * q * mh + q * q - (h - q) * (h - q), 0)) - a) * (sqrt(greatest(ms - 2 * q * mh + q * q - (h - q) * (h - q), 0)) - a))"
    best = "n.n.loss AS loss, n.n.q AS q" if k == 0 else "CASE WHEN n.n.loss < s.loss THEN n.n.loss ELSE s.loss END AS loss, CASE WHEN n.n.loss < s.loss THEN n.n.q ELSE s.q END AS q"
    return f"""n{k} AS (SELECT cluster, {{'loss': loss, 'q': q}} AS n FROM (SELECT cluster, q, {loss} AS loss FROM (SELECT cluster, ms, mh, low + (high - low) * i / 60 AS q FROM s{k}, range(61) r(i)) g JOIN f USING (cluster) GROUP BY cluster, q) l
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY loss, q) = 1),
s{k + 1} AS (SELECT * REPLACE (q - (high - low) / 60 AS low, q + (high - low) / 60 AS high) FROM (SELECT s.* EXCLUDE (loss, q), {best} FROM s{k} s JOIN n{k} n USING (cluster)) b)"""


FITTED = f"""t AS (SELECT cluster, trace_id, face_id, x, y, z, h, dy, dz, nx, ny, nz FROM g JOIN {OBSERVED} o USING (trace_id)),
ends AS (SELECT cluster, trace_id, x, y + s * h * dy AS y, z + s * h * dz AS z FROM t, (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) v(s)),
m AS (SELECT cluster, count(*) // 2 AS n_traces, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(x * x) - avg(x) * avg(x) AS xx, avg(x * y) - avg(x) * avg(y) AS xy, avg(x * z) - avg(x) * avg(z) AS xz,
  avg(y * y) - avg(y) * avg(y) AS yy, avg(y * z) - avg(y) * avg(z) AS yz, avg(z * z) - avg(z) * avg(z) AS zz FROM ends GROUP BY cluster HAVING count(*) >= 4),
w AS (SELECT cluster, arg_min(nx, trace_id) AS nx, arg_min(ny, trace_id) AS ny, arg_min(nz, trace_id) AS nz FROM t GROUP BY cluster),
planes AS (SELECT cluster, n_traces, cx, cy, cz, CASE WHEN coalesce(ax, nx0) < 0 THEN -1 ELSE 1 END AS s, s * coalesce(ax, nx0) AS nx, s * coalesce(ay, ny0) AS ny, s * coalesce(az, nz0) AS nz,
  sqrt(greatest(1 - nx * nx, 0)) AS flat FROM (SELECT a.*, w.nx AS nx0, w.ny AS ny0, w.nz AS nz0 FROM {vec.sql_axis("m", "a", True)} a JOIN w USING (cluster)) j),
f AS (SELECT cluster, round(e.x, 3) AS face, any_value(n_traces) AS n_traces, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz,
  any_value(flat) AS flat, (min(e.x) - any_value(cx)) / any_value(flat) AS h, min(((e.y - cy) * nz - (e.z - cz) * ny) / sqrt(ny * ny + nz * nz)) AS lo, max(((e.y - cy) * nz - (e.z - cz) * ny) / sqrt(ny * ny + nz * nz)) AS hi,
  (hi - lo) / 2 AS a, (hi + lo) / 2 AS u FROM planes JOIN ends e USING (cluster) WHERE flat >= 1e-6 GROUP BY cluster, face),
s0 AS (SELECT cluster, any_value(n_traces) AS n_traces, count(*) AS n_faces, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, any_value(flat) AS flat,
  avg(u) AS p, avg(h) AS mh, avg(h * h + a * a) AS ms, min(h) - 3 AS low, max(h) + 3 AS high, NULL::DOUBLE AS loss, NULL::DOUBLE AS q FROM f GROUP BY cluster HAVING count(*) >= 2),
{_stage(0)}, {_stage(1)}, {_stage(2)}"""


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    return chordfit.chord_fit(_clusters(spark, d).join(observed(spark, d), "trace_id"))


@query(f"""
WITH RECURSIVE {CLUSTERS}, {FITTED}
SELECT cluster, n_traces, n_faces, round(cx + q * flat, 5) + 0.0::DOUBLE AS cx, round(cy + p * nz / flat - q * nx * ny / flat, 5) + 0.0::DOUBLE AS cy, round(cz - p * ny / flat - q * nx * nz / flat, 5) + 0.0::DOUBLE AS cz,
  round(sqrt(ms - 2 * q * mh + q * q), 5) + 0.0::DOUBLE AS radius, round(loss, 6) + 0.0::DOUBLE AS loss FROM s3
""")
def chord_fits(spark: SparkSession, d: str) -> DataFrame:
    """Disc of every cluster that several faces show, by its chords there."""
    r5 = lambda x, name: (F.round(x, 5) + F.lit(0.0)).alias(name)
    return _fitted(spark, d).select("cluster", "n_traces", "n_faces", *[r5(F.col(f"c.{k}"), f"c{k}") for k in "xyz"], r5(F.col("radius"), "radius"), r6(F.col("loss"), "loss"))
