"""Ranking, survival and sequential windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def in_ranges(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """``rows`` dealt to ranges of their group and ``order``, with the range's
    number as ``_part``.  Rows equal in both share a range; a large group has
    many.  Checkpointed, since the ranges come from a sample."""
    return graph.cut_lineage(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, by: list[str], order: list, values: dict[str, Column], peers: bool = False) -> DataFrame:
    """``rows`` with running sums of ``values`` in ascending ``order`` within
    groups, up to the row itself (with ``peers``, to the last equal in
    ``order``), and the groups' totals as ``<name>_total``.

    A distributed prefix sum: ranges (see ``in_ranges``) are summed, the few
    sums are summed before each range, and a window runs within each range, so
    no group has to fit one task.  Rows that are already in ranges stay there.
    """
    placed = rows if "_part" in rows.columns else in_ranges(rows, by, order)
    sums = placed.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    for k in values:
        sums = sums.withColumn(f"_before_{k}", F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)))
        sums = sums.withColumn(f"{k}_total", F.sum(f"_sum_{k}").over(group)).drop(f"_sum_{k}")
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in (*by, "_part")], *[c for c in sums.columns if c not in (*by, "_part")])
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    within = within.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.select("*", *[F.sum(v).over(within).alias(k) for k, v in values.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in (*by, "_part")]
    out = placed.join(sums, same)
    for k in values:
        out = out.withColumn(k, F.col(k) + F.col(f"_before_{k}")).drop(f"_before_{k}")
    return out.drop(*[f"_by_{c}" for c in (*by, "_part")])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact quantiles ``q0, q1, ...`` per group, interpolated between the two
    values about each rank; values are found by rank, not gathered.  Nulls
    don't count."""
    ranked = running(rows.filter(F.col(value).isNotNull()), by, [value], {"_n": F.lit(1)})
    at = [(F.col("_n_total") - 1) * F.lit(float(p)) for p in shares]
    low = [F.max(F.when(F.col("_n") == F.floor(a) + 1, F.col(value))).alias(f"_low{k}") for k, a in enumerate(at)]
    high = [F.max(F.when(F.col("_n") == F.ceil(a) + 1, F.col(value))).alias(f"_high{k}") for k, a in enumerate(at)]
    found = ranked.groupBy(*by).agg(*low, *high, F.max("_n_total").alias("_n_total"))
    part = [a - F.floor(a) for a in at]
    return found.select(*by, *[(F.col(f"_low{k}") + part[k] * (F.col(f"_high{k}") - F.col(f"_low{k}"))).alias(f"q{k}") for k in range(len(shares))])


def best_row(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first row of each group by ``order``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def ecdf(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Empirical survival ``P(value > x)`` at each distinct value."""
    steps = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    summed = running(steps, [by], [value], {"_up_to": F.col("n")})
    survival = (F.col("_up_to_total") - F.col("_up_to")) / F.col("_up_to_total")
    return summed.withColumn("survival", survival).drop("_up_to", "_up_to_total", "_part")


def kaplan_meier(rows: DataFrame, by: str, value: str, event: Column, weight: Column | None = None) -> DataFrame:
    """Product-limit survival per group with risk, events and censored at each
    distinct value.  Counts meet per value first; risk and product are then
    distributed prefix sums over the values."""
    w = weight if weight is not None else F.lit(1.0)
    steps = rows.groupBy(by, value).agg(
        F.sum(w).alias("leaving"), F.sum(F.when(event, w).otherwise(0.0)).alias("events"), F.count("*").alias("n")
    )
    steps = running(steps, [by], [value], {"_left": F.col("leaving")})
    steps = steps.withColumn("risk", F.col("_left_total") - F.col("_left") + F.col("leaving")).drop("_left", "_left_total")
    left = 1 - F.col("events") / F.col("risk")
    logs = {"_log": F.when(left > 1e-12, F.log(left)).otherwise(0.0), "_ended": F.when(left <= 1e-12, 1).otherwise(0)}
    steps = running(steps, [by], [value], logs)
    survival = F.when(F.col("_ended") > 0, F.lit(0.0)).otherwise(F.exp("_log"))
    return steps.withColumn("survival", survival).drop("_log", "_ended", "_log_total", "_ended_total", "_part")


def survival_quantile(curve: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """The first value with survival at most ``1 - p``, else the last."""
    hit = F.min(F.when(F.col("survival") <= 1 - p + 1e-12, F.col(value)))
    return curve.groupBy(by).agg(F.coalesce(hit, F.max(value)).alias("quantile"))


def as_of(points: DataFrame, curve: DataFrame, by: str, at: str, value: str, start: float) -> DataFrame:
    """The last curve value at or before each point, ``start`` before the
    first.  One window over the union instead of a range join."""
    left = points.select(by, F.col(at).alias("_x"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_q"))
    right = curve.select(by, F.col(at).alias("_x"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_q"))
    order = Window.partitionBy(by).orderBy("_x", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn(value, F.last("_v", ignorenulls=True).over(order))
    return found.filter("_q = 1").select(by, F.col("_x").alias(at), F.coalesce(value, F.lit(start)).alias(value))


def interpolate(points: DataFrame, curve: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Linear interpolation of ``curve`` at ``points``, clamped at its ends."""
    left = points.select(by, F.col(x).alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_q"))
    right = curve.select(by, F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(0).alias("_q"))
    group = Window.partitionBy(by)
    node = F.when(F.col("_q") == 0, F.struct("_x", "_y"))
    back = F.last(node, ignorenulls=True).over(group.orderBy("_x", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first(node, ignorenulls=True).over(group.orderBy("_x", F.desc("_q")).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = left.unionByName(right).withColumn("_a", back).withColumn("_b", ahead).filter("_q = 1")
    a, b = F.col("_a"), F.col("_b")
    share = F.coalesce(F.try_divide(F.col("_x") - a["_x"], b["_x"] - a["_x"]), F.lit(0.0))
    value = F.when(a.isNull(), b["_y"]).when(b.isNull(), a["_y"]).otherwise(a["_y"] + share * (b["_y"] - a["_y"]))
    return found.select(by, F.col("_x").alias(x), value.alias(y))


def sequential_posterior(likelihoods: DataFrame, by: str, grid: str, step: str, value: str) -> DataFrame:
    """Running sums of log-likelihood over ``step`` per grid point, then the
    posterior at each step: argmax and the 95 % interval of the softmax."""
    running = F.sum(value).over(Window.partitionBy(by, grid).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = Window.partitionBy(by, step)
    post = likelihoods.withColumn("total", running)
    post = post.withColumn("weight", F.exp(F.col("total") - F.max("total").over(at)))
    post = post.withColumn("p", F.col("weight") / F.sum("weight").over(at))
    post = post.withColumn("cdf", F.sum("p").over(at.orderBy(grid).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    post = post.withColumn("rank", F.row_number().over(at.orderBy(F.desc("total"), F.asc(grid))))
    return post.groupBy(by, step).agg(
        F.max(F.when(F.col("rank") == 1, F.col(grid))).alias("argmax"),
        F.min(F.when(F.col("cdf") >= 0.025, F.col(grid))).alias("low"),
        F.min(F.when(F.col("cdf") >= 0.975, F.col(grid))).alias("high"),
    )


def rolling_windows(rows: DataFrame, position: str, width: int) -> DataFrame:
    """Each row once for every window of ``width`` consecutive positions that
    it lies in, as ``window_start``; every window is complete."""
    ranked = running(rows.select(position).distinct(), [], [position], {"rank": F.lit(1)})
    starts = ranked.withColumn(
        "window_start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("rank") - width), F.col("rank") - 1))
    )
    starts = starts.filter(F.col("window_start") + width <= F.col("rank_total")).select(position, "window_start")
    return rows.join(starts, position)


def arc_gap(rows: DataFrame, by: str, angle: str) -> DataFrame:
    """Largest gap between neighbouring angles on the circle, in degrees, and
    the arc that the angles cover."""
    group = Window.partitionBy(by).orderBy(angle)
    first = F.first(angle).over(Window.partitionBy(by).orderBy(angle))
    gap = F.coalesce(F.lead(angle).over(group), first + 360) - F.col(angle)
    gaps = rows.select(by, angle).distinct().withColumn("gap", gap)
    return gaps.groupBy(by).agg(F.max("gap").alias("max_gap"), (360 - F.max("gap")).alias("arc"))


def stratified_top(rows: DataFrame, flag: str, order: list[Column], total: int, flagged: int) -> DataFrame:
    """The first ``flagged`` rows with ``flag``, the rest up to ``total`` from
    those without; a shortfall on one side spills to the other.  Each side is
    cut to ``total`` rows per task before the few left are ranked."""
    sides = [rows.filter(F.col(flag) == k).orderBy(*order).limit(total) for k in (1, 0)]
    first = sides[0].unionByName(sides[1])
    side = Window.partitionBy(flag)
    ranked = first.withColumn("_rank", F.row_number().over(side.orderBy(*order)))
    every = Window.partitionBy()
    ranked = ranked.withColumn("_on", F.count_if(F.col(flag) == 1).over(every)).withColumn("_off", F.count_if(F.col(flag) == 0).over(every))
    quota_on = F.greatest(F.least("_on", F.lit(flagged)), F.least("_on", total - F.least(F.col("_off"), F.lit(total - flagged))))
    quota = F.when(F.col(flag) == 1, quota_on).otherwise(total - quota_on)
    return ranked.filter(F.col("_rank") <= quota).drop("_rank", "_on", "_off")


def chains(nodes: DataFrame, links: DataFrame, id: str, later: str, earlier: str) -> DataFrame:
    """``(id, head, depth)``: where each node's chain of ``links`` (at most one
    per ``later``, without rings) begins and how many links away.  Pointers are doubled, so the
    number of joins grows with the logarithm of the longest chain."""
    start = links.select(F.col(later).alias(id), F.col(earlier).alias("head"))
    at = nodes.select(id).join(start, id, "left").select(id, F.coalesce("head", id).alias("head"), F.col("head").isNotNull().cast("long").alias("depth"))
    at = graph.cut_lineage(at)
    while True:
        up = at.select(F.col(id).alias("head"), F.col("head").alias("above"), F.col("depth").alias("more"))
        moved = at.join(up, "head").select(id, F.col("above").alias("head"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        moved = graph.cut_lineage(moved)
        at = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            return at
