"""Sequential association and fits against plain versions."""

import math

import numpy as np
from pyspark.sql import functions as F

from tracefield.operators import association, fitting, joins, sampling
from tracefield.plans import QUERIES
from tracefield.plans import association_queries as queries
from tracefield.plans.registry import discs, normals


def plain_clusters(traces, pairs):
    """Merging over all traces at once, without a split by components."""
    ids = [r["trace_id"] for r in traces]
    at = {t: k for k, t in enumerate(ids)}
    middle = np.array([[r["x"], r["y"], r["z"]] for r in traces])
    reach = np.array([[0.0, r["h"] * r["dy"], r["h"] * r["dz"]] for r in traces])
    cluster = {k: {k} for k in range(len(ids))}
    for _, i, j in sorted((r["off"], r["i"], r["j"]) for r in pairs):
        a, b = (next(c for c in cluster.values() if at[t] in c) for t in (i, j))
        if a is b:
            continue
        members = sorted(a | b)
        points = np.concatenate([middle[members] - reach[members], middle[members] + reach[members]])
        shifted = points - points.mean(axis=0)
        _, size, axes = np.linalg.svd(shifted)
        if math.sqrt((size[2] ** 2) / len(points)) > 0.08:
            continue
        along = np.cross(axes[2], [1.0, 0.0, 0.0])
        if np.linalg.norm(along) >= 1e-6:
            across = np.cross(axes[2], along / np.linalg.norm(along))
            faces = {}
            for k in members:
                faces.setdefault(round(middle[k][0], 3), []).append(middle[k] @ across)
            if any(max(v) - min(v) > 0.25 for v in faces.values()):
                continue
        a |= b
        cluster = {k: c for k, c in cluster.items() if c is not b}
    return {ids[k]: min(ids[m] for m in c) for c in cluster.values() for k in c}


def test_verified_clusters(spark, sf_dir):
    traces = queries.observed(spark, sf_dir)
    # candidates of several discs, so that merges are refused too
    pairs = association.gated_pairs(traces, 40.0, 2.0).cache()
    expected = plain_clusters(traces.collect(), pairs.collect())
    got = {r["trace_id"]: r["cluster"] for r in association.agglomerate(traces, pairs).collect()}
    assert got == expected and 1 < len(set(got.values())) < len(got)
    assert association.agglomerate(traces.limit(0), pairs.limit(0)).count() == 0
    # a component in several levels of pairs, none of them whole in a task
    levels = association.agglomerate(traces, pairs, at_once=max(1, pairs.count() // 4))
    assert {r["trace_id"]: r["cluster"] for r in levels.collect()} == expected


def test_exponent_is_recovered(spark):
    u = lambda name: sampling.uniform(11, name, F.col("id"))
    radius = sampling.powerlaw_radius(u("r"), 2.0, 0.25, 12.5)
    rows = spark.range(30_000).select("id", radius.alias("r")).withColumn("whole", 2 * F.col("r") * F.sqrt(1 - u("o") * u("o")))
    rows = rows.withColumn("visible", F.col("whole")).withColumn("cls", F.lit(0)).withColumn("set_id", F.lit(1))
    masses = fitting.chord_masses(spark, [0.5 * k for k in range(9)], 1.0, 26.0, 10, 0.25, 12.5)
    model = fitting.model_table(masses, fitting.window_kernel(rows, 1.0, 26.0, 10))
    counts = rows.select("set_id", fitting.bin_of(F.col("visible"), 1.0, 26.0, 10).alias("i"), "cls").filter("i IS NOT NULL")
    counts = counts.groupBy("set_id", "i", "cls").agg(F.count("*").alias("n"))
    assert fitting.best_exponent(fitting.likelihood(counts, model, ["set_id"]), ["set_id"]).first()["kr"] == 2.0


def test_bootstrap_weights_are_poisson(spark):
    rows = spark.range(4000).select("id", F.lit(1).alias("k"))
    counts = [r["n"] for r in fitting.bootstrap_counts(rows, ["k"], "id", 30).collect()]
    assert len(counts) == 30 and abs(np.mean(counts) - 4000) < 60 and 30 < np.std(counts) < 110


def test_segment_distances_against_a_fine_grid(spark, sf_dir):
    at = {r["disc_id"]: (np.array(r["c"]), np.array(r["n"])) for r in discs(spark, sf_dir).collect()}
    s = np.linspace(0, 1, 201)
    for r in QUERIES["segment_distances"](spark, sf_dir).limit(40).collect():
        (c, n), (e, m) = at[r["disc_id"]], at[r["disc_id"] + 1]
        gaps = (c + s[:, None, None] * n) - (e + s[None, :, None] * m)
        least = np.sqrt((gaps**2).sum(axis=2)).min()
        assert least - 0.02 <= r["distance"] <= least + 1e-6


def test_principal_axis_is_the_top_eigenvector(spark, sf_dir):
    groups = {}
    for r in normals(spark, sf_dir).collect():
        groups.setdefault(r["label"], []).append(list(r["n"]))
    for r in QUERIES["principal_axis"](spark, sf_dir).collect():
        axes = np.array(groups[r["label"]])
        tensor, v = axes.T @ axes / len(axes), np.array([r["ex"], r["ey"], r["ez"]])
        assert np.allclose(tensor @ v, r["value"] * v, atol=1e-9) and r["value"] >= np.linalg.eigvalsh(tensor)[-1] - 1e-9


def test_bootstrap_interval_holds_the_mean(spark, sf_dir):
    means = {r["event_type"]: r["m"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.avg("value").alias("m")).collect()}
    for r in QUERIES["bootstrap_interval"](spark, sf_dir).collect():
        assert r["low"] < means[r["set_id"]] < r["high"]


def test_generated_discs_follow_their_laws(spark, sf_dir):
    rows = QUERIES["generated_discs"](spark, sf_dir).collect()
    assert all(0.5 <= r["radius"] <= 250 and abs(sum(x * x for x in r["n"]) - 1) < 1e-9 for r in rows)
    assert rows == QUERIES["generated_discs"](spark, sf_dir).collect()


def test_assigned_pairs_are_the_cheapest(spark):
    import itertools
    import random

    rng = random.Random(9)
    pairs = [(g, i, j, round(rng.random(), 3)) for g in range(6) for i in range(4) for j in range(4) if rng.random() < 0.7]
    got = joins.assign(spark.createDataFrame(pairs, "g int, i int, j int, cost double"), ["g"], "i", "j", "cost").collect()
    for g in range(6):
        cost = {(i, j): c for h, i, j, c in pairs if h == g}
        every = [tuple(zip(a, b)) for k in range(5) for a in itertools.combinations(range(4), k) for b in itertools.permutations(range(4), k)]
        best = min((-len(m), sum(cost[p] for p in m)) for m in every if all(p in cost for p in m))
        own = [r for r in got if r["g"] == g]
        assert len(own) == -best[0] and abs(sum(r["cost"] for r in own) - best[1]) < 1e-9


def test_transport_is_an_assignment_of_its_units():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, m = rng.integers(1, 6, 2)
        costs = np.where(rng.random((n, m)) < 0.7, rng.integers(0, 9, (n, m)).astype(float), np.inf)
        supply, demand = rng.integers(1, 5, n), rng.integers(1, 5, m)
        r, c, k = joins.transport(costs, supply, demand)
        assert (k > 0).all() and np.isfinite(costs[r, c]).all()
        assert (np.bincount(r, k, n) <= supply).all() and (np.bincount(c, k, m) <= demand).all()
        units = np.repeat(np.repeat(costs, supply, axis=0), demand, axis=1)
        p, q, one = joins.transport(units, np.ones(len(units), int), np.ones(units.shape[1], int))
        assert k.sum() == one.sum() and abs((costs[r, c] * k).sum() - units[p, q].sum()) < 1e-9


def test_assigned_discs_of_one_place_are_solved_as_one(spark, tmp_path, monkeypatch):
    """400 discs in a few places: by rows a matrix of 240 by 160."""
    largest, assign, solve = [], joins.assign, joins.transport
    monkeypatch.setattr(joins, "assign", lambda pairs, *rest: largest.append(pairs.count()) or assign(pairs, *rest))
    period = 40 * 23 * 19
    keys = [at + period * k for at, n in ((1, 80), (41, 80), (81, 80), (5, 100), (45, 60)) for k in range(n)]
    parts = spark.createDataFrame([(k, "Brand#1", 8) for k in keys], "p_partkey long, p_brand string, p_size int")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["assigned_pairs"](spark, str(tmp_path)).collect()
    assert largest[0] <= 6
    left, right = [k for k in keys if k % 40 == 1], [k for k in keys if k % 40 == 5]
    gap = lambda i, j: math.hypot((i * 7 % 23) - (j * 7 % 23), (i * 5 % 19) - (j * 5 % 19))
    costs = np.array([[gap(i, j) if gap(i, j) <= 9 else np.inf for j in right] for i in left])
    r, c, _ = solve(costs, np.ones(len(left), int), np.ones(len(right), int))
    assert len(rows) == len(r) == len({x.i for x in rows}) == len({x.j for x in rows})
    assert all(math.isclose(x.cost, gap(x.i, x.j)) and x.cost <= 9 for x in rows)
    assert math.isclose(sum(x.cost for x in rows), costs[r, c].sum())


def test_nearest_makes_no_pairs_and_keeps_ties(spark):
    from tracefield.operators import joins

    left = [(i, i % 2, float(i * 7 % 30)) for i in range(40)] + [(40, None, 1.0), (41, 0, None), (42, 3, 5.0), (43, 0, 500.0)]
    right = [(i, i % 2, float(i * 11 % 24)) for i in range(60)] + [(60, 0, None), (61, None, 1.0), (62, 3, 5.0)]
    schema = "id long, k int, at double"
    got = joins.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "id", "at", 3.0)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, k, p in left:
        near = sorted((abs(p - q), j, q) for j, m, q in right if None not in (k, p, q) and m == k and abs(p - q) <= 3.0)
        if near:
            second = near[1][0] if len(near) > 1 else None
            want[i] = (near[0][1], near[0][2], near[0][0], near[0][0] / second if second else None)
    assert {r.id: (r.o_id, r.o_at, r.distance, r.ratio) for r in got.collect()} == want


def test_widening_search_finds_the_cheapest(spark):
    import random

    rng = random.Random(4)
    rows = [(i, i % 2, rng.randrange(8) * 1.0, rng.random() * 8) for i in range(240)] + [(240, 0, 300.0, 1.0), (241, 1, None, 1.0)]
    frame = spark.createDataFrame(rows, "id long, k int, x double, y double")
    apart = F.abs(F.col("a.x") - F.col("b.x")) + F.floor(F.abs(F.col("a.y") - F.col("b.y")) * 4) / 4
    cost = F.when(F.col("a.id") != F.col("b.id"), apart)
    reach = {"x": lambda c: c, "y": lambda c: c + 0.25}
    want = {}
    for i, k, x, y in rows[:-1]:
        near = [(abs(x - p) + math.floor(abs(y - q) * 4) / 4, j) for j, m, p, q in rows[:-1] if m == k and j != i]
        if min(near)[0] <= 6:
            want[i] = min(near)
    for levels in (0, 4):
        got = joins.cheapest(frame, frame, ["k"], "id", reach, cost, 6.0, levels).collect()
        assert {r["id"]: (r["cost"], r["other"]) for r in got} == want and len(got) == len(want) < len(rows)


def test_pairs_are_made_on_all_partitions(spark):
    """A few rows of a file that one task reads, which the planner would send
    to every task or read in one."""
    rows = spark.range(400).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 20).cast("double").alias("x")).coalesce(1)
    pairs = joins.grid_pairs(rows, rows, ["k"], {"x": 1.0})
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_end_pairs_are_not_shuffled_and_meet_once(spark):
    rows = [(i, 0, float(i % 5), float(i % 3), float((i * 2) % 5), float((i * 7) % 3)) for i in range(40)]
    frame = spark.createDataFrame(rows, "trace_id long, k int, y0 double, z0 double, y1 double, z1 double")
    pairs = joins.end_pairs(frame, ["k"], 1.0, "trace_id")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    ends = {r[0]: ((r[2], r[3]), (r[4], r[5])) for r in rows}
    near = {(i, j): min(math.hypot(p[0] - q[0], p[1] - q[1]) for p in ends[i] for q in ends[j]) for i in ends for j in ends if i < j}
    got = [(r.a.trace_id, r.b.trace_id, r.gap) for r in pairs.collect()]
    assert len(got) == len(set(got)) and {(i, j): g for i, j, g in got} == {k: g for k, g in near.items() if g <= 1.0}


def test_forest_is_small_and_connects_the_same(spark):
    from tracefield.operators import graph

    # a ring of 50, and all pairs of 300 others
    ring = spark.range(50).select(F.col("id").alias("a"), ((F.col("id") + 1) % 50).alias("b"))
    many = spark.range(300).select((F.col("id") + 100).alias("a")).crossJoin(spark.range(300).select((F.col("id") + 100).alias("b")))
    edges = ring.unionByName(many).repartition(4)
    thin = graph.forest(edges)
    assert thin.count() <= 4 * 350 and thin.filter("a >= b").count() == 0
    found = graph.components(spark.range(401), edges).collect()
    assert {r.id: r.component for r in found} == {k: 0 if k < 50 else 100 if 100 <= k < 400 else k for k in range(401)}
    assert graph.forest(edges.limit(0)).count() == 0


def test_dense_points_are_linked_by_few_edges(spark):
    import random

    from tracefield.operators import graph

    rng = random.Random(8)
    dense = [(i, 0, rng.random() * 3, rng.random() * 3) for i in range(300)]
    sparse = [(300 + i, i % 2, 5 + rng.random() * 12, rng.random() * 12) for i in range(160)]
    odd = [(460, None, 1.0, 1.0), (461, 0, None, 1.0), (462, 0, float("nan"), 1.0), (463, 0, 1.0, 1.0)]
    rows = dense + sparse + odd
    near = lambda p, q: p[1] is not None and p[1] == q[1] and None not in (p[2], q[2]) and math.hypot(p[2] - q[2], p[3] - q[3]) <= 1.0
    pairs = {(p[0], q[0]) for p in rows for q in rows if near(p, q)}
    cores = {i for i in range(464) if sum((i, j) in pairs for j in range(464)) >= 3}
    want = {i: i for i in cores}
    while True:
        moved = {i: min(want[j] for j in cores if (i, j) in pairs) for i in cores}
        if moved == want:
            break
        want = moved
    points = spark.createDataFrame(rows, "id long, k int, x double, y double")
    found, links = graph.core_points(points, ["k"], 1.0, 3)
    assert {r.id: r.component for r in graph.components(found, links).collect()} == want
    # all pairs of cores would be thousands
    assert links.count() < 1500 < len(pairs) / 2


def test_pairs_meet_by_their_planes(spark):
    import random

    rng, rows = random.Random(3), []
    for k in range(260):
        v = np.array([1.0, 0.3, 0.2] if k % 2 else [0.0, 0.1, 1.0]) + [rng.gauss(0, 0.25) for _ in range(3)]
        v *= (1 if rng.random() < 0.5 else -1) / np.linalg.norm(v)
        rows.append((k, str(k % 2), 3.0 * rng.randrange(12), rng.random() * 60 - 30, rng.random() * 6 - 3, tuple(map(float, v))))
    frame = spark.createDataFrame(rows, "trace_id long, set_id string, x double, y double, z double, n struct<x:double,y:double,z:double>").cache()
    for separation in (5.0, 12.0):
        want = set()
        for i, s, *p, n in rows:
            for j, t, *q, m in rows:
                step = np.subtract(q, p)
                if i < j and s == t and np.linalg.norm(step) <= separation and abs(np.dot(n, m)) >= math.cos(math.radians(12)) and max(abs(step @ n), abs(step @ m)) <= 0.5:
                    want.add((i, j))
        got = [(r.i, r.j) for r in association.coplanar_pairs(frame, 12.0, 0.5, separation).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        met = association._met(frame, dict.fromkeys("xyz", separation), 12.0, 0.5, separation).count()
        near = joins.grid_pairs(frame, frame, ["set_id"], dict.fromkeys("xyz", separation)).count()
        assert met < near / 2


def test_greedy_near_takes_the_pairs_of_greedy_match(spark, monkeypatch):
    import random

    rng = random.Random(6)
    side = lambda n: [(i, i % 2, round(rng.random() * 9, 1), round(rng.random() * 9, 1)) for i in range(n)]
    left, right = side(150), side(120)
    a, b = (spark.createDataFrame(r, "id long, k int, y double, z double") for r in (left, right))
    cost = F.round(F.hypot(F.col("a.y") - F.col("b.y"), F.col("a.z") - F.col("b.z")), 6)
    every = sorted((round(math.hypot(y - p, z - q), 6), i, j) for i, k, y, z in left for j, m, p, q in right if k == m and math.hypot(y - p, z - q) <= 2)
    want, seen, made, match = set(), (set(), set()), [], joins.greedy_match
    for c, i, j in every:
        if i not in seen[0] and j not in seen[1]:
            want.add((i, j, c))
            seen[0].add(i)
            seen[1].add(j)
    monkeypatch.setattr(joins, "greedy_match", lambda pairs, *rest: made.append(pairs.count()) or match(pairs, *rest))
    got = joins.greedy_near(a, b, ["k"], "id", ["y", "z"], cost, 2.0, 3).collect()
    assert {(r.i, r.j, r.cost) for r in got} == want and len(got) == len(want)
    assert len(made) == 4 and sum(made) < len(every) / 2


def test_bootstrap_hashes_once_on_all_partitions(spark):
    rows = spark.range(300).coalesce(1)
    drawn = sampling.bootstrap(rows, 20, 7, "id")
    assert drawn.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    u = sampling.uniform(7, "bootstrap", F.col("id").cast("string"), F.col("draw"))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    draws = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("u", u).collect()
    want = {(r.id, r.draw): int((r.u > steps).sum()) for r in draws}
    got = {(r.id, r.draw): r.weight for r in drawn.collect()}
    assert got == {k: w for k, w in want.items() if w} and len(draws) == 6000


def test_discs_are_clipped_on_all_partitions(spark, sf_dir):
    assert QUERIES["clipped_discs"](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
