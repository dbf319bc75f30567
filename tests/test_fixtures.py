"""Small cases with results known by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tracefield.functions import geom, vec
from tracefield.operators import aggs, graph, joins, voxels, windows

SQUARE = geom.box(0.0, 0.0, 10.0, 10.0)


@pytest.mark.parametrize(
    "segment, length, cls",
    [((2, 5, 8, 5), 6, 0), ((-2, 5, 8, 5), 8, 1), ((-2, 5, 12, 5), 10, 2), ((-2, 20, 12, 20), 0, -1)],
)
def test_clip(spark, segment, length, cls):
    df = spark.createDataFrame([tuple(map(float, segment))], "a double, b double, c double, d double")
    row = geom.with_clip(df, [F.col(c) for c in "abcd"], SQUARE).first()
    assert row["clip_length"] == pytest.approx(length) and row["clip_class"] == cls


def test_polygon_area():
    assert geom.signed_area(SQUARE) == 100
    assert geom.counter_clockwise(SQUARE[::-1]) == SQUARE


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(1, float(x), k < 2) for k, x in enumerate([1, 2, 3, 4])], "g int, x double, event boolean")
    got = {r["x"]: r["survival"] for r in windows.kaplan_meier(df, "g", "x", F.col("event")).collect()}
    assert [round(got[x], 9) for x in (1.0, 2.0, 3.0, 4.0)] == [0.75, 0.5, 0.5, 0.5]
    every = {r["x"]: r["survival"] for r in windows.kaplan_meier(df, "g", "x", F.lit(True)).collect()}
    assert [round(every[x], 9) for x in (1.0, 2.0, 3.0, 4.0)] == [0.75, 0.5, 0.25, 0.0]


def test_trace_summary_has_nulls_for_absent_classes(spark):
    df = spark.createDataFrame([("a", 2.0, 0), ("a", 4.0, 0)], "set_id string, len double, cls int")
    row = aggs.trace_summary(df, 0.0).first()
    assert row["mean_class0"] == 3.0 and row["mean_class1"] is None and row["p21"] is None


def test_axial_angle_ignores_direction(spark):
    a, b = vec.vec(0, 0, 1), vec.vec(0, 0, -1)
    assert spark.range(1).select(vec.axial_angle(a, b)).first()[0] == pytest.approx(0)
    assert spark.range(1).select(vec.normalize(vec.vec(0, 0, 0)).isNull()).first()[0]


def test_pair_scores(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "t int, p int")
    row = aggs.pair_scores(df, "t", "p").first()
    assert (row["precision"], row["recall"]) == (pytest.approx(1 / 3), 1.0)


def test_components_of_chain_and_lone_node(spark):
    nodes = spark.range(1, 9).toDF("id")
    edges = spark.createDataFrame([(7, 6), (6, 5), (5, 3), (2, 1), (1, 2), (4, 4)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 3, 7: 3, 8: 8}
    assert graph.components(nodes.limit(0), edges.limit(0)).count() == 0


def test_relink(spark):
    traces = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 1.1, 0.0, 3.0, 0.0)], "trace_id int, y0 double, z0 double, y1 double, z1 double")
    groups = spark.createDataFrame([(1, 1), (2, 1)], "id int, component int")
    row = graph.relink(traces, groups).first()
    assert row["length"] == pytest.approx(3.0) and row["n_fragments"] == 2


def test_boundary_edges_of_two_triangles(spark):
    df = spark.createDataFrame([(0, 1, 2, 3), (0, 2, 3, 4)], "mesh int, a int, b int, c int")
    assert {(r["u"], r["v"]) for r in graph.boundary_edges(df).collect()} == {(1, 2), (1, 3), (2, 4), (3, 4)}


def test_jaccard_of_voxels(spark):
    a = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "ix int, iy int, iz int")
    b = spark.createDataFrame([(0, 0, 1)], "ix int, iy int, iz int")
    assert voxels.jaccard(a, b).first()["jaccard"] == 0.5
    assert voxels.jaccard(a.limit(0), b.limit(0)).first()["jaccard"] is None


def test_hungarian_is_optimal():
    import itertools

    import numpy as np

    cost = np.random.default_rng(1).random((5, 5))
    picked = joins.hungarian(cost)
    best = min(sum(cost[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
    assert sorted(picked) == list(range(5)) and math.isclose(cost[range(5), picked].sum(), best)


def test_range_join_meets_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0.0, 9.0)], "id int, lo double, hi double")
    b = spark.createDataFrame([(2, 3.0, 30.0), (3, 9.5, 10.0)], "id int, lo double, hi double")
    got = [(r["l"]["id"], r["r"]["id"]) for r in joins.grid_range_join(a, b, "lo", "hi", 2.0).collect()]
    assert got == [(1, 2)]


def least_assignment(costs):
    """Most pairs first, then least cost, of ``{(i, j): cost}`` by trying all."""
    if not costs:
        return (0, 0.0)
    i = min(costs)[0]
    rest = {k: c for k, c in costs.items() if k[0] != i}
    options = [least_assignment(rest)]
    for (a, j), c in costs.items():
        if a == i:
            n, total = least_assignment({k: x for k, x in rest.items() if k[1] != j})
            options.append((n - 1, total + c))
    return min(options)


def test_assignment_covers_all_discs(spark, tmp_path):
    from tracefield import plans

    keys = [k + 40 * m for k in (1, 2, 3, 5, 6, 7, 9, 4, 8) for m in range(5)]
    parts = [(k, f"Brand#{k % 2}", 8) for k in keys]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    groups = {}
    for i in keys:
        for j in keys:
            gap = math.hypot((i * 7 % 23) - (j * 7 % 23), (i * 5 % 19) - (j * 5 % 19))
            if i % 2 == j % 2 and j % 40 == i % 40 + 4 and gap <= 9:
                groups.setdefault((f"Brand#{i % 2}", float(j % 40)), {})[i, j] = gap
    got = {}
    for r in plans.QUERIES["assigned_pairs"](spark, str(tmp_path)).collect():
        got.setdefault((r["set_id"], r["x"]), []).append((r["i"], r["j"], r["cost"]))
    assert any(i % 4 for g in groups.values() for i, _ in g) and set(got) == set(groups)
    for key, costs in groups.items():
        found = got[key]
        assert len({i for i, _, _ in found}) == len({j for _, j, _ in found}) == len(found)
        assert all(math.isclose(costs[i, j], c) for i, j, c in found)
        n, total = least_assignment(costs)
        assert len(found) == -n and math.isclose(sum(c for _, _, c in found), total)


def test_assignment_is_split_by_connected_candidates(spark):
    rows = [("s", 1, 1, 1.0), ("s", 1, 2, 2.0), ("s", 3, 2, 1.0), ("s", 2, 3, 1.0), ("t", 1, 1, 1.0)]
    pairs = spark.createDataFrame(rows, "by string, i long, j long, cost double")
    got = {(r["by"], r["i"], r["j"]): r["component"] for r in joins.split_by_component(pairs, ["by"], "i", "j").collect()}
    assert len(got) == 5 and len(set(got.values())) == 3
    assert got["s", 1, 1] == got["s", 1, 2] == got["s", 3, 2] != got["s", 2, 3]
    assert sorted((r["i"], r["j"]) for r in joins.assign(pairs, ["by"], "i", "j", "cost").collect()) == [(1, 1), (1, 1), (2, 3), (3, 2)]


def test_running_sums_and_quantiles_over_ranges(spark):
    rows = [(g, x % 7, x) for g, n in (("a", 50), ("b", 1), (None, 9)) for x in range(n)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = windows.running(df, ["g"], ["v", "id"], {"k": F.lit(1), "s": F.col("v")}).collect()
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["v"], r["id"]))
        assert [r["k"] for r in own] == list(range(1, len(own) + 1)) and own[-1]["s"] == own[-1]["s_total"]
        assert sum(r["v"] for r in own) == own[0]["s_total"]
    peers = windows.running(df, ["g"], ["v"], {"k": F.lit(1)}, peers=True).filter("g = 'a'").collect()
    assert {(r["v"], r["k"]) for r in peers} == {(v, sum(y % 7 <= v for y in range(50))) for v in range(7)}
    row = windows.quantiles(df, ["g"], "id", [0.0, 0.5, 0.9, 1.0]).filter("g = 'a'").first()
    assert [row[f"q{k}"] for k in range(4)] == pytest.approx([0, 24.5, 44.1, 49])


def test_assignment_takes_the_least_of_repeated_candidates(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.5)], "i int, j int, cost double").withColumn("g", F.lit(0))
    got = {(r["i"], r["j"], r["cost"]) for r in joins.assign(df, ["g"], "i", "j", "cost").collect()}
    assert got == {(1, 2, 2.0), (2, 1, 1.5)}
    one = joins.assign(df.filter("i = 1 AND j = 1"), ["g"], "i", "j", "cost").collect()
    assert [r["cost"] for r in one] == [1.0]


def test_greedy_match_is_greedy(spark):
    import random

    rng = random.Random(4)
    pairs = [(rng.randint(0, 25), rng.randint(0, 25), round(rng.random(), 2)) for _ in range(200)]
    got = joins.greedy_match(spark.createDataFrame(pairs, "i int, j int, c double"), "i", "j", "c")
    least, used_i, used_j, expected = {}, set(), set(), set()
    for i, j, c in pairs:
        least[i, j] = min(c, least.get((i, j), 9))
    for c, i, j in sorted((c, i, j) for (i, j), c in least.items()):
        if i not in used_i and j not in used_j:
            used_i.add(i), used_j.add(j), expected.add((i, j, c))
    assert {tuple(r) for r in got.select("i", "j", "c").collect()} == expected
    assert joins.greedy_match(got.limit(0), "i", "j", "c").count() == 0


def test_checked_join_raises(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.checked_join(left.filter("k = 1"), right, "k").collect()[0]["v"] == "x"
    with pytest.raises(Exception, match="without a match: 2"):
        joins.checked_join(left, right, "k").collect()
