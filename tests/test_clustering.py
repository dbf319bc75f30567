"""Clusters of directions against plain versions and planted sets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefield.functions import vec
from tracefield.operators import chordfit, clustering

AXIS = "struct<x:double,y:double,z:double>"


def axes_around(rng, mean, n, spread):
    x = np.asarray(mean) + spread * rng.normal(size=(n, 3))
    return x / np.linalg.norm(x, axis=1)[:, None] * rng.choice([-1, 1], n)[:, None]


def plain_linkage(axes, cut):
    """One merge at a time, of the nearest two clusters by mean angle."""
    angle = np.degrees(np.arccos(np.minimum(np.abs(axes @ axes.T), 1)))
    members = {k: [k] for k in range(len(axes))}
    while len(members) > 1:
        d, a, b = min((round(angle[np.ix_(members[a], members[b])].mean(), 9), a, b) for a in members for b in members if a < b)
        if d > cut:
            break
        members[a] += members.pop(b)
    return {k: min(m) for m in members.values() for k in m}


@pytest.mark.parametrize("seed", [1, 2])
def test_average_linkage_against_merging_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    axes = np.concatenate([axes_around(rng, m, 12, 0.25) for m in ((1, 0, 0), (0, 1, 0.2), (0.3, 0.3, 1), (1, 1, 0))])
    units = spark.createDataFrame([(k, tuple(map(float, x))) for k, x in enumerate(axes)], f"id long, n {AXIS}")
    got = {r["id"]: r["cluster"] for r in clustering.linkage_cut(units, 30.0, []).collect()}
    assert got == plain_linkage(axes, 30.0) and 2 < len(set(got.values())) < 20


def test_average_linkage_by_group_and_of_nothing(spark):
    axes = axes_around(np.random.default_rng(5), (1, 0, 0), 10, 0.5)
    rows = [(g, k, tuple(map(float, x))) for g in ("a", "b") for k, x in enumerate(axes)]
    found = clustering.linkage_cut(spark.createDataFrame(rows, f"site string, id long, n {AXIS}"), 20.0, ["site"]).collect()
    expected = plain_linkage(axes, 20.0)
    assert all(r["cluster"] == expected[r["id"]] for r in found) and len(found) == 20
    assert clustering.linkage_cut(spark.createDataFrame([], f"id long, n {AXIS}"), 20.0, []).count() == 0
    one = spark.createDataFrame([(7, (1.0, 0.0, 0.0)), (9, (1.0, 0.0, 0.0)), (8, (-1.0, 0.0, 0.0))], f"id long, n {AXIS}")
    assert {r["cluster"] for r in clustering.linkage_cut(one, 0.0, []).collect()} == {7}


def plain_lloyd(points, k, apart, center, rounds):
    seeds = [points[0]]
    for _ in range(1, k):
        d = np.array([round(min(apart(p, c) for c in seeds), 9) for p in points])
        seeds.append(points[int(d.argmax())])
    for _ in range(rounds):
        labels = [min((round(apart(p, c), 9), j) for j, c in enumerate(seeds))[1] for p in points]
        seeds = [center([p for p, x in zip(points, labels) if x == j]) if j in labels else c for j, c in enumerate(seeds)]
    return [min((round(apart(p, c), 9), j) for j, c in enumerate(seeds))[1] for p in points]


def test_directions_of_planted_sets(spark):
    rng = np.random.default_rng(3)
    planted = {"one": [0.4], "two": [0.3, 1.7], "three": [0.1, 1.1, 2.2]}
    rows = [(site, k * 10 + j, float(m + 0.05 * rng.normal())) for site, means in planted.items() for k in range(30) for j, m in enumerate(means)]
    rows += [("few", 1, 0.1), ("few", 2, 0.1), ("few", 3, 2.0)]
    points = spark.createDataFrame(rows, "site string, id long, angle double").select("site", "id", clustering.doubled(F.col("angle")).alias("p"))
    _, labels = clustering.lloyd(points, ["site"], 4, clustering.PLANE, 20)
    models = clustering.gaussian_models(labels, ["site"])
    best = {r["site"]: r["k"] for r in clustering.best_model(models, ["site"]).collect()}
    assert best["few"] == 1 and {r["k"] for r in models.filter("site = 'few'").collect()} == {1}
    got = {(r["id"]): r["label"] for r in labels.filter("site = 'three' AND k = 3").collect()}
    assert len(got) == 90 and all(len({v for i, v in got.items() if i % 10 == j}) == 1 for j in range(3))
    at = sorted((i, a) for s, i, a in rows if s == "two")
    circle = [np.array([math.cos(2 * a), math.sin(2 * a)]) for _, a in at]
    plain = plain_lloyd(circle, 4, lambda p, q: ((p - q) ** 2).sum(), lambda m: np.mean(m, axis=0), 20)
    assert plain == [r["label"] for r in labels.filter("site = 'two' AND k = 4").orderBy("id").collect()]
    # one variance in both dimensions, two free numbers a centre and one a weight
    bics = {}
    for k in (1, 2, 3, 4):
        of = plain_lloyd(circle, k, lambda p, q: ((p - q) ** 2).sum(), lambda m: np.mean(m, axis=0), 20)
        rss = sum(((np.array(part) - np.mean(part, axis=0)) ** 2).sum() for part in ([p for p, x in zip(circle, of) if x == j] for j in range(k)) if part)
        variance = rss / (2 * len(circle))
        bics[k] = math.log(len(circle)) * (3 * k - 1) + 2 * len(circle) * (math.log(2 * math.pi * variance) + 1)
    found = {r["k"]: r["bic"] for r in models.filter("site = 'two'").collect()}
    assert found == pytest.approx(bics, abs=1e-3) and best["two"] == min(bics, key=bics.get)


def test_equal_points_count_as_often_as_they_occur(spark):
    angles = [0.1, 0.1, 0.1, 0.2, 1.4, 1.4, 1.5, 2.6, 2.6, 2.6, 2.6, 2.9] * 40
    rows = [("a", k, angle) for k, angle in enumerate(angles)]
    points = spark.createDataFrame(rows, "site string, id long, angle double").select("site", "id", clustering.doubled(F.col("angle")).alias("p"))
    same = clustering.alike(points, ["site"])
    assert same.count() == len(set(angles)) and same.agg(F.sum("n")).first()[0] == len(angles)
    centers, each = clustering.lloyd(points, ["site"], 4, clustering.PLANE, 8)
    of_same, few = clustering.lloyd(same, ["site"], 4, clustering.PLANE, 8)
    at = lambda df: {(r["k"], r["label"]): tuple(r["p"]) for r in df.collect()}
    assert at(centers) == at(of_same) and few.count() == 4 * len(set(angles)) and each.count() == 4 * len(angles)
    looked_up = clustering.of_alike(points, few, ["site"])
    assert looked_up.count() == each.count() and looked_up.exceptAll(each.select(looked_up.columns)).count() == 0
    circle = [np.array([math.cos(2 * a), math.sin(2 * a)]) for a in angles]
    plain = plain_lloyd(circle, 3, lambda p, q: ((p - q) ** 2).sum(), lambda m: np.mean(m, axis=0), 8)
    assert plain == [r["label"] for r in each.filter("k = 3").orderBy("id").collect()]
    for models in (clustering.gaussian_models, clustering.axial_models):
        one, two = ({r["k"]: (r["n"], r["bic"]) for r in models(labels, ["site"]).collect()} for labels in (each, few))
        assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()} == dict.fromkeys((1, 2, 3, 4), len(angles))
        assert [one[k][1] for k in one] == pytest.approx([two[k][1] for k in one])


def test_axes_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    axes = np.concatenate([axes_around(rng, m, 25, 0.1) for m in ((1, 0, 0), (0, 1, 0), (0, 0.5, 1))])
    rows = [(1, k, tuple(map(float, x))) for k, x in enumerate(axes)]
    centers, labels = clustering.lloyd(spark.createDataFrame(rows, f"g int, id long, p {AXIS}"), ["g"], 4, clustering.AXES, 12)

    def principal(members):
        return np.linalg.eigh(sum(np.outer(x, x) for x in members))[1][:, 2]

    for k in (2, 3, 4):
        plain = plain_lloyd(list(axes), k, lambda p, q: 1 - (p @ q) ** 2, principal, 12)
        assert plain == [r["label"] for r in labels.filter(f"k = {k}").orderBy("id").collect()]
    assert clustering.best_model(clustering.axial_models(labels, ["g"]), ["g"]).first()["k"] == 3
    assert centers.count() == 10


def test_eigenvectors_in_closed_form(spark):
    rng = np.random.default_rng(6)
    tensors = [m @ m.T for m in rng.normal(size=(40, 3, 3))] + [np.diag([1.0, 1.0, 3.0]), np.eye(3), np.zeros((3, 3)), np.outer([0, 1, 2], [0, 1, 2]).astype(float)]
    rows = [(k, *(float(m["xyz".index(a), "xyz".index(b)]) for a, b in vec.TENSOR)) for k, m in enumerate(tensors)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in vec.TENSOR))
    for least in (True, False):
        for r in vec.with_axis(df, "v", least).collect():
            values, vectors = np.linalg.eigh(tensors[r["id"]])
            k = 0 if least else 2
            assert abs(r["v_value"] - values[k]) < 1e-7 * max(1, values[2])
            single = abs(values[k] - values[1]) > 1e-6
            if single:
                assert abs(abs(np.array(r["v"]) @ vectors[:, k]) - 1) < 1e-7
                assert next(x for x in r["v"] if x != 0) > 0
            else:
                assert r["v"] is None


def plain_fit(h, a):
    """Best position and radius on a fine grid."""
    q = np.linspace(h.min() - 3, h.max() + 3, 200_001)
    square = ((h - q[:, None]) ** 2 + a**2).mean(axis=1)
    loss = ((np.sqrt(np.maximum(square[:, None] - (h - q[:, None]) ** 2, 0)) - a) ** 2).sum(axis=1)
    return q[loss.argmin()], math.sqrt(square[loss.argmin()]), loss.min()


def test_chord_fit_recovers_discs_and_is_the_best(spark):
    rng = np.random.default_rng(8)
    rows, discs, noisy = [], {}, {}
    for cluster in range(12):
        n = axes_around(rng, (0.4, 1, 0.5), 1, 0.3)[0]
        n = n * np.sign(n[0])
        c, radius, flat = rng.uniform(-1, 1, 3), rng.uniform(4, 6), math.hypot(n[1], n[2])
        discs[cluster] = (c, n, radius)
        for k, x in enumerate((-3.0, -1.0, 0.0, 2.0)[: 2 + cluster % 3]):
            gap = x - c[0]
            half = math.sqrt(radius**2 - (gap / flat) ** 2)
            wrong = 0.2 * rng.normal() if cluster >= 9 else 0.0
            y, z = c[1] - gap * n[0] * n[1] / flat**2, c[2] - gap * n[0] * n[2] / flat**2
            noisy.setdefault(cluster, []).append((gap / flat, half + wrong))
            rows.append((cluster * 10 + k, cluster, x, y, z, tuple(map(float, n)), half + wrong, -n[2] / flat, n[1] / flat))
    rows.append((500, 50, 0.0, 0.0, 0.0, (0.0, 0.0, 1.0), 1.0, 1.0, 0.0))
    schema = f"trace_id long, cluster long, x double, y double, z double, n {AXIS}, h double, dy double, dz double"
    traces = spark.createDataFrame([tuple(v if isinstance(v, (int, tuple)) else float(v) for v in r) for r in rows], schema)
    got = {r["cluster"]: r for r in chordfit.chord_fit(traces).collect()}
    assert set(got) == set(discs)
    for cluster, (c, n, radius) in discs.items():
        r = got[cluster]
        assert abs(abs(np.array(r["n"]) @ n) - 1) < 1e-9 and r["n_faces"] == 2 + cluster % 3
        if cluster < 9:
            assert np.abs(np.array(r["c"]) - c).max() < 2e-3 and abs(r["radius"] - radius) < 2e-3
        else:
            h, a = (np.array(x) for x in zip(*noisy[cluster]))
            q, best, loss = plain_fit(h, a)
            assert r["loss"] <= loss + 1e-4 and abs(r["radius"] - best) < 0.02
    assert chordfit.chord_fit(traces.limit(0)).count() == 0


def test_fragment_groups_are_those_of_all_pairs(spark):
    import math

    import numpy as np

    from tracefield.operators import graph
    from tracefield.plans import join_queries

    rng = np.random.default_rng(5)
    rows = []
    for k in map(int, rng.permutation(400)):
        y, z, angle = float(k % 12), float(k * 7 % 9), (k * 5 % 8) * 0.35
        size = float(rng.exponential(1.5))
        rows.append((k, "ab"[k % 2], k % 3, y, z, y + size * math.cos(angle), z + size * math.sin(angle), angle))
    rows += [(1000, "a", 0, 0.0, 0.0, None, None, 0.0), (1001, "a", 0, 0.0, 0.0, None, None, 0.0), (1002, "a", 0, None, 0.0, 1.0, 1.0, 0.0), (1003, None, 0, 0.0, 0.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "trace_id long, set_id string, face_id int, y0 double, z0 double, y1 double, z1 double, angle double")
    for gap, dense in ((0.3, 0.0), (2.0, 0.0), (0.8, 1e9)):
        pairs = join_queries.fragments(df, ["set_id", "face_id"], gap, 0.2, 0.3)
        plain = graph.components(df.select(df.trace_id.alias("id")), pairs.selectExpr("a.trace_id AS a", "b.trace_id AS b"))
        got = join_queries.fragment_groups(df, ["set_id", "face_id"], gap, 0.2, 0.3, dense)
        assert sorted(map(tuple, got.select("id", "component").collect())) == sorted(map(tuple, plain.select("id", "component").collect()))
