"""Polylines, distances and clips against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefield.functions import geom
from tracefield.operators import meshes, voxels

POINT = "struct<x:double,y:double,z:double>"


def lines(spark, rows):
    """Segments of ``trace name, points`` in a shuffled order, some turned."""
    rng = np.random.default_rng(1)
    out = []
    for name, points in rows:
        for p, q in zip(points, points[1:]):
            out.append((name, p, q) if rng.random() < 0.5 else (name, q, p))
    rng.shuffle(out)
    return spark.createDataFrame([(str(n), tuple(map(float, p)), tuple(map(float, q))) for n, p, q in out], f"site string, p {POINT}, q {POINT}")


def test_polylines_of_every_shape(spark):
    line = [(k, (k * 7) % 5, 0) for k in range(37)]
    ring = [(math.cos(k), math.sin(k), 1) for k in np.linspace(0, 2 * math.pi, 24, endpoint=False)]
    rows = [("line", line), ("line", [(0, 50, 0), (1, 50, 0)]), ("ring", [*ring, ring[0]]), ("fork", [(0, 0, 0), (1, 0, 0), (2, 0, 0)]), ("fork", [(1, 0, 0), (1, 1, 0)]), ("dot", [(3, 3, 3), (3, 3, 3 + 1e-9)])]
    traces, points = meshes.polylines(lines(spark, rows), ["site"])
    found = {(r["site"], r["n_segments"]): r for r in traces.collect()}
    assert set(found) == {("line", 36), ("line", 1), ("ring", 24), ("fork", 3)}
    assert [found[k]["closed"] for k in (("line", 36), ("ring", 24))] == [False, True] and found["fork", 3]["branched"]
    assert found["line", 36]["length"] == pytest.approx(sum(math.dist(p, q) for p, q in zip(line, line[1:])))
    got = {}
    for r in points.orderBy("trace", "place").collect():
        got.setdefault(r["trace"], []).append((r["place"], tuple(r["point"])))
    at = lambda site, n: [p for _, p in got[found[site, n]["trace"]]]
    assert at("line", 36) == [tuple(map(float, p)) for p in line] and found["fork", 3]["trace"] not in got
    assert [k for k, _ in got[found["line", 36]["trace"]]] == list(range(37))
    around = at("ring", 24)
    assert len(around) == 25 and around[0] == around[-1] == min(around)
    assert len(set(around)) == 24 and all(math.dist(p, q) == pytest.approx(math.dist(ring[0], ring[1])) for p, q in zip(around, around[1:]))
    ends = {(r["site"], r["n_segments"]): r for r in meshes.trace_ends(traces, points, ["site"]).collect()}
    assert tuple(ends["line", 36]["p0"]) == line[0] and tuple(ends["line", 36]["p1"]) == line[-1]
    assert math.dist(ends["ring", 24]["p0"], ends["ring", 24]["p1"]) == pytest.approx(2.0)


def test_polylines_of_nothing(spark):
    traces, points = meshes.polylines(lines(spark, [("a", [(0, 0, 0), (1, 0, 0)])]).limit(0), ["site"])
    assert traces.count() == 0 and points.count() == 0


def test_box_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(2)

    def boxes(n):
        low = rng.uniform(-5, 5, (n, 3))
        return low, low + rng.uniform(0, 4, (n, 3))

    (al, ah), (bl, bh) = boxes(60), boxes(60)
    frame = lambda lows, highs: spark.createDataFrame([(k, tuple(map(float, p)), tuple(map(float, q))) for k, (p, q) in enumerate(zip(lows, highs))], f"id long, low {POINT}, high {POINT}")
    got = sorted((r[0], r[1]) for r in meshes.box_pairs(frame(al, ah), frame(bl, bh), 1.5).select("a.id", F.col("b.id").alias("other")).collect())
    assert got == sorted((i, j) for i in range(60) for j in range(60) if (al[i] <= bh[j]).all() and (bl[j] <= ah[i]).all())


def test_squared_distances_against_all_pairs(spark):
    cells = {(0, 0, 0), (3, 2, 1), (4, 4, 4), (9, 0, 2)}
    df = spark.createDataFrame([*cells, (0, 0, 0)], "ix int, iy int, iz int")
    got = {tuple(r)[:3]: r["d2"] for r in voxels.squared_distances(df, {"ix": (-1, 5), "iy": (0, 4), "iz": (0, 6)}).collect()}
    assert len(got) == 7 * 5 * 7
    assert all(d == min(sum((a - b) ** 2 for a, b in zip(at, c)) for c in cells) for at, d in got.items())
    assert voxels.squared_distances(df.limit(0), {"ix": (0, 1), "iy": (0, 1), "iz": (0, 1)}).count() == 0


def test_rings_clipped_to_half_spaces(spark):
    one = spark.createDataFrame([((0.0, 0.0, 0.0), (0.0, 0.0, 1.0), 2.0), ((0.0, 0.0, 9.0), (0.0, 1.0, 0.0), 1.0)], f"c {POINT}, n {POINT}, radius double")
    rows = geom.with_disc_ring(one, "ring", F.col("c"), F.col("n"), F.col("radius"), 36)
    whole = 36 * math.sin(2 * math.pi / 36) / 2
    areas = lambda df: [r["area"] for r in geom.with_ring_area(df, "area", "ring").orderBy("radius").collect()]
    assert areas(rows) == pytest.approx([whole, 4 * whole])
    half = geom.with_clipped_ring(rows, "ring", "x", 0.0, 1)
    assert areas(half) == pytest.approx([whole / 2, 2 * whole])
    none = geom.with_clipped_ring(half, "ring", "z", 4.0, -1)
    assert areas(none) == pytest.approx([0.0, 2 * whole])
    gone = geom.with_clipped_ring(none, "ring", "z", 4.0, 1)
    assert [r["n"] for r in gone.select(F.size("ring").alias("n")).collect()] == [0, 0] and areas(gone) == [0.0, 0.0]


def test_dealt_discs_are_not_gathered_for_a_broadcast(spark):
    """The planner takes exploded rows for as many as went in."""
    from tracefield.operators import diagnostics, voxels

    grid = spark.range(1000).select(*[(F.floor(F.col("id") / 10**k) % 10).cast("int").alias(c) for k, c in enumerate(("ix", "iy", "iz"))])
    turn = F.struct(F.cos("id").alias("x"), F.sin("id").alias("y"), F.lit(0.0).alias("z"))
    place = F.struct(*[(F.col("id") * k % 10).cast("double").alias(c) for k, c in ((3, "x"), (7, "y"), (1, "z"))])
    discs = spark.range(300).select(F.col("id").alias("disc_id"), place.alias("c"), turn.alias("n"), (F.col("id") % 6 + 0.5).alias("radius"))
    centres = grid.select("*", F.struct(*[(F.col(f"i{c}") + 0.5).alias(c) for c in "xyz"]).alias("p"))
    owners = voxels.plane_owners(centres, discs, 0.6, 4.0)
    edges = diagnostics.cut_edges(grid.select("*", *[F.col(f"i{c}").cast("double").alias(c) for c in "xyz"]), discs)
    for found in (owners, edges):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        for part in plan.split("BroadcastExchange")[1:]:
            assert "Generate" not in part.split("+- Exchange")[0]

    discs, cells = discs.collect(), [(r.ix, r.iy, r.iz) for r in grid.collect()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    best, cuts = {}, set()
    for i in cells:
        for d in discs:
            step = [v + 0.5 - c for v, c in zip(i, d.c)]
            off = abs(dot(step, d.n))
            if off <= 0.6 and dot(step, step) - off * off <= d.radius**2:
                best[i] = min(best.get(i, (9.0, 0)), (off, d.disc_id))
            at = [v - c for v, c in zip(i, d.c)]
            for k in range(3):
                a, b = dot(at, d.n), dot(at, d.n) + d.n[k]
                hit = [x + (a / (a - b) if e == k else 0) for e, x in enumerate(at)] if a * b < 0 else None
                if hit and math.sqrt(dot(hit, hit)) <= d.radius:
                    cuts.add((*i, k, d.disc_id))
    assert {(r.ix, r.iy, r.iz): r.owner for r in owners.collect()} == {k: v[1] for k, v in best.items()}
    assert {tuple(r) for r in edges.collect()} == cuts


def test_mesh_cuts_do_not_gather_the_dealt_discs(spark):
    rows = [(0, i, j, (0.1 * (i % 2), float(i), float(j))) for i in range(6) for j in range(6)]
    nodes = spark.createDataFrame(rows, "mesh long, i long, j long, p struct<x double, y double, z double>")
    discs = spark.createDataFrame([(k, (0.0, 2.5, 2.5), (0.6, 0.8, 0.0), 2.0) for k in range(50)], "disc_id long, c struct<x double, y double, z double>, n struct<x double, y double, z double>, radius double")
    cuts = meshes.mesh_cuts(meshes.grid_triangles(nodes, ["mesh"]), discs)
    plan = cuts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Generate" not in plan.split("BroadcastExchange")[1].split("+- Exchange")[0]
    assert cuts.groupBy("disc_id").count().select("count").distinct().count() == 1 and cuts.count() >= 50


def test_cuts_shorter_than_the_least_are_left_out(spark):
    corners = [((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)), ((-1.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.0, 1.0, 1.0))]
    triangles = spark.createDataFrame([(k, *v) for k, v in enumerate(corners)], f"mesh long, v0 {POINT}, v1 {POINT}, v2 {POINT}")
    side = math.sqrt(0.5)
    discs = spark.createDataFrame([(7, (2.5e-7, 2.5e-7, 0.5), (side, side, 0.0), 2.0)], f"disc_id long, c {POINT}, n {POINT}, radius double")
    assert [r["mesh"] for r in meshes.mesh_cuts(triangles, discs).collect()] == [1]


def test_walks_in_tasks_are_those_of_the_joins(spark):
    line = [(k, (k * 7) % 5, 0) for k in range(37)]
    ring = [(math.cos(k), math.sin(k), 1) for k in np.linspace(0, 2 * math.pi, 24, endpoint=False)]
    shapes = [line, [(0, 50, 0), (1, 50, 0)], [*ring, ring[0]], [(0, 0, 9), (1, 0, 9), (2, 0, 9)], [(1, 0, 9), (1, 1, 9)], [(3, 3, 3), (3, 3, 3 + 1e-9)]]
    both = lines(spark, [(k % 3, points) for k, points in enumerate(shapes)]).unionByName(lines(spark, [(k % 2 + 5, points) for k, points in enumerate(shapes)]))
    rows = both.select(F.col("site").cast("long").alias("site"), (F.col("site") % 2).cast("long").alias("part"), "p", "q").repartition(2, "site").sortWithinPartitions("site")
    keys = ["site", "part"]
    traces, points = meshes.polylines(rows, keys)
    places = lambda df: sorted(map(repr, df.select(*keys, "place", "point").collect()))
    ends = lambda df: sorted((*r[:4], round(r[4], 9), *map(tuple, r[5:])) for r in df.select(*keys, "n_segments", "closed", "length", "p0", "p1").collect())
    for held in (1, 40, 10_000):
        assert places(meshes.walks(rows, keys, "site", held=held)) == places(points)
        assert ends(meshes.walks(rows, keys, "site", ends=[], held=held)) == ends(meshes.trace_ends(traces, points, keys))
    with pytest.raises(Exception, match="not in the order of site"):
        meshes.walks(rows.coalesce(1).sortWithinPartitions(F.desc("site")), keys, "site").count()


def test_cuts_are_not_shuffled_and_parts_of_meshes_change_nothing(spark, monkeypatch):
    rows = [(m, i, j, (3.0 * m + 0.3 * ((i * 7 + j * 5 + m) % 4), float(i), float(j))) for m in range(3) for i in range(6) for j in range(6)]
    triangles = meshes.grid_triangles(spark.createDataFrame(rows, f"mesh long, i long, j long, p {POINT}"), ["mesh"])
    discs = spark.createDataFrame([(k, (float(k % 7), 2.0 + k % 3, 2.5), (math.cos(k), math.sin(k), 0.0), 1.0 + k % 4) for k in range(1, 30)], f"disc_id long, c {POINT}, n {POINT}, radius double")

    def found():
        ends = meshes.with_end_types(meshes.mesh_ends(triangles, discs), meshes.boundary_segments(triangles))
        points = meshes.mesh_points(triangles, discs)
        plan = points._jdf.queryExecution().executedPlan().toString()
        return sorted(repr(r) for r in points.select("mesh", "disc_id", "place", "point").collect()), sorted(repr(r) for r in ends.select("mesh", "disc_id", "n_segments", "p0", "p1", "p0_type", "p1_type", "radius").collect()), plan

    points, ends, plan = found()
    assert points and ends and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    monkeypatch.setattr("tracefield.operators.graph.FEW", 60)
    parts = found()
    assert parts[:2] == (points, ends) and parts[2].count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in parts[2]
    monkeypatch.setattr("tracefield.operators.meshes.PARTS", 1)
    assert found()[:2] == (points, ends)
