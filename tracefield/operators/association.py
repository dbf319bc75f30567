"""Association of traces that one disc left on several faces.

Traces are rows ``trace_id, set_id, x, y, z`` (the middle, on face ``x``),
``n`` (the disc's unit normal) and, for planes, ``h, dy, dz`` (half length and
direction in the face).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from . import graph, joins

POSITION = ("x", "y", "z")


#: Side of the cells of normals, in each coordinate.
NORMAL_CELL = 0.08


def _met(traces: DataFrame, sizes: dict[str, float], angle: float, coplanar: float, far: float) -> DataFrame:
    """Pairs ``a``, ``b`` of a set among which are all that are within
    ``sizes`` and ``far`` of each other, nearly parallel and nearly in a plane.

    A trace ``a`` has one cell of normals, and a slab across that cell's
    direction; ``b`` goes to the cells that its axis is near to and to the slabs
    there that its plane's distance allows.  Positions get cells only along the
    coordinates in which the traces reach much farther than a pair.
    """
    rows = graph.cut_lineage(traces.select("trace_id", "set_id", *POSITION, "n"))
    reaches = rows.agg(*[(F.max(c) - F.min(c)).alias(c) for c in POSITION]).first()
    wide = [c for c in POSITION if (reaches[c] or 0.0) > 4 * sizes[c]]
    own = [F.floor(F.col(f"n.{c}") / NORMAL_CELL).alias(f"_n{c}") for c in POSITION]
    apart = math.sqrt(3) / 2 * NORMAL_CELL + 1e-9
    turned = 2 * math.sin(math.radians(min(angle, 90.0)) / 2) + 1e-9
    reach = coplanar + apart * far + 1e-9
    direction = vec.vec(*[(F.col(f"_n{c}") + 0.5) * NORMAL_CELL for c in POSITION])
    # unit normals have no more cells than a sphere of radius one
    cells = graph.cut_lineage(rows.select(*own).distinct()).withColumn("q", direction)
    other = cells.select(F.col("q").alias("p"), *[F.col(f"_n{c}").alias(f"_o{c}") for c in POSITION])

    def gap(p: Column, q: Column) -> Column:
        """Distance of the nearer end of an axis."""
        ends = [vec.norm(vec.vec(*[p[c] * s - q[c] for c in POSITION])) for s in (1.0, -1.0)]
        return F.least(*ends)

    close = other.crossJoin(F.broadcast(cells)).filter(gap(F.col("p"), F.col("q")) <= turned + 2 * apart)
    along = lambda side: F.col(f"{side}.x") * F.col("q.x") + F.col(f"{side}.y") * F.col("q.y") + F.col(f"{side}.z") * F.col("q.z")
    keys = ["set_id", *[f"_n{c}" for c in POSITION], "_slab", *[f"_{c}" for c in wide]]
    at = {c: F.floor(F.col(c) / sizes[c]) for c in wide}
    a = rows.select(F.struct("trace_id", *POSITION, "n").alias("a"), "set_id", *own, *[x.alias(f"_{c}") for c, x in at.items()]).withColumn("q", direction)
    a = a.withColumn("_slab", F.floor(along("a") / (2 * reach)))
    for c in wide:
        a = a.withColumn(f"_{c}", F.explode(F.array(*[F.col(f"_{c}") + k for k in (-1, 0, 1)])))
    b = rows.select(F.struct("trace_id", *POSITION, "n").alias("b"), "set_id", *[x.alias(f"_o{c}") for x, c in zip(own, POSITION)], *[x.alias(f"_{c}") for c, x in at.items()])
    b = b.join(F.broadcast(close), [f"_o{c}" for c in POSITION]).filter(gap(F.col("b.n"), F.col("q")) <= turned + apart)
    b = b.withColumn("_slab", F.explode(F.sequence(F.floor((along("b") - reach) / (2 * reach)), F.floor((along("b") + reach) / (2 * reach)))))
    return joins.meet(a.select("a", *keys), b.select("b", *keys), keys).select("a", "b")


def _pairs(traces: DataFrame, sizes: dict[str, float], angle: float, coplanar: float, gate: Column, far: float, x_most: float | None = None) -> DataFrame:
    """Pairs ``i < j`` of a set within ``gate``, at most ``far``, nearly
    parallel, and each middle near the other's plane; ``off`` is the larger
    distance from it."""
    pairs = _met(traces, sizes, angle, coplanar, far).filter("a.trace_id < b.trace_id")
    step = vec.vec(*[F.col(f"b.{c}") - F.col(f"a.{c}") for c in POSITION])
    pairs = pairs.withColumn("step", step).withColumn("apart", vec.norm(F.col("step")))
    if x_most is not None:
        pairs = pairs.filter(F.abs(F.col("step.x")) <= x_most)
    off = F.greatest(F.abs(vec.dot(F.col("step"), F.col("a.n"))), F.abs(vec.dot(F.col("step"), F.col("b.n"))))
    along = F.abs(vec.dot(F.col("a.n"), F.col("b.n"))) >= math.cos(math.radians(angle))
    near = pairs.withColumn("off", off).filter((F.col("apart") <= gate) & along & (F.col("off") <= coplanar))
    return near.select(F.col("a.trace_id").alias("i"), F.col("b.trace_id").alias("j"), "apart", "off")


def coplanar_pairs(traces: DataFrame, angle: float, coplanar: float, separation: float) -> DataFrame:
    """Pairs within a fixed separation."""
    return _pairs(traces, dict.fromkeys(POSITION, separation), angle, coplanar, F.lit(separation), separation)


def gated_pairs(traces: DataFrame, angle: float, coplanar: float, x_most: float = 3.2, safety: float = 1.4, least: float = 2.0, most: float = 8.0) -> DataFrame:
    """Pairs on faces at most ``x_most`` apart within a gate that grows with
    the faces' distance as the discs turn towards the faces."""
    nx = F.least(F.lit(0.97), F.greatest(F.abs("a.n.x"), F.abs("b.n.x")))
    gate = F.least(F.lit(most), F.greatest(F.lit(least), safety * F.abs(F.col("step.x")) / F.sqrt(F.greatest(1 - nx * nx, F.lit(1e-6)))))
    return _pairs(traces, {"x": x_most, "y": most, "z": most}, angle, coplanar, gate, most, x_most)


def connected(traces: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(trace_id, cluster)``: the least trace that pairs connect."""
    found = graph.components(traces.select(F.col("trace_id").alias("id")), pairs.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return found.select(F.col("id").alias("trace_id"), F.col("component").alias("cluster"))


#: Pairs that are merged along before the rest is looked at again.
PAIRS_AT_ONCE = 10_000_000
#: A component with more pairs than this has a task of its own.
PAIRS_A_TASK = 50_000


def agglomerate(traces: DataFrame, pairs: DataFrame, residual: float = 0.08, spread: float = 0.25, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """``(trace_id, cluster)`` by merging along ``pairs``, least ``off`` first,
    where the joint plane of both clusters' end points has a root mean square
    residual of at most ``residual`` and no face has chords that lie farther
    apart than ``spread`` across their direction.

    Pairs are taken in levels of ``off`` with about ``at_once`` pairs each (more
    only where that many have one ``off``), so what a task holds does not grow
    with the pairs.  A level's pairs connect clusters of the levels before;
    merges never cross the components of these, so tasks take components.
    """
    chords = graph.cut_lineage(traces.select("trace_id", *POSITION, "h", "dy", "dz"))
    links = graph.cut_lineage(pairs.select("i", "j", "off"))
    levels = -(-links.count() // at_once)
    cuts = sorted(set(links.approxQuantile("off", [k / levels for k in range(1, levels)], 0.1 / levels))) if levels > 1 else []
    owners = chords.select("trace_id", F.col("trace_id").alias("cluster"))
    for low, high in zip([None, *cuts], [*cuts, None]):
        level = links if low is None else links.filter(F.col("off") > low)
        level = level if high is None else level.filter(F.col("off") <= high)
        level = level.withColumns({"a": F.col("i"), "b": F.col("j")})
        if low is not None:
            for end, trace in (("a", "i"), ("b", "j")):
                level = level.drop(end).join(owners.select(F.col("trace_id").alias(trace), F.col("cluster").alias(end)), trace)
        level = graph.cut_lineage(level.filter("a != b"))
        renamed = graph.cut_lineage(_merged(chords.join(owners, "trace_id"), level, residual, spread))
        to = F.coalesce("to", "cluster").alias("cluster")
        owners = graph.cut_lineage(owners.join(renamed, "cluster", "left").select("trace_id", to))
    return owners


def _merged(chords: DataFrame, level: DataFrame, residual: float, spread: float) -> DataFrame:
    """``(cluster, to)`` of the clusters that merge into another, ``to``, along
    the pairs ``level(i, j, off, a, b)`` of clusters ``a`` and ``b``."""
    ends = level.select("a", "b").distinct()
    parts = graph.components(ends.select(F.explode(F.array("a", "b")).alias("id")), ends)
    parts = graph.cut_lineage(parts.select(F.col("id").alias("a"), "component"))
    links = level.join(parts, "a")
    sizes = links.groupBy("component").agg(F.count("*").alias("n"))
    buckets = F.lit(max(1, level.count() // PAIRS_A_TASK))
    shared = -1 - F.pmod(F.xxhash64("component"), buckets)
    tasks = graph.cut_lineage(parts.join(sizes, "component").select("a", F.when(F.col("n") > PAIRS_A_TASK, F.col("component")).otherwise(shared).alias("task")))
    links = graph.spread(level.join(tasks, "a").select("task", "i", "j", "off", "a", "b"), "task")
    nodes = graph.spread(chords.join(tasks.select(F.col("a").alias("cluster"), F.col("task").alias("task")), "cluster").select("task", "cluster", *POSITION, "h", "dy", "dz"), "task")
    solve = lambda n, p: merge_chords(n, p, residual, spread)
    return nodes.groupBy("task").cogroup(links.groupBy("task")).applyInPandas(solve, "cluster long, to long")


def merge_chords(nodes, links, residual: float, spread: float):
    """``cluster, to`` of the clusters of chords ``nodes`` that merge into
    another along ``links``, as merging along one link after the other would.

    A link can be decided once no link before it has an end in its clusters.
    All such links are decided together, among some links at a time, so that
    few clusters have several.
    """
    import numpy as np
    import pandas as pd

    ids, of = np.unique(nodes["cluster"].to_numpy(), return_inverse=True)
    middle = nodes[list(POSITION)].to_numpy(float)
    reach = nodes["h"].to_numpy(float)[:, None] * np.stack([np.zeros(len(of)), nodes["dy"], nodes["dz"]], axis=1)
    faces = np.unique(np.round(middle[:, 0], 3), return_inverse=True)[1]
    order = np.argsort(of, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(of, minlength=len(ids)))[:-1])
    # sums over both ends, which add up when clusters merge
    sums = [np.zeros(len(ids)), np.zeros((len(ids), 3)), np.zeros((len(ids), 3, 3))]
    each = (np.full(len(of), 2.0), 2 * middle, 2 * (middle[:, :, None] * middle[:, None, :] + reach[:, :, None] * reach[:, None, :]))
    for total, x in zip(sums, each):
        np.add.at(total, of, x)

    root = np.arange(len(ids))
    links = links.sort_values(["off", "i", "j"])
    ends = [np.searchsorted(ids, links[c].to_numpy()) for c in ("a", "b")]
    first = np.zeros(len(ids), np.int64)
    live, at = len(ids), 0
    while at < len(links):
        while (root != root[root]).any():
            root = root[root]
        some = slice(at, at + max(1000, live // 4))
        at = some.stop
        a, b = root[ends[0][some]], root[ends[1][some]]
        while len(a):
            while True:
                up, across = root[a], root[b]
                if (up == a).all() and (across == b).all():
                    break
                a, b = up, across
            apart = a != b
            a, b = a[apart], b[apart]
            place = np.arange(len(a))
            first[a] = first[b] = len(a)
            # the last of equal ends counts, so backwards the least place
            both = np.stack([a, b], axis=1).ravel()[::-1]
            first[both] = np.repeat(place, 2)[::-1]
            ready = (first[a] == place) & (first[b] == place)
            x, y = a[ready], b[ready]
            joint = [t[x] + t[y] for t in sums]
            fits = one_plane(joint, middle, faces, [(members[p], members[q]) for p, q in zip(x, y)], residual, spread)
            x, y = x[fits], y[fits]
            for total, t in zip(sums, joint):
                total[x] = t[fits]
            for p, q in zip(x, y):
                members[p] = np.concatenate([members[p], members[q]])
                members[q] = None
            root[y] = x
            live -= len(x)
            a, b = a[~ready], b[~ready]
    while (root != root[root]).any():
        root = root[root]
    least = np.full(len(ids), ids.max(initial=0))
    np.minimum.at(least, root, ids)
    to = least[root]
    return pd.DataFrame({"cluster": ids[to != ids], "to": to[to != ids]})


def one_plane(joint: list, middle, faces, members: list, residual: float, spread: float):
    """For each of some pairs of clusters whether their chords can be one
    disc's, from the number, sum and second moments of their ends, and the
    middles and faces of their ``members``."""
    import numpy as np

    n, total, moment = joint
    mean = total / n[:, None]
    values, vectors = np.linalg.eigh(moment / n[:, None, None] - mean[:, :, None] * mean[:, None, :])
    fits = np.sqrt(np.maximum(values[:, 0], 0.0)) <= residual
    normal = vectors[:, :, 0]
    along = np.stack([np.zeros(len(n)), normal[:, 2], -normal[:, 1]], axis=1)
    size = np.linalg.norm(along, axis=1)
    checked = np.flatnonzero(fits & (size >= 1e-6))
    if not len(checked):
        return fits
    across = np.cross(normal[checked], along[checked] / size[checked, None])
    chords = np.concatenate([part for k in checked for part in members[k]])
    pair = np.repeat(np.arange(len(checked)), [len(members[k][0]) + len(members[k][1]) for k in checked])
    at = (middle[chords] * across[pair]).sum(axis=1)
    groups, group = np.unique(pair * (faces.max() + 1) + faces[chords], return_inverse=True)
    low, high = np.full(len(groups), np.inf), np.full(len(groups), -np.inf)
    np.minimum.at(low, group, at)
    np.maximum.at(high, group, at)
    wide = high - low > spread
    fits[checked[groups[wide] // (faces.max() + 1)]] = False
    return fits


def plane_fit(points: DataFrame, by: str) -> DataFrame:
    """Least-squares planes of ``points(by, x, y, z)`` per group from sums
    alone: ``n, rmse, nx, ny, nz``, the normal's components by size.

    The least eigenvalue of the covariance has a closed form, and the squares
    of its vector are the principal minors of what is left, as shares.
    """
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    means = points.groupBy(by).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in POSITION], *[F.avg(F.col(p) * F.col(q)).alias(f"t{p}{q}") for p, q in pairs]
    )
    c = means.select(by, "n", *[(F.col(f"t{p}{q}") - F.col(f"m{p}") * F.col(f"m{q}")).alias(p + q) for p, q in pairs])
    xx, xy, xz, yy, yz, zz = (F.col(k) for k in pairs)
    c = c.withColumn("q", (xx + yy + zz) / 3)
    q = F.col("q")
    square = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    c = c.withColumn("p", F.sqrt(square / 6))
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    turn = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * F.pow("p", F.lit(3.0)))))
    c = c.withColumn("least", F.when(F.col("p") > 0, q + 2 * F.col("p") * F.cos(F.acos(turn) / 3 + 2 * math.pi / 3)).otherwise(q))
    e = F.col("least")
    minors = {"x": (yy - e) * (zz - e) - yz * yz, "y": (xx - e) * (zz - e) - xz * xz, "z": (xx - e) * (yy - e) - xy * xy}
    c = c.withColumns({f"minor_{k}": F.greatest(v, F.lit(0.0)) for k, v in minors.items()})
    total = F.col("minor_x") + F.col("minor_y") + F.col("minor_z")
    return c.select(by, "n", F.sqrt(F.greatest(e, F.lit(0.0))).alias("rmse"), *[F.sqrt(F.try_divide(F.col(f"minor_{k}"), total)).alias(f"n{k}") for k in POSITION])


def adjacent_pair_scores(rows: DataFrame, truth: str, predicted: str, face: str) -> DataFrame:
    """Pair precision, recall and F1 over pairs on neighbouring faces only
    (faces by rank); a row without a truth is a false positive in each of its
    predicted pairs.  Counts per (face, truth, predicted) are joined, not rows."""
    ranks = rows.select(face).distinct().withColumn("_rank", F.dense_rank().over(Window.orderBy(face)))
    cells = rows.join(ranks, face).groupBy("_rank", truth, predicted).agg(F.count("*").alias("n"))

    def pairs(keys: list[str], known: str | None) -> DataFrame:
        counted = (cells if known is None else cells.filter(F.col(known).isNotNull())).groupBy("_rank", *keys).agg(F.sum("n").alias("n"))
        later = counted.select((F.col("_rank") - 1).alias("_rank"), *keys, F.col("n").alias("m"))
        return counted.join(later, ["_rank", *keys]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs"))

    both = pairs([truth, predicted], truth).withColumnRenamed("pairs", "both")
    true = pairs([truth], truth).withColumnRenamed("pairs", "true_pairs")
    pred = pairs([predicted], None).withColumnRenamed("pairs", "pred_pairs")
    one = both.crossJoin(true).crossJoin(pred)
    p, r = F.try_divide("both", "pred_pairs"), F.try_divide("both", "true_pairs")
    return one.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * p * r, p + r))
