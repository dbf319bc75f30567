"""Components, chains and mesh edges as joins."""

from __future__ import annotations

import functools
import math
import operator
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary folder is set only
    where the session names none and runs on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="tracefield-"))
    return context.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder.

    A checkpoint would run ``df`` twice, and keep its estimated size, whose
    digits double with every self-join of a loop.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over all shuffle partitions: for short rows that each make much
    work, which their size doesn't tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Tables of at most so many rows go to every task.
FEW = 300_000


def join_dealt(few: DataFrame, dealt: DataFrame, on: list[str], most: int = FEW) -> DataFrame:
    """Inner join of a table that is small as a rule with ``dealt``, whose rows
    a generator made.

    The planner takes a generator's rows for as many as went in, and would
    gather them in the driver for a broadcast.  So ``few`` is written and
    counted: up to ``most`` rows it goes to every task, and ``dealt`` is neither
    gathered nor shuffled; above that both are shuffled.
    """
    few = cut_lineage(few)
    return few.hint("merge").join(dealt, on) if few.count() > most else dealt.join(F.broadcast(few), on)


def least_reached(a, b, n):
    """The least number that each of ``n`` reaches by edges between the numbers
    of two arrays, by hooks and jumps."""
    import numpy as np

    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def forest(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect what ``edges`` do, ``a < b``: each task
    sends on a star for every component of its own edges, so no more rows than
    it has ends, however many pairs connect them.  Ids are whole numbers."""
    import numpy as np
    import pandas as pd

    def star(a, b):
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = ids[least_reached(at[: len(a)], at[len(a) :], len(ids))]
        return root[root != ids], ids[root != ids]

    def thinned(frames):
        held, waiting, n = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for frame in frames:
            waiting.append((frame["a"].to_numpy(), frame["b"].to_numpy()))
            n += len(frame)
            if n > max(500_000, len(held[0])):
                held, waiting, n = star(*map(np.concatenate, zip(held, *waiting))), [], 0
        held = star(*map(np.concatenate, zip(held, *waiting)))
        yield pd.DataFrame({"a": held[0], "b": held[1]})

    whole = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL")
    return whole.mapInPandas(thinned, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` for all ``nodes(id)``: the least id that ``edges(a,
    b)`` reach.

    In a round every node hooks to its least lesser neighbour, chains of hooks
    are doubled until they are flat, and edges are contracted to the roots.  A
    path of random ids shrinks to a third, so rounds are few, and as edges are
    contracted no key collects a large component.  Edges between whole numbers
    are thinned in the tasks that make them (see ``forest``).
    """
    if all(t == "bigint" for _, t in edges.select("a", "b").dtypes):
        edges = forest(edges)
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    current = cut_lineage(edges.select(low, high).filter("a < b").distinct())
    found: DataFrame | None = None
    while current.limit(1).count():
        hooks = current.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        while True:
            hooks = cut_lineage(hooks)
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = hooks.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            if not jumped.filter("moved").limit(1).count():
                break
            hooks = jumped.select("id", "root")
        rooted = lambda end: hooks.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))  # noqa: E731, B023
        ends = current.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        current = cut_lineage(ends.select(low, high).filter("a < b").distinct())
        if found is None:
            found = hooks
        else:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("above"))
            found = cut_lineage(found.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root")).unionByName(hooks))
    alone = nodes.select("id").distinct()
    if found is None:
        return alone.withColumn("component", F.col("id"))
    return alone.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def relink(traces: DataFrame, groups: DataFrame) -> DataFrame:
    """One trace per group of fragments ``(trace_id, y0, z0, y1, z1)``.

    The main direction is that of the length-weighted doubled angles; the ends
    are the extreme end points along it.
    """
    rows = traces.join(groups.select(F.col("id").alias("trace_id"), "component"), "trace_id")
    dy, dz = F.col("y1") - F.col("y0"), F.col("z1") - F.col("z0")
    rows = rows.withColumn("length", F.hypot(dy, dz)).withColumn("angle", F.atan2(dz, dy))
    double = rows.groupBy("component").agg(
        F.sum(F.col("length") * F.cos(2 * F.col("angle"))).alias("c"), F.sum(F.col("length") * F.sin(2 * F.col("angle"))).alias("s"), F.count("*").alias("n_fragments")
    )
    axis = double.select("component", "n_fragments", (F.atan2("s", "c") / 2).alias("main"))
    ends = rows.select("component", F.explode(F.array(F.struct(F.col("y0").alias("y"), F.col("z0").alias("z")), F.struct(F.col("y1").alias("y"), F.col("z1").alias("z")))).alias("p"))
    placed = ends.join(axis, "component").withColumn("at", F.col("p.y") * F.cos("main") + F.col("p.z") * F.sin("main"))
    return placed.groupBy("component").agg(
        F.first("n_fragments").alias("n_fragments"), F.min(F.struct("at", "p.y", "p.z")).alias("low"), F.max(F.struct("at", "p.y", "p.z")).alias("high")
    ).select(
        "component", "n_fragments", F.col("low.y").alias("y0"), F.col("low.z").alias("z0"), F.col("high.y").alias("y1"), F.col("high.z").alias("z1"),
        F.hypot(F.col("high.y") - F.col("low.y"), F.col("high.z") - F.col("low.z")).alias("length"), (F.col("high.at") - F.col("low.at")).alias("reach"),
    )


def boundary_edges(triangles: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that one triangle ``(mesh, a, b, c)`` alone uses."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    edges = triangles.select("mesh", F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("a", "c"))).alias("e"))
    return edges.groupBy("mesh", "e.u", "e.v").agg(F.count("*").alias("n")).filter("n = 1").drop("n")


def core_points(points: DataFrame, keys: list[str], near: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Core points ``(id)`` with at least ``least`` points within ``near``
    (themselves included) among equal ``keys``, and links that connect cores
    as all pairs of cores within ``near`` would, ``(a, b)``.

    Two points of a cell whose diagonal is ``near`` are always near.  So only
    points of cells with few points are counted against others, a cell's cores
    are linked to the least of them, and two cells need one near pair: it is
    looked for among a core of every sixty-fourth of a cell, and among all
    that come near the other cell only where those have none.
    """
    side = near / math.sqrt(2) * (1 - 1e-9)
    home = [*keys, "i", "j"]
    cut = lambda c, part=1: F.floor(F.col(c) / (side / part))
    whole = [F.col(k).isNotNull() for k in keys] + [F.col(c).isNotNull() & ~F.isnan(c) for c in ("x", "y")]
    placed = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *keys).filter(functools.reduce(operator.and_, whole))
    placed = cut_lineage(placed.withColumns({"i": cut("x"), "j": cut("y")}))
    counts = placed.groupBy(*home).agg(F.count("*").alias("n"))
    sized = placed.join(counts.hint("merge"), home)
    steps = [(p, q) for p in range(-2, 3) for q in range(-2, 3)]

    def around(rows: DataFrame, offsets: list) -> DataFrame:
        step = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in offsets]))
        rows = rows.withColumn("step", step).withColumns({"to_i": F.col("i") + F.col("step.p"), "to_j": F.col("j") + F.col("step.q")}).drop("step")
        return spread(rows, *keys, "to_i", "to_j").hint("merge")

    def others(rows: DataFrame) -> DataFrame:
        named = rows.select(*keys, F.col("i").alias("to_i"), F.col("j").alias("to_j"), *[F.col(c).alias(f"o_{c}") for c in ("id", "x", "y")])
        return spread(named, *keys, "to_i", "to_j")

    there = [*keys, "to_i", "to_j"]
    close = F.hypot(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")) <= near
    met = around(sized.filter(F.col("n") < least).drop("n"), steps).join(others(placed), there).filter(close)
    sparse = met.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("id")
    cores = cut_lineage(sized.filter(F.col("n") >= least).drop("n").unionByName(placed.join(sparse.hint("merge"), "id").select(placed.columns)))
    heads = cores.groupBy(*home).agg(F.min("id").alias("head"))
    inner = cores.join(heads.hint("merge"), home).filter(F.col("id") != F.col("head")).select(F.col("head").alias("a"), F.col("id").alias("b"))

    ahead = [s for s in steps if s > (0, 0)]
    pair = [*home, "to_i", "to_j"]
    # the structs hold the id first, so the least is one of the cores
    some = cores.groupBy(*home, cut("x", 8).alias("u"), cut("y", 8).alias("v")).agg(F.min(F.struct("id", "x", "y")).alias("m")).select(*home, "m.*")
    one = [F.min(F.struct(F.col("id").alias("a"), F.col("o_id").alias("b"))).alias("m")]
    first = cut_lineage(around(some, ahead).join(others(some), there).filter(close).groupBy(*pair).agg(*one).select(*pair, "m.*"))
    far = lambda c, to: F.greatest(F.lit(0.0), F.col(to) * side - F.col(c), F.col(c) - (F.col(to) + 1) * side)
    reaching = F.hypot(far("x", "to_i"), far("y", "to_j")) <= near * (1 + 1e-9)
    back = F.hypot(far("o_x", "i"), far("o_y", "j")) <= near * (1 + 1e-9)
    rest = around(cores, ahead).filter(reaching).join(first.select(*pair).hint("merge"), pair, "left_anti")
    second = rest.join(others(cores), there).filter(back & close).select(F.col("id").alias("a"), F.col("o_id").alias("b"))
    return cores.select("id"), inner.unionByName(first.select("a", "b")).unionByName(second)


def islands(rows: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """Runs of rows with a true ``flag``: ``by, first, last, n``."""
    group = Window.partitionBy(by).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(group)).filter(flag)
    runs = numbered.withColumn("_run", F.col("_n") - F.row_number().over(group))
    return runs.groupBy(by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")
