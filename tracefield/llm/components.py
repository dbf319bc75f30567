"""Connected components by hooking and pointer jumping, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that is not itself
    the least node of its component; ``root`` is that least node.

    In a round every node hooks to its least smaller neighbour, chains of
    hooks are halved until they are flat, and the edges are contracted to
    their roots.  What is left are local minima, so few rounds suffice.  No
    step gathers a component in one place.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    current = common.stage_table(edges.select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), "cc-edges")
    rounds: list[DataFrame] = []
    while current.limit(1).count():
        hooks = common.stage_table(current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "cc-hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = hooks.join(up, "root", "left").select(
                "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")
            )
            jumped = common.stage_table(jumped, "cc-jumps")
            common.drop_staged(hooks)
            moved = jumped.filter("moved").limit(1).count()
            hooks = jumped
            if not moved:
                break
        to_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        to_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        ends = current.join(to_a, "a", "left").join(to_b, "b", "left").select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
        )
        contracted = common.stage_table(ends.select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), "cc-edges")
        common.drop_staged(current)
        current = contracted
        rounds.append(hooks.select("node", "root"))
    if not rounds:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(later)
    return common.stage_table(found, "cc-roots") if len(rounds) > 1 else found
