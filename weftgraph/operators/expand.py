"""Hops: one join for a single hop, a bounded chain of joins for a walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Walks longer than this are refused unless the engine is told otherwise.
MAX_HOPS = 32
#: A walk's plan is cut after so many depths where the session has a checkpoint folder, so that it grows
#: with the depth and not with its square. Cutting runs the depths so far when the query is compiled.
CUT_EVERY = 4


def single_hop(bindings: DataFrame, source: str, edges: DataFrame) -> DataFrame:
    return bindings.join(edges, F.col(f"n__{source}") == F.col("x__from"), "inner").drop("x__from")


def walk_pairs(starts: DataFrame, edges: DataFrame, low: int, high: int, cut: bool) -> DataFrame | None:
    """Distinct (x__from, x__to) with a walk of low..high edges (at least one) from a start.

    Each depth holds a pair once, so cycles and parallel edges can't multiply; several bindings that
    stand on one node share its walk.
    """
    low = max(low, 1)
    if high < low:
        return None
    step = edges.select(F.col("x__from").alias("s__from"), F.col("x__to").alias("s__to")).distinct()
    front = starts.select(F.col("x__from"), F.col("x__from").alias("x__to")).distinct()
    depths = []
    for depth in range(1, high + 1):
        front = front.join(step, F.col("x__to") == F.col("s__from"), "inner").select("x__from", F.col("s__to").alias("x__to")).distinct()
        if cut and depth % CUT_EVERY == 0 and depth < high:
            front = front.checkpoint()
        if depth >= low:
            depths.append(front)
    out = depths[0]
    for d in depths[1:]:
        out = out.unionByName(d)
    return out.distinct() if len(depths) > 1 else out
