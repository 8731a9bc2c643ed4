"""Node and edge scans with the columns a plan needs, as narrow frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema.types import Schema, ScalarType


def prop_types(schema: Schema, owners: tuple[str, ...], names: set[str], edges: bool = False) -> dict[str, ScalarType]:
    """Declared type of each property: that of the first owner which has it."""
    out: dict[str, ScalarType] = {}
    for owner in owners:
        holder = (schema.edge if edges else schema.node)(owner)
        for n in sorted(names):
            if n not in out and (p := holder.prop(n)):
                out[n] = p.type
    return out


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def node_scan(snapshot, schema: Schema, labels: tuple[str, ...], names: set[str], alias: str) -> DataFrame | None:
    """One row per node of the labels: n__alias and p__alias__prop. None for no label."""
    kinds = prop_types(schema, labels, names)
    frames = []
    for label in labels:
        d, df = schema.nodes[label], snapshot.nodes(label)
        props = [(F.col(n) if (p := d.prop(n)) and p.type == kinds[n] else F.lit(None).cast(kinds[n].spark())).alias(f"p__{alias}__{n}") for n in sorted(kinds)]
        frames.append(df.select(F.col("node_id").alias(f"n__{alias}"), *props))
    return union(frames) if frames else None


def edge_scan(snapshot, schema: Schema, types: tuple[str, ...], names: set[str], outgoing: bool, with_id: bool) -> DataFrame | None:
    """One row per edge: x__from, x__to in walking direction, x__edge if asked, x__p__prop."""
    kinds = prop_types(schema, types, names, edges=True)
    near, far = ("src_node_id", "dst_node_id") if outgoing else ("dst_node_id", "src_node_id")
    frames = []
    for t in types:
        d, df = schema.edges[t], snapshot.edges(t)
        props = [(F.col(n) if (p := d.prop(n)) and p.type == kinds[n] else F.lit(None).cast(kinds[n].spark())).alias(f"x__p__{n}") for n in sorted(kinds)]
        ids = [F.col(near).alias("x__from"), F.col(far).alias("x__to"), *([F.col("edge_id").alias("x__edge")] if with_id else [])]
        frames.append(df.select(*ids, *props))
    return union(frames) if frames else None
