"""Logical plan -> one lazy DataFrame.

A binding is a row: n__<alias> and e__<alias> are ids, p__<alias>__<prop> the properties that later
steps read. Nothing is collected; Catalyst and AQE choose the join strategies.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dsl.ast import FLIP, AliasCompare, PropCompare, PropCond, PropRef
from ..functions.typed import compare_columns, compare_ids, compare_literal
from ..plans.logical import AntiJoin, Expand, Plan
from ..schema.types import ScalarType, Schema
from .expand import MAX_HOPS, single_hop, walk_pairs
from .resolve import edge_scan, node_scan, prop_types


class HopLimit(ValueError):
    """A walk's upper bound is above the engine's."""


class Compiler:
    def __init__(self, spark: SparkSession, schema: Schema, snapshot, strict: bool = True, drop_dangling: bool = True, max_hops: int = MAX_HOPS, simple_edges: frozenset[str] = frozenset(), took: Callable[[str, float], None] | None = None):
        self.simple_edges, self.took = simple_edges, took
        self.spark, self.schema, self.snapshot = spark, schema, snapshot
        self.strict, self.drop_dangling, self.max_hops = strict, drop_dangling, max_hops

    def run(self, plan: Plan, hydrate: bool = False) -> DataFrame:
        self.plan, self.needed = plan, plan.needed()
        df, repeats = self._start(), False
        for i, hop in enumerate(plan.hops):
            began = time.monotonic()
            df = self._hop(df, hop)
            repeats |= self._may_repeat(hop)
            if repeats and i + 1 < len(plan.hops):  # else the next hop would multiply the repeats
                df, repeats = df.distinct(), False
            if self.took is not None:
                self.took("graph_hop_latency_seconds", time.monotonic() - began)
        for anti in plan.anti:
            df = self._anti(df, anti)
        if repeats:
            df = df.distinct()
        if plan.order_by:
            key = self._column(plan.order_by.ref)[0]
            df = df.orderBy(key.desc_nulls_first() if plan.order_by.descending else key.asc_nulls_last())
        if plan.limit is not None:
            df = df.limit(min(plan.limit, 2**31 - 1))
        return self._project(df, hydrate)

    # -- steps ---------------------------------------------------------------------------------

    def _may_repeat(self, h: Expand) -> bool:
        """A binding can come twice: from parallel edges that no alias tells apart, or when a name is bound anew."""
        if h.rebind:
            return True
        simple = len(h.edge_types) <= 1 and self.simple_edges.issuperset(h.edge_types)
        return h.edge_alias is None and h.single and not simple  # a walk gives each pair once

    def _empty(self, columns: list[tuple[str, T.DataType]]) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in columns]))

    def _node_columns(self, alias: str, labels: tuple[str, ...]) -> list[tuple[str, T.DataType]]:
        kinds = self._kinds(alias, labels)
        return [(f"n__{alias}", T.LongType()), *((f"p__{alias}__{n}", k.spark()) for n, k in sorted(kinds.items()))]

    def _kinds(self, alias: str, labels: tuple[str, ...]) -> dict[str, ScalarType]:
        names = self.needed.get(alias, set())
        return prop_types(self.schema, labels or tuple(self.schema.nodes), names)

    def _start(self) -> DataFrame:
        s = self.plan.start
        df = node_scan(self.snapshot, self.schema, s.labels, self.needed.get(s.alias, set()), s.alias)
        if df is None:
            df = self._empty(self._node_columns(s.alias, s.labels))
        if s.never:
            df = df.where(F.lit(False))
        return self._where(df, s.conditions)

    def _hop(self, df: DataFrame, h: Expand) -> DataFrame:
        if h.max_hops > self.max_hops:
            raise HopLimit(f"*{h.min_hops}..{h.max_hops} is above the bound of {self.max_hops} hops")
        names = self.needed.get(h.edge_alias, set()) if h.edge_alias else set()
        edges = edge_scan(self.snapshot, self.schema, h.edge_types, names, h.outgoing, h.edge_alias is not None)
        if edges is not None and not h.single:
            if self.drop_dangling:
                edges = self._attached(edges, h)
            cut = self.spark.conf.get("spark.checkpoint.dir", None) is not None or self.spark.sparkContext.getCheckpointDir() is not None
            starts = df.select(F.col(f"n__{h.source}").alias("x__from"))
            edges = walk_pairs(starts, edges, h.min_hops, h.max_hops, cut)
        if edges is None:
            kinds = prop_types(self.schema, h.edge_types or tuple(self.schema.edges), names, edges=True)
            ids = ["x__from", "x__to", *(["x__edge"] if h.edge_alias else [])]
            edges = self._empty([*((c, T.LongType()) for c in ids), *((f"x__p__{n}", k.spark()) for n, k in sorted(kinds.items()))])
        df = single_hop(df, h.source, edges)
        if h.edge_alias is not None:
            df = self._bind_edge(df, h)
        if h.rebind == "join":  # closes a cycle: the properties are bound already
            df = df.where(F.col("x__to") == F.col(f"n__{h.target}")).drop("x__to")
        else:
            if h.rebind == "overwrite":
                df = df.drop(*(c for c in df.columns if c == f"n__{h.target}" or c.startswith(f"p__{h.target}__")))
            df = self._bind_target(df, h)
        return self._where(df, h.conditions)

    def _bind_edge(self, df: DataFrame, h: Expand) -> DataFrame:
        own = f"e__{h.edge_alias}"
        props = [c for c in df.columns if c.startswith("x__p__")]
        if own in df.columns:
            df = df.where(F.col(own) == F.col("x__edge")) if self.strict else df.drop(own, *(c for c in df.columns if c.startswith(f"p__{h.edge_alias}__")))
            if self.strict:
                return df.drop("x__edge", *props)
        return df.withColumnsRenamed({"x__edge": own} | {c: f"p__{h.edge_alias}__{c[6:]}" for c in props})

    def _bind_target(self, df: DataFrame, h: Expand) -> DataFrame:
        """Joins the target's label table where it restricts, checks existence or has properties."""
        nodes = node_scan(self.snapshot, self.schema, h.labels, self.needed.get(h.target, set()), h.target)
        own = f"n__{h.target}"
        if nodes is None:
            for name, kind in self._node_columns(h.target, h.labels)[1:]:
                df = df.withColumn(name, F.lit(None).cast(kind))
            return df.withColumnRenamed("x__to", own).where(F.lit(False))
        if len(nodes.columns) > 1:
            return df.join(nodes, F.col("x__to") == F.col(own), "inner").drop("x__to")
        if self.drop_dangling or self._label_restricts(h):
            df = df.join(nodes, F.col("x__to") == F.col(own), "left_semi")
        return df.withColumnRenamed("x__to", own)

    def _label_restricts(self, h: Expand) -> bool:
        ends = {self.schema.edges[t].to_label if h.outgoing else self.schema.edges[t].from_label for t in h.edge_types}
        return not ends <= set(h.labels)

    def _attached(self, edges: DataFrame, h: Expand) -> DataFrame:
        """Edges whose far end exists; the near end is always a node that was reached."""
        ends = {self.schema.edges[t].to_label if h.outgoing else self.schema.edges[t].from_label for t in h.edge_types}
        ids = node_scan(self.snapshot, self.schema, tuple(sorted(ends)), set(), "y")
        return edges.join(ids, F.col("x__to") == F.col("n__y"), "left_semi")

    def _anti(self, df: DataFrame, a: AntiJoin) -> DataFrame:
        own, names, residual = a.edge_alias, set(), []
        for c in a.conditions:
            names |= {r.prop for r in (getattr(c, n, None) for n in ("ref", "left", "right")) if isinstance(r, PropRef) and r.alias == own}
        edges = edge_scan(self.snapshot, self.schema, a.edge_types, names, True, False)
        if edges is None:
            return df
        kinds = prop_types(self.schema, a.edge_types, names, edges=True)

        def inner(r: PropRef) -> tuple[Column, ScalarType]:
            return F.col(f"x__p__{r.prop}"), kinds[r.prop]

        for c in a.conditions:
            if isinstance(c, PropCond) and c.ref.alias == own:
                edges = edges.where(compare_literal(*inner(c.ref), c.op, c.value))
            elif isinstance(c, PropCompare) and c.left.alias == c.right.alias == own:
                (left, lk), (right, rk) = inner(c.left), inner(c.right)
                edges = edges.where(compare_columns(left, lk, c.op, right, rk))
            elif isinstance(c, PropCompare) and own is not None and own in c.aliases:
                mine, op, other = (c.left, c.op, c.right) if c.left.alias == own else (c.right, FLIP[c.op], c.left)
                outer, ok = self._column(other)
                if not self.strict and ok.kind not in ("String", "Int64", "Float64", "Bool"):
                    return df.where(F.lit(False))
                df = df.where(outer.isNotNull())  # a binding whose outer value is null is dropped
                residual.append(compare_columns(*inner(mine), op, outer, ok))
            else:
                residual.append(self._condition(c))
        on = (F.col(f"n__{a.source}") == F.col("x__from")) & (F.col(f"n__{a.target}") == F.col("x__to"))
        for r in residual:
            on &= r
        return df.join(edges, on, "left_anti")

    # -- conditions and output -----------------------------------------------------------------

    def _column(self, ref: PropRef) -> tuple[Column, ScalarType]:
        if ref.alias in self.plan.edge_types:
            kind = prop_types(self.schema, self.plan.edge_types[ref.alias] or tuple(self.schema.edges), {ref.prop}, edges=True).get(ref.prop)
        else:
            kind = self._kinds(ref.alias, self.plan.node_labels[ref.alias]).get(ref.prop)
        if kind is None:  # no label that the node can have has it
            return F.lit(None).cast("string"), ScalarType("String")
        return F.col(f"p__{ref.alias}__{ref.prop}"), kind

    def _condition(self, c: object) -> Column:
        if isinstance(c, PropCond):
            return compare_literal(*self._column(c.ref), c.op, c.value)
        if isinstance(c, AliasCompare):
            return compare_ids(F.col(f"n__{c.left}"), c.op, F.col(f"n__{c.right}"))
        (left, lk), (right, rk) = self._column(c.left), self._column(c.right)
        return compare_columns(left, lk, c.op, right, rk)

    def _where(self, df: DataFrame, conditions: tuple[object, ...]) -> DataFrame:
        for c in conditions:
            df = df.where(self._condition(c))
        return df

    def _project(self, df: DataFrame, hydrate: bool) -> DataFrame:
        out: dict[str, Column] = {}
        records: list[tuple[str, str, bool]] = []
        for r in self.plan.returns:
            edge = r.alias in self.plan.edge_types
            col = F.col(f"{'e' if edge else 'n'}__{r.alias}") if r.prop is None else self._column(PropRef(r.alias, r.prop))[0]
            if r.column in out and (r.alias, r.prop) not in {(x.alias, x.prop) for x in self.plan.returns if x is not r}:
                raise ValueError(f"two results would be called {r.column}")
            out[r.column] = col.alias(r.column)
            if r.prop is None and hydrate:
                records.append((r.alias, f"{'e' if edge else 'n'}__{r.alias}", edge))
        for alias, own, edge in records:
            name = f"{alias}_record"
            if name in out:
                raise ValueError(f"two results would be called {name}")
            df = self._with_record(df, alias, own, edge, name)
            out[name] = F.col(name)
        return df.select(*out.values())

    def _with_record(self, df: DataFrame, alias: str, own: str, edge: bool, name: str) -> DataFrame:
        """Left-joins the full record: a struct for one owner, else the owner and its properties as JSON."""
        owners = self.plan.edge_types[alias] if edge else self.plan.node_labels[alias]
        key, tag = ("edge_id", "edge_type") if edge else ("node_id", "label")
        frames = []
        for o in owners:
            d = (self.schema.edges if edge else self.schema.nodes)[o]
            props = [p for p in d.properties if self.strict or not p.type.composite]
            src = self.snapshot.edges(o) if edge else self.snapshot.nodes(o)
            body = [F.col(p.name) for p in props]
            rec = F.struct(F.lit(o).alias(tag), *body) if len(owners) == 1 else F.struct(F.lit(o).alias(tag), F.to_json(F.struct(*body) if body else F.struct(F.lit(o).alias(tag))).alias("properties"))
            frames.append(src.select(F.col(key).alias("r__id"), rec.alias(name)))
        recs = frames[0]
        for f in frames[1:]:
            recs = recs.unionByName(f)
        return df.join(recs, F.col(own) == F.col("r__id"), "left").drop("r__id")
