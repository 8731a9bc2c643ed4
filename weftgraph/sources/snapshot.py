"""An immutable view of all tables at pinned versions."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema.types import Schema
from .graph import GraphSource, conform, table_name


class GraphSnapshot:
    """Frames are opened on first use: a query never touches tables that it doesn't name."""

    def __init__(self, spark: SparkSession, schema: Schema, source: GraphSource, persist: bool = False, pins: dict | None = None):
        self.spark, self.schema, self.source, self.persist = spark, schema, source, persist
        self.pins = source.pin(spark, schema) if pins is None else pins  # all pins before any read
        self.built_at = time.time()
        self._frames: dict[tuple[str, str], DataFrame] = {}

    def _frame(self, kind: str, name: str) -> DataFrame:
        key = (kind, name)
        if key not in self._frames:
            d = self.schema.nodes[name] if kind == "nodes" else self.schema.edges[name]
            df = conform(self.source.read(self.spark, kind, name, self.pins[key]), d.struct(), table_name(kind, name))
            self._frames[key] = df.persist() if self.persist else df
        return self._frames[key]

    def nodes(self, label: str) -> DataFrame:
        return self._frame("nodes", label)

    def edges(self, edge_type: str) -> DataFrame:
        return self._frame("edges", edge_type)

    def check_ids(self) -> list[int]:
        """Up to ten node ids that several nodes share; ids must be unique across labels."""
        ids = [self.nodes(x).select("node_id") for x in self.schema.nodes]
        out = ids[0]
        for df in ids[1:]:
            out = out.unionByName(df)
        return [r[0] for r in out.groupBy("node_id").count().where(F.col("count") > 1).orderBy("node_id").limit(10).collect()]

    def unpersist(self) -> None:
        if self.persist:
            for df in self._frames.values():
                df.unpersist()

    def status(self, counts: bool = False) -> dict:
        out = {
            "schema_version": self.schema.version,
            "built_at": self.built_at,
            "snapshots": {table_name(*k): self.source.version_id(v) for k, v in self.pins.items()},
        }
        if counts:
            out["node_count"] = sum(self.nodes(x).count() for x in self.schema.nodes)
            out["edge_count"] = sum(self.edges(x).count() for x in self.schema.edges)
        return out
