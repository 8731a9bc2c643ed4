"""The engine: text in, lazy DataFrame out."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .dsl import parse, validate
from .operators.compile import Compiler
from .operators.expand import MAX_HOPS
from .plans.logical import Plan
from .plans.lower import lower
from .schema import Schema, parse_schema
from .sources.graph import GraphSource
from .sources.snapshot import GraphSnapshot


class GraphEngine:
    """Queries a typed property graph.

    mode: 'strict' (the documented language) or 'compat' (see plans.lower). drop_dangling: edges whose
    far end has no node are no edges; set it False only for tables with enforced references, which
    saves a join per hop where the schema implies the label. simple_edges: edge types that have at most
    one edge from a node to another; their hops need no collapse of parallel edges. persist: keep the
    tables that queries use in memory.
    """

    def __init__(self, spark: SparkSession, schema: Schema | str, source: GraphSource, mode: str = "strict", drop_dangling: bool = True, max_hops: int = MAX_HOPS, persist: bool = False, reorder: bool = True, simple_edges: Iterable[str] = ()):
        if mode not in ("strict", "compat"):
            raise ValueError(f"unknown mode {mode}")
        self.spark, self.source, self.mode = spark, source, mode
        self._schema = parse_schema(schema) if isinstance(schema, str) else schema
        self.drop_dangling, self.max_hops, self.persist, self.reorder = drop_dangling, max_hops, persist, reorder
        self.simple_edges = frozenset(simple_edges)
        if unknown := self.simple_edges - set(self._schema.edges):
            raise ValueError(f"simple_edges: the schema has no {', '.join(sorted(unknown))}")
        self.metrics: dict[str, float] = defaultdict(float)
        self._lock = threading.Lock()
        self._history: dict[int, dict] = {}
        self._snapshot: GraphSnapshot | None = None
        self.refresh()

    # -- life cycle ----------------------------------------------------------------------------

    def refresh(self) -> GraphSnapshot:
        """Pins the newest versions and swaps the snapshot; frames made before keep the old one."""
        began = time.monotonic()
        try:
            new = GraphSnapshot(self.spark, self._schema, self.source, self.persist)
        except Exception:
            self.metrics["graph_rebuild_failures_total"] += 1
            raise
        with self._lock:
            self._snapshot = new
            self._history[len(self._history)] = new.pins
        self.metrics["graph_rebuild_seconds"] = time.monotonic() - began
        self.metrics["graph_rebuilds_total"] += 1
        return new

    def at(self, generation: int) -> GraphEngine:
        """An engine on the versions that the n-th refresh pinned (0: the first)."""
        other = object.__new__(GraphEngine)
        other.__dict__.update(self.__dict__)
        other._snapshot = GraphSnapshot(self.spark, self._schema, self.source, self.persist, self._history[generation])
        return other

    @property
    def snapshot(self) -> GraphSnapshot:
        with self._lock:
            return self._snapshot

    # -- service calls -------------------------------------------------------------------------

    def plan(self, text: str) -> Plan:
        query = parse(text)
        strict = self.mode == "strict"
        validate(query, self._schema, strict)
        return lower(query, self._schema, self.mode, self.reorder)

    def execute(self, text: str, hydrate: bool = False) -> DataFrame:
        """The query's rows: one per distinct full binding. hydrate adds <alias>_record columns.

        The frame is lazy, but for walks of more than CUT_EVERY hops, whose first depths are run at once.
        """
        began = time.monotonic()
        self.metrics["graph_queries_total"] += 1
        try:
            plan = self.plan(text)
            self.spark.sparkContext.setJobDescription(f"graph query: {' '.join(text.split())[:200]}")
            out = Compiler(self.spark, self._schema, self.snapshot, self.mode == "strict", self.drop_dangling, self.max_hops, self.simple_edges, self._took).run(plan, hydrate)
        except Exception:
            self.metrics["graph_query_errors_total"] += 1
            raise
        self.metrics["graph_plan_seconds"] = time.monotonic() - began
        return out

    def collect(self, text: str, hydrate: bool = False) -> list:
        """The query's rows on the driver, for results known to be small; measures the whole query."""
        began = time.monotonic()
        rows = self.execute(text, hydrate).collect()
        self._took("graph_query_latency_seconds", time.monotonic() - began)
        return rows

    def _took(self, name: str, seconds: float) -> None:
        """Adds a measurement to a sum and its count."""
        with self._lock:
            self.metrics[f"{name}_sum"] += seconds
            self.metrics[f"{name}_count"] += 1

    def metrics_text(self) -> str:
        """All metrics, with the snapshot's age, as Prometheus text."""
        with self._lock:
            now = dict(self.metrics) | {"graph_snapshot_age_seconds": time.time() - self._snapshot.built_at}
        lines = []
        for name in sorted(now):
            base = name.removesuffix("_sum").removesuffix("_count")
            kind = "summary" if base != name else "counter" if name.endswith("_total") else "gauge"
            if (head := f"# TYPE {base} {kind}") not in lines:
                lines.append(head)
            lines.append(f"{name} {now[name]:.6g}")
        return "\n".join(lines) + "\n"

    def explain(self, text: str) -> str:
        return self.plan(text).describe()

    def schema(self) -> Schema:
        return self._schema

    def status(self, counts: bool = False) -> dict:
        return self.snapshot.status(counts) | {"mode": self.mode}

    def health(self) -> bool:
        return self.spark.range(1).count() == 1
