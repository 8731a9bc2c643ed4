"""Logical plan of a query: plain data, no Spark.

A plan is a start, a chain of hops, conditions placed at the first step that binds all their aliases,
anti-joins after the chain, then sort, limit and projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..dsl.ast import NotExists, OrderBy, PropRef, ReturnItem


@dataclass(frozen=True)
class Start:
    alias: str
    labels: tuple[str, ...]  # labels the node may have
    conditions: tuple[object, ...] = ()
    never: bool = False  # the lookup can't find anything


@dataclass(frozen=True)
class Expand:
    source: str
    target: str
    edge_types: tuple[str, ...]
    outgoing: bool
    min_hops: int
    max_hops: int
    labels: tuple[str, ...]
    edge_alias: str | None = None
    conditions: tuple[object, ...] = ()
    rebind: str = ""  # the target is bound already: 'join' closes a cycle, 'overwrite' replaces it

    @property
    def single(self) -> bool:
        return self.min_hops == self.max_hops == 1


@dataclass(frozen=True)
class AntiJoin:
    source: str
    target: str
    edge_types: tuple[str, ...]
    edge_alias: str | None
    conditions: tuple[object, ...] = ()


@dataclass(frozen=True)
class Plan:
    start: Start
    hops: tuple[Expand, ...]
    anti: tuple[AntiJoin, ...]
    returns: tuple[ReturnItem, ...]
    order_by: OrderBy | None
    limit: int | None
    node_labels: dict[str, tuple[str, ...]]
    edge_types: dict[str, tuple[str, ...]]
    warnings: tuple[str, ...] = ()

    def needed(self) -> dict[str, set[str]]:
        """Properties by alias that anything after the scan reads."""
        refs: list[PropRef] = [PropRef(r.alias, r.prop) for r in self.returns if r.prop is not None]
        if self.order_by:
            refs.append(self.order_by.ref)
        for step in (self.start, *self.hops, *self.anti):
            for c in step.conditions:
                refs += [getattr(c, n) for n in ("ref", "left", "right") if isinstance(getattr(c, n, None), PropRef)]
        out: dict[str, set[str]] = {}
        for r in refs:
            out.setdefault(r.alias, set()).add(r.prop)
        return out

    def describe(self) -> str:
        lines = [f"Start {self.start.alias}:{'|'.join(self.start.labels)}" + f" where {len(self.start.conditions)} conditions" * bool(self.start.conditions)]
        for h in self.hops:
            arrow = "->" if h.outgoing else "<-"
            lines.append(f"Expand {h.source} {arrow} {h.target}:{'|'.join(h.labels)} by {'|'.join(h.edge_types)} *{h.min_hops}..{h.max_hops}" + f" where {len(h.conditions)} conditions" * bool(h.conditions))
        lines += [f"AntiJoin {a.source} -> {a.target} by {'|'.join(a.edge_types)}" for a in self.anti]
        if self.order_by:
            lines.append(f"Sort {self.order_by.ref.alias}.{self.order_by.ref.prop} {'DESC' if self.order_by.descending else 'ASC'}")
        if self.limit is not None:
            lines.append(f"Limit {self.limit}")
        lines.append("Project " + ", ".join(r.column for r in self.returns))
        return "\n".join([*lines, *(f"warning: {w}" for w in self.warnings)])


__all__ = ["AntiJoin", "Expand", "NotExists", "Plan", "Start"]
