"""Query tree."""

from __future__ import annotations

from dataclasses import dataclass

OUT, IN = "->", "<-"
#: Operator -> the operator after swapping its sides.
FLIP = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass(frozen=True)
class Literal:
    kind: str  # String, Float64, Int64, Bool
    value: str | float | int | bool


@dataclass(frozen=True)
class PropRef:
    alias: str
    prop: str


@dataclass(frozen=True)
class PropCond:
    ref: PropRef
    op: str
    value: Literal

    @property
    def aliases(self) -> frozenset[str]:
        return frozenset([self.ref.alias])


@dataclass(frozen=True)
class PropCompare:
    left: PropRef
    op: str
    right: PropRef

    @property
    def aliases(self) -> frozenset[str]:
        return frozenset([self.left.alias, self.right.alias])


@dataclass(frozen=True)
class AliasCompare:
    left: str
    op: str
    right: str

    @property
    def aliases(self) -> frozenset[str]:
        return frozenset([self.left, self.right])


@dataclass(frozen=True)
class NodePattern:
    alias: str
    label: str | None = None
    filters: tuple[PropCond, ...] = ()


@dataclass(frozen=True)
class EdgePattern:
    direction: str
    alias: str | None = None
    edge_type: str | None = None
    min_hops: int = 1
    max_hops: int = 1

    @property
    def single(self) -> bool:
        return self.min_hops == self.max_hops == 1


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...] = ()

    @property
    def n_steps(self) -> int:
        return len(self.nodes) + len(self.edges)


@dataclass(frozen=True)
class NotExists:
    pattern: Pattern
    where: tuple[object, ...] = ()


@dataclass(frozen=True)
class ReturnItem:
    alias: str
    prop: str | None = None

    @property
    def column(self) -> str:
        return self.alias if self.prop is None else f"{self.alias}_{self.prop}"


@dataclass(frozen=True)
class OrderBy:
    ref: PropRef
    descending: bool = False


@dataclass(frozen=True)
class Query:
    pattern: Pattern
    where: tuple[object, ...]
    returns: tuple[ReturnItem, ...]
    order_by: OrderBy | None = None
    limit: int | None = None
