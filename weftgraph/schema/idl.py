"""Parser of the schema text format.

``schema v1 { node N { id: NodeId  @indexed p: String? } edge E { from: N to: N  q: Int64 } }``
with ``//`` comments. Errors carry the offset at which reading stopped.
"""

from __future__ import annotations

from ..functions.scan import Scanner, ScanError
from .types import SPARK_TYPES, EdgeDef, NodeDef, PropertyDef, ScalarType, Schema


class SchemaError(ValueError):
    """The schema text can't be read, or names unknown or repeated types."""


def parse_schema(text: str) -> Schema:
    try:
        return _schema(Scanner(text))
    except ScanError as e:
        raise SchemaError(str(e)) from e


def _schema(s: Scanner) -> Schema:
    s.word("schema")
    version, nodes, edges = s.ident(), {}, {}
    s.take("{")
    while not s.accept("}"):
        if s.accept_word("node"):
            name = s.ident()
            s.take("{")
            s.word("id"), s.take(":"), s.word("NodeId")
            if name in nodes:
                raise SchemaError(f"duplicate node label: {name}")
            nodes[name] = NodeDef(name, _properties(s))
        elif s.accept_word("edge"):
            name = s.ident()
            s.take("{")
            s.word("from"), s.take(":")
            source = s.ident()
            s.word("to"), s.take(":")
            target = s.ident()
            if name in edges:
                raise SchemaError(f"duplicate edge type: {name}")
            edges[name] = EdgeDef(name, source, target, _properties(s))
        else:
            s.fail("expected a node or edge declaration")
    s.end()
    for e in edges.values():
        for side, label in (("source", e.from_label), ("target", e.to_label)):
            if label not in nodes:
                raise SchemaError(f"edge {e.edge_type}: unknown {side} label: {label}")
    return Schema(version, dict(sorted(nodes.items())), dict(sorted(edges.items())))


def _properties(s: Scanner) -> tuple[PropertyDef, ...]:
    out = []
    while not s.accept("}"):
        indexed = s.accept("@indexed")
        name = s.ident()
        s.take(":")
        kind = _type(s)
        out.append(PropertyDef(name, kind, optional=s.accept("?"), indexed=indexed))
    return tuple(out)


def _type(s: Scanner) -> ScalarType:
    name = s.ident()
    if name == "List":
        s.take("<")
        item = _type(s)
        s.take(">")
        return ScalarType("List", item=item)
    if name == "Vector":
        s.take("<")
        s.word("Float32"), s.take(",")
        dim = s.number()
        s.take(">")
        return ScalarType("Vector", dim=dim)
    if name not in SPARK_TYPES:
        s.fail(f"unknown type {name}")
    return ScalarType(name)
