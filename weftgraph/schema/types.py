"""Schema model. One label per node, one type per edge, no undeclared properties."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Declared scalar name -> Spark type.
SPARK_TYPES = {
    "Int64": T.LongType(),
    "Float64": T.DoubleType(),
    "Bool": T.BooleanType(),
    "String": T.StringType(),
    "Timestamp": T.TimestampNTZType(),
    "Bytes": T.BinaryType(),
}


@dataclass(frozen=True)
class ScalarType:
    """`kind` is one of SPARK_TYPES, 'List' (with `item`) or 'Vector' (with `dim`)."""

    kind: str
    item: ScalarType | None = None
    dim: int | None = None

    @property
    def composite(self) -> bool:
        return self.kind in ("List", "Vector")

    @property
    def ordered(self) -> bool:
        return self.kind in ("Int64", "Float64", "Timestamp")

    def spark(self) -> T.DataType:
        if self.kind == "List":
            return T.ArrayType(self.item.spark())
        if self.kind == "Vector":
            return T.ArrayType(T.FloatType())
        return SPARK_TYPES[self.kind]

    def __str__(self) -> str:
        if self.kind == "List":
            return f"List<{self.item}>"
        if self.kind == "Vector":
            return f"Vector<Float32, {self.dim}>"
        return self.kind


@dataclass(frozen=True)
class PropertyDef:
    name: str
    type: ScalarType
    optional: bool = False
    indexed: bool = False

    def field(self) -> T.StructField:
        meta = {"indexed": self.indexed} | ({"dim": self.type.dim} if self.type.kind == "Vector" else {})
        return T.StructField(self.name, self.type.spark(), True, meta)


class _Props:
    def prop(self, name: str) -> PropertyDef | None:
        return next((p for p in self.properties if p.name == name), None)


@dataclass(frozen=True)
class NodeDef(_Props):
    label: str
    properties: tuple[PropertyDef, ...] = ()

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("node_id", T.LongType(), False), *(p.field() for p in self.properties)])


@dataclass(frozen=True)
class EdgeDef(_Props):
    edge_type: str
    from_label: str
    to_label: str
    properties: tuple[PropertyDef, ...] = ()

    def struct(self) -> T.StructType:
        ids = [T.StructField(c, T.LongType(), False) for c in ("edge_id", "src_node_id", "dst_node_id")]
        return T.StructType([*ids, *(p.field() for p in self.properties)])


@dataclass(frozen=True)
class Schema:
    version: str
    nodes: dict[str, NodeDef] = field(default_factory=dict)
    edges: dict[str, EdgeDef] = field(default_factory=dict)

    def node(self, label: str) -> NodeDef | None:
        return self.nodes.get(label)

    def edge(self, edge_type: str) -> EdgeDef | None:
        return self.edges.get(edge_type)
