"""Writers and row shapes for results and graphs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema.types import Schema
from .graph import COMMITS, _filesystem, commit_numbers, conform, table_name


def append_table(df: DataFrame, schema: Schema, kind: str, name: str, root: str, mode: str = "append") -> None:
    """Appends Parquet files to a table's folder without a log; readers that pinned earlier files don't see them."""
    d = schema.nodes[name] if kind == "nodes" else schema.edges[name]
    conform(df, d.struct(), table_name(kind, name)).write.mode(mode).parquet(f"{root.rstrip('/')}/{table_name(kind, name)}")


def commit_table(df: DataFrame, schema: Schema, kind: str, name: str, root: str, replace: bool = False) -> int:
    """Commits rows to a node or edge table in one step; returns the commit's number, its snapshot id.

    Data files are written first, under a folder of their own that no reader counts as data yet. The commit
    is the creation of one log file, which fails if another writer took the number; then the next one is
    tried. So readers see all rows or none, and a writer that dies leaves only files that nothing names.
    `replace` makes the rows the whole table.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{table_name(kind, name)}"
    d = schema.nodes[name] if kind == "nodes" else schema.edges[name]
    folder = f"data/{uuid.uuid4().hex}"
    conform(df, d.struct(), table_name(kind, name)).write.parquet(f"{path}/{folder}")
    fs, make = _filesystem(spark, path)
    files = sorted(f"{folder}/{n}" for s in fs.listStatus(make(f"{path}/{folder}")) if (n := s.getPath().getName()).endswith(".parquet"))
    entry = json.dumps({"files": files, "replaces": replace, "at": time.time()}).encode()
    while True:
        number = max(commit_numbers(spark, path, open_too=True), default=-1) + 1
        try:
            stream = fs.create(make(f"{path}/{COMMITS}/{number}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                continue
            raise
        try:
            stream.write(bytearray(entry))
        finally:
            stream.close()
        return number


def to_node_link(snapshot) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the whole graph: ids, the label or type, and the properties as JSON."""

    def shape(df: DataFrame, keys: dict[str, str], kind: str, value: str) -> DataFrame:
        props = [F.col(c) for c in df.columns if c not in keys]
        body = F.to_json(F.struct(*props)) if props else F.lit("{}")
        return df.select(*(F.col(k).alias(v) for k, v in keys.items()), F.lit(value).alias(kind), body.alias("properties"))

    nodes = [shape(snapshot.nodes(x), {"node_id": "id"}, "label", x) for x in snapshot.schema.nodes]
    links = [shape(snapshot.edges(x), {"edge_id": "id", "src_node_id": "source", "dst_node_id": "target"}, "edge_type", x) for x in snapshot.schema.edges]
    out = []
    for frames in (nodes, links):
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
        out.append(df)
    return out[0], out[1]


def to_json_rows(df: DataFrame) -> Iterator[str]:
    """One JSON object per row, absent values left out, streamed partition by partition."""
    for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        yield row["j"]
