"""Graph sources. A source pins a version of every table before any of them is read.

Tables are `nodes_<label>` (node_id, properties) and `edges_<type>` (edge_id, src_node_id, dst_node_id,
properties), lower case. Undeclared columns are ignored, a missing one is an error, and so is a column
of another type than declared. All reads are lazy, so column pruning and filters reach the files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema.types import Schema


#: Providers whose tables are files that can be read by their paths.
FILE_FORMATS = ("parquet", "orc", "csv", "json", "avro")
#: Folder of a table's commits, one small file each; Spark's readers pass it over.
COMMITS = "_commits"


class MissingTable(LookupError):
    """A declared table isn't there or has no committed data."""


class NonConforming(ValueError):
    """A table lacks a declared column or has it with another type."""


def table_name(kind: str, name: str) -> str:
    return f"{kind}_{name.lower()}"


def _filesystem(spark: SparkSession, path: str) -> tuple[object, Callable]:
    """The file system of a path by Spark's own settings, and what makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def commit_numbers(spark: SparkSession, path: str, open_too: bool = False) -> list[int]:
    """Numbers of a table's commits, in order; none where there is no log. An empty file is a commit still open."""
    fs, make = _filesystem(spark, path)
    log = make(f"{path}/{COMMITS}")
    if not fs.exists(log):
        return []
    return sorted(int(n) for s in fs.listStatus(log) if (n := s.getPath().getName().removesuffix(".json")).isdigit() and (open_too or s.getLen() > 0))


def committed_files(spark: SparkSession, path: str, upto: int) -> list[str]:
    """Data files of all commits up to a number, from its log on the driver (names only)."""
    fs, make = _filesystem(spark, path)
    files: list[str] = []
    for n in commit_numbers(spark, path):
        if n <= upto:
            stream = fs.open(make(f"{path}/{COMMITS}/{n}.json"))
            try:
                entry = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            files = [f"{path}/{x}" for x in entry["files"]] + ([] if entry["replaces"] else files)
    return files


def conform(df: DataFrame, declared: T.StructType, what: str) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in declared.fields:
        if f.name not in have:
            raise NonConforming(f"{what}: column {f.name} is missing")
        cols.append(_as_declared(F.col(f"`{f.name}`"), have[f.name], f.dataType, f"{what}.{f.name}").alias(f.name, metadata=f.metadata))
    return df.select(*cols)


def _as_declared(col: Column, have: T.DataType, want: T.DataType, what: str) -> Column:
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        kinds = (T.FloatType, T.DoubleType)
        if isinstance(have.elementType, kinds) and isinstance(want.elementType, kinds):
            return col.cast(want)
        _as_declared(col, have.elementType, want.elementType, what)
        return col
    if have == want:
        return col
    if isinstance(want, T.TimestampNTZType) and isinstance(have, T.TimestampType):
        return F.to_utc_timestamp(col, F.current_timezone()).cast(want)
    raise NonConforming(f"{what}: declared {want.simpleString()}, found {have.simpleString()}")


class GraphSource:
    """pin() names one version per table; read() opens a pinned version."""

    def tables(self, schema: Schema) -> Iterable[tuple[str, str]]:
        yield from (("nodes", x) for x in schema.nodes)
        yield from (("edges", x) for x in schema.edges)

    def pin(self, spark: SparkSession, schema: Schema) -> dict[tuple[str, str], object]:
        return {key: self.latest(spark, *key) for key in self.tables(schema)}

    def latest(self, spark: SparkSession, kind: str, name: str) -> object:
        raise NotImplementedError

    def read(self, spark: SparkSession, kind: str, name: str, version: object) -> DataFrame:
        raise NotImplementedError

    def version_id(self, version: object) -> str:
        return hashlib.sha256(repr(version).encode()).hexdigest()[:16]


class ParquetSource(GraphSource):
    """One folder per table, partitioned or not. A version is the list of data files, so later appends don't show.

    A folder that `commit_table` writes has a log of commits: there a version is the last commit's number,
    and files that no commit names are no data.
    """

    format, options = "parquet", {}

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _path(self, kind: str, name: str) -> str:
        return f"{self.root}/{table_name(kind, name)}"

    def latest(self, spark: SparkSession, kind: str, name: str) -> object:
        path = self._path(kind, name)
        if commits := commit_numbers(spark, path):
            return ("commit", commits[-1])
        try:
            files = tuple(sorted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{self.format}").load(path).inputFiles()))
        except AnalysisException as e:
            raise MissingTable(path) from e
        if not files:
            raise MissingTable(f"{path} has no committed data")
        return ("files", files)

    def files(self, spark: SparkSession, kind: str, name: str, version: tuple) -> list[str]:
        how, what = version
        return committed_files(spark, self._path(kind, name), what) if how == "commit" else list(what)

    def version_id(self, version: object) -> str:
        return f"commit-{version[1]}" if version[0] == "commit" else super().version_id(version)

    def read(self, spark: SparkSession, kind: str, name: str, version: object) -> DataFrame:
        # With the base path, folders such as day=1 below it give their columns; whole numbers there are Int64.
        files = self.files(spark, kind, name, version)
        df = spark.read.format(self.format).options(**self.options).option("basePath", self._path(kind, name)).load(files)
        folders = {part.split("=", 1)[0] for f in files for part in f.split("/")[:-1] if "=" in part}
        return df.withColumns({c.name: F.col(f"`{c.name}`").cast("long") for c in df.schema.fields if c.name in folders and isinstance(c.dataType, T.IntegerType)})


class CsvSource(ParquetSource):
    """The same layout as CSV files with a header; columns get their declared types, nothing is inferred."""

    format, options = "csv", {"header": "true", "enforceSchema": "false"}

    def __init__(self, root: str, schema: Schema):
        super().__init__(root)
        self.schema = schema

    def read(self, spark: SparkSession, kind: str, name: str, version: object) -> DataFrame:
        d = self.schema.nodes[name] if kind == "nodes" else self.schema.edges[name]
        return spark.read.options(**self.options).schema(d.struct()).csv(self.files(spark, kind, name, version))


class TableSource(GraphSource):
    """Catalog tables of any file format, partitioned or not.

    Where the catalog keeps snapshots (a `snapshots` metadata table), the newest is pinned. A table of files
    is pinned to its present files, read by its own provider with its options. A view, a Hive table or a
    table without files (JDBC) can't be pinned and is read as it is then.
    """

    def __init__(self, namespace: str, create: bool = False):
        self.namespace, self.create = namespace, create

    def _name(self, kind: str, name: str) -> str:
        return f"{self.namespace}.{table_name(kind, name)}"

    def pin(self, spark: SparkSession, schema: Schema) -> dict[tuple[str, str], object]:
        if self.create:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.namespace}")
        return super().pin(spark, schema)

    def latest(self, spark: SparkSession, kind: str, name: str) -> object:
        table = self._name(kind, name)
        if not spark.catalog.tableExists(table):
            raise MissingTable(table)
        try:
            rows = spark.sql(f"SELECT snapshot_id FROM {table}.snapshots ORDER BY committed_at DESC LIMIT 1").collect()
        except AnalysisException:
            about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
            if about.get("Provider", "").lower() not in FILE_FORMATS or "Location" not in about:
                return ("live", ())
            return ("files", tuple(sorted(spark.table(table).inputFiles())), about["Provider"].lower(), about["Location"], about.get("Storage Properties", ""))
        if not rows:
            raise MissingTable(f"{table} has no committed data")
        return ("snapshot", rows[0][0])

    def read(self, spark: SparkSession, kind: str, name: str, version: object) -> DataFrame:
        table, (how, what, *more) = self._name(kind, name), version
        if how == "snapshot":
            return spark.sql(f"SELECT * FROM {table} VERSION AS OF {what}")
        df = spark.table(table)
        if how == "live":
            return df
        if not what:  # nothing was there when it was pinned
            return df.where(F.lit(False))
        provider, location, properties = more
        options = dict(x.split("=", 1) for x in properties.strip("[]").split(", ") if "=" in x)
        return spark.read.format(provider).options(**options).schema(df.schema).option("basePath", location).load(list(what)).select(*(F.col(f"`{c}`") for c in df.columns))


class RegisteredSource(GraphSource):
    """Frames given by the caller, such as views derived from other tables."""

    def __init__(self):
        self._frames: dict[tuple[str, str], DataFrame | Callable[[], DataFrame]] = {}

    def register_nodes(self, label: str, df: DataFrame | Callable[[], DataFrame]) -> RegisteredSource:
        self._frames["nodes", label] = df
        return self

    def register_edges(self, edge_type: str, df: DataFrame | Callable[[], DataFrame]) -> RegisteredSource:
        self._frames["edges", edge_type] = df
        return self

    def latest(self, spark: SparkSession, kind: str, name: str) -> object:
        if (kind, name) not in self._frames:
            raise MissingTable(table_name(kind, name))
        return self._frames[kind, name]

    def read(self, spark: SparkSession, kind: str, name: str, version: object) -> DataFrame:
        return version() if callable(version) and not isinstance(version, DataFrame) else version

    def version_id(self, version: object) -> str:
        return f"{id(version):x}"
