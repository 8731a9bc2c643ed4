"""Typed property graphs on Spark: schema text, pattern queries, lazy DataFrames."""

from .engine import GraphEngine
from .schema import Schema, parse_schema
from .sources import CsvSource, ParquetSource, RegisteredSource, TableSource

__all__ = ["CsvSource", "GraphEngine", "ParquetSource", "RegisteredSource", "Schema", "TableSource", "parse_schema"]
