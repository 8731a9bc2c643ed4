"""Where node and edge tables come from and where results go."""

from .graph import CsvSource, GraphSource, MissingTable, NonConforming, ParquetSource, RegisteredSource, TableSource
from .sinks import append_table, commit_table, to_json_rows, to_node_link

__all__ = ["CsvSource", "GraphSource", "MissingTable", "NonConforming", "ParquetSource", "RegisteredSource", "TableSource", "append_table", "commit_table", "to_json_rows", "to_node_link"]
