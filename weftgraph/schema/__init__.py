"""Typed, versioned graph schemas: model, text format, evolution check."""

from .evolution import Evolution, diff
from .idl import SchemaError, parse_schema
from .types import EdgeDef, NodeDef, PropertyDef, ScalarType, Schema

__all__ = ["EdgeDef", "Evolution", "NodeDef", "PropertyDef", "ScalarType", "Schema", "SchemaError", "diff", "parse_schema"]
