"""Comparisons whose typing is decided at plan time.

Spark would coerce ('1990' = 1990 is true, a malformed string raises under ANSI). Here a literal whose
kind differs from the declared type never matches, and neither does a null, a missing value or NaN.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dsl.ast import Literal
from ..schema.types import ScalarType

_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)")


def rfc3339_utc(text: str) -> datetime | None:
    """The naive UTC time of an RFC 3339 string, to the microsecond; None if it isn't one."""
    if not (m := _RFC3339.fullmatch(text)):
        return None
    try:
        at = datetime.fromisoformat(f"{m[1]}T{m[2]}")
        at += timedelta(microseconds=int((m[3] or ".0")[1:7].ljust(6, "0")))
        if m[4] not in "Zz":
            hours, minutes = int(m[4][1:3]), int(m[4][4:])
            if hours > 23 or minutes > 59:
                return None
            off = timedelta(hours=hours, minutes=minutes)
            at -= off if m[4][0] == "+" else -off
        return at.replace(tzinfo=timezone.utc).replace(tzinfo=None)
    except (ValueError, OverflowError):
        return None


def apply_op(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _not_nan(kind: ScalarType, *cols: Column) -> Column:
    return ~(F.isnan(cols[0]) if len(cols) == 1 else F.isnan(cols[0]) | F.isnan(cols[1])) if kind.kind == "Float64" else F.lit(True)


def literal_column(kind: ScalarType, lit: Literal) -> Column | None:
    """The literal as a column of the declared type; None where it can't match."""
    if kind.kind == "Timestamp" and lit.kind == "String":
        at = rfc3339_utc(lit.value)
        return None if at is None else F.lit(at.isoformat(sep=" ")).cast(T.TimestampNTZType())
    return F.lit(lit.value).cast(kind.spark()) if lit.kind == kind.kind else None


def compare_literal(col: Column, kind: ScalarType, op: str, lit: Literal) -> Column:
    value = literal_column(kind, lit)
    if value is None:
        return F.lit(False)
    test = apply_op(col, op, value)
    return test & _not_nan(kind, col) if kind.kind == "Float64" else test


def compare_columns(left: Column, left_kind: ScalarType, op: str, right: Column, right_kind: ScalarType) -> Column:
    if left_kind != right_kind or left_kind.composite:
        return F.lit(False)
    test = apply_op(left, op, right)
    return test & _not_nan(left_kind, left, right) if left_kind.kind == "Float64" else test


def compare_ids(left: Column, op: str, right: Column) -> Column:
    """Ids are unsigned 64-bit values in a BIGINT; flipping the top bit gives their order."""
    if op in ("=", "<>"):
        return apply_op(left, op, right)
    top = F.lit(-(2**63)).cast("bigint")
    return apply_op(left.bitwiseXOR(top), op, right.bitwiseXOR(top))
