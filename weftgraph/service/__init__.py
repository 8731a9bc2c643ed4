"""Answers queries over HTTP."""

from .http import QueryServer, result_rows

__all__ = ["QueryServer", "result_rows"]
