"""Periodic refresh. Queries are batch only; this keeps a long-lived engine on recent snapshots."""

from .refresh import RefreshLoop

__all__ = ["RefreshLoop"]
