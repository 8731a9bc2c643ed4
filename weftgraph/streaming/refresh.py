"""Rebuilds an engine's snapshot at an interval; a failed rebuild leaves the old one in place."""

from __future__ import annotations

import logging
import threading

log = logging.getLogger(__name__)


class RefreshLoop:
    def __init__(self, engine, interval_s: float = 30.0):
        self.engine, self.interval_s, self.failures = engine, interval_s, 0
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def once(self) -> bool:
        try:
            self.engine.refresh()
            return True
        except Exception:
            self.failures += 1
            log.exception("refresh failed; the former snapshot stays in use")
            return False

    def _run(self) -> None:
        while not self._stop.wait(self.interval_s):
            self.once()

    def start(self) -> RefreshLoop:
        self._thread = threading.Thread(target=self._run, daemon=True, name="graph-refresh")
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join(self.interval_s + 5)
