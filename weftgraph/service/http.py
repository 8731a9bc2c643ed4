"""Queries over HTTP: POST /api/query {"dsl": "MATCH ..."} gives {"rows": [...]}; GET /metrics and /health.

A row is one JSON object. A bare node is {"label", "properties"}, a bare edge {"edge_type", "properties"},
either {"node_id"} or {"edge_id"} if its record is gone; alias.property is a plain value, null if absent.
Timestamps are ISO 8601 text. 400: the request or the query is at fault; 502: Spark can't be reached; 500:
anything else; the body is then {"error"}. Rows are streamed one Spark partition at a time, so a result of
any size passes; a fault after the first row breaks off the response, which then lacks its last chunk.
"""

from __future__ import annotations

import itertools
import json
import logging
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

from py4j.protocol import Py4JNetworkError
from pyspark.sql import functions as F

from ..dsl import SyntaxFault, ValidationFailed
from ..operators.compile import HopLimit
from ..plans.lower import UnsupportedShape

log = logging.getLogger(__name__)

#: Bytes of a request's body; more is refused.
MAX_BODY = 1 << 20
_JSON = {"ignoreNullFields": "false"}


def _shape(item, record: dict | None, value: object, edge: bool, nested: bool) -> object:
    if item.prop is not None:
        return value
    key, tag = ("edge_id", "edge_type") if edge else ("node_id", "label")
    if record is None:
        return {key: value}
    kind = record.pop(tag)
    return {tag: kind, "properties": json.loads(record["properties"]) if nested else record}


def result_rows(engine, text: str) -> Iterator[dict]:
    """The query's rows as the bridge shows them; the query is checked when this is called."""
    plan = engine.plan(text)
    kinds = {r: r.alias in plan.edge_types for r in plan.returns}
    owners = {r: len((plan.edge_types if kinds[r] else plan.node_labels)[r.alias]) for r in plan.returns}
    df = engine.execute(text, hydrate=True)
    lines = df.select(F.to_json(F.struct("*"), _JSON).alias("j")).toLocalIterator()

    def shaped() -> Iterator[dict]:
        for line in lines:
            row = json.loads(line["j"])
            yield {r.alias if r.prop is None else f"{r.alias}.{r.prop}": _shape(r, row.get(f"{r.alias}_record"), row[r.column], kinds[r], owners[r] != 1) for r in plan.returns}

    return shaped()


class QueryServer:
    """Serves an engine; port 0 takes a free one. `with QueryServer(engine) as s:` runs it beside the caller."""

    def __init__(self, engine, host: str = "127.0.0.1", port: int = 8080):
        class Handler(_Handler):
            pass

        Handler.engine = engine
        self._server = ThreadingHTTPServer((host, port), Handler)
        self._server.daemon_threads = True
        self.host, self.port = self._server.server_address[:2]
        self._thread: Thread | None = None

    def __enter__(self) -> QueryServer:
        self._thread = Thread(target=self._server.serve_forever, daemon=True, name="graph-http")
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._server.shutdown()
        self._server.server_close()
        self._thread.join()

    def serve_forever(self) -> None:
        self._server.serve_forever()


class _Handler(BaseHTTPRequestHandler):
    engine = None
    protocol_version = "HTTP/1.1"

    def log_message(self, form: str, *args) -> None:
        log.info(form, *args)

    def _send(self, code: int, body: str, kind: str = "application/json") -> None:
        data = body.encode()
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _fail(self, code: int, message: str, close: bool = False) -> None:
        self.close_connection |= close
        self._send(code, json.dumps({"error": message}))

    def do_GET(self) -> None:
        if self.path == "/metrics":
            self._send(200, self.engine.metrics_text(), "text/plain; version=0.0.4")
        elif self.path == "/health":
            try:
                ok = self.engine.health()
            except Exception:
                ok = False
            self._send(200 if ok else 502, json.dumps({"ok": ok}))
        else:
            self._fail(404, "nothing here")

    def do_POST(self) -> None:
        size = self.headers.get("Content-Length", "")
        if not size.isdecimal() or int(size) > MAX_BODY:
            return self._fail(400, f"a body of known length, at most {MAX_BODY} bytes, is needed", close=True)
        body = self.rfile.read(int(size))
        if self.path != "/api/query":
            return self._fail(404, "nothing here")
        try:
            text = json.loads(body)["dsl"]
        except (ValueError, KeyError, TypeError):
            text = None
        if not isinstance(text, str):
            return self._fail(400, 'the body has to be {"dsl": "..."}')
        try:
            rows = result_rows(self.engine, text)
            first = list(itertools.islice(rows, 1))
        except (SyntaxFault, ValidationFailed, UnsupportedShape, HopLimit) as fault:
            return self._fail(400, str(fault))
        except (Py4JNetworkError, ConnectionError) as fault:
            return self._fail(502, f"Spark can't be reached: {fault}")
        except Exception as fault:
            log.exception("query failed")
            return self._fail(500, str(fault).splitlines()[0] if str(fault) else type(fault).__name__)
        self.send_response(200)
        self.send_header("Content-Type", "application/json")
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()
        self._chunk('{"rows": [')
        try:
            for i, row in enumerate(itertools.chain(first, rows)):
                self._chunk((", " if i else "") + json.dumps(row))
        except Exception:
            log.exception("query failed after its first rows")
            self.close_connection = True
            return None
        self._chunk("]}")
        self.wfile.write(b"0\r\n\r\n")
        return None

    def _chunk(self, text: str) -> None:
        data = text.encode()
        self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")
