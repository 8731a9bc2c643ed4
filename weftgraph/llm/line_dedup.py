"""Line dedup: range-partitioned hashes, secondary sort, streamed verdicts, keep bitmaps.

Each text gives one row per distinct long line key: its 128-bit hash, the document and the line numbers.
Rows are range-partitioned and sorted by (hash, document from the largest); a range can end inside a hash,
so one very common line is dealt over many tasks. Two small facts per partition (how its first and last
hash go on) let every task stream through its rows and decide at once, holding one document's row at most.
What comes back per document that loses lines is a compressed bitmap of the lines to keep, not its text. Applying
the bitmaps is a join: texts and bitmaps meet in one shuffle unless Spark finds the bitmaps small.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .util import shared_folder, shuffle_partitions

_WHITE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_ROW = "h1 long, h2 long, doc {0}, row long, n_lines int, places binary"
#: Rows of an Arrow batch that a mapper returns.
BATCH = 20_000


def _keys(least: int):
    """Texts -> a row per distinct key of at least `least` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, rows, out = b.column(0), b.column(1), [[] for _ in range(6)]
            for i, text in enumerate(b.column(2)):
                places: dict[bytes, list[int]] = {}
                lines = (text.as_py() or "").encode().split(b"\n")
                for at, line in enumerate(lines):
                    if len(line) >= least:
                        key = line.strip(_WHITE).lower()
                        if len(key) >= least and len(key.translate(None, _CONTINUATION)) >= least:
                            places.setdefault(key, []).append(at)
                doc, row = docs[i].as_py(), rows[i].as_py()
                for key, at in places.items():
                    h = np.frombuffer(blake2b(key, digest_size=16).digest(), np.int64)
                    for col, x in zip(out, (h[0], h[1], doc, row, len(lines), np.array(at, np.int32).tobytes()), strict=True):
                        col.append(x)
                if len(out[0]) >= BATCH:
                    yield _batch(out, docs.type)
                    out = [[] for _ in range(6)]
            yield _batch(out, docs.type)

    return run


def _batch(cols: list[list], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), kind, pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h1", "h2", "doc", "row", "n_lines", "places"])


def _stream(batches: Iterator[pa.RecordBatch], kind: list[pa.DataType], wide: bool = True):
    """Rows in order; doc is None for a null id, which sorts last and counts as one document. Appends the ids' type to kind."""
    for b in batches:
        kind.append(b.column(2).type)
        yield from zip(*(c.to_pylist() for c in b.columns[: 6 if wide else 3]), strict=True)


def _borders(most: int):
    """A partition's first and last hash: documents there (up to `most`), and the outermost documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []
        first: list | None = None
        now: list | None = None  # [h1, h2, documents, first document, last document]
        for h1, h2, doc in _stream(batches, kind, wide=False):
            if now is None or (h1, h2) != (now[0], now[1]):
                if now is not None and first is None:
                    first = now
                now = [h1, h2, 1, doc, doc]
            elif doc != now[4]:
                now[2], now[4] = min(most, now[2] + 1), doc
        if now is None:
            return
        rows = [[TaskContext.get().partitionId(), first is None, *x] for x in (first or now, now)]
        names = ["part", "single", "h1", "h2", "docs", "first_doc", "last_doc"]
        kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), kind[0], kind[0])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def _carry(rows: list, most: int) -> dict[int, tuple]:
    """part -> (documents of its first hash before it, the last of them, documents of its last hash after it)."""
    parts: dict[int, list] = {}
    for r in rows:
        parts.setdefault(r["part"], []).append(r)
    order = sorted(parts)

    def link(own: dict, other: dict, docs: int, edge_own, edge_other) -> int:
        return min(most, docs + other["docs"] - (edge_own == edge_other))

    out: dict[int, list] = {p: [0, None, 0] for p in order}
    docs, key, last = 0, None, None
    for p in order:  # forwards: what came before
        first, end = parts[p]
        if key == (first["h1"], first["h2"]):
            out[p][:2] = docs, last
            if first["single"]:
                docs, last = link({}, end, docs, last, end["first_doc"]), end["last_doc"]
                continue
        docs, key, last = end["docs"], (end["h1"], end["h2"]), end["last_doc"]
    docs, key, head = 0, None, None
    for p in reversed(order):  # backwards: what is still to come, without the document that stands on the border
        first, end = parts[p]
        if key == (end["h1"], end["h2"]):
            out[p][2] = max(0, docs - (head == end["last_doc"]))
            if first["single"]:
                docs, head = link({}, first, docs, head, first["last_doc"]), first["first_doc"]
                continue
        docs, key, head = first["docs"], (first["h1"], first["h2"]), first["first_doc"]
    return {p: tuple(x) for p, x in out.items()}


def _verdicts(most: int, carry):
    """Sorted rows -> rows whose lines go: all but the first document of a hash that `most` documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last, after = carry.value.get(TaskContext.get().partitionId(), (0, None, 0))
        out: list[list] = [[] for _ in range(4)]
        kind: list[pa.DataType] = []

        def drop(r: tuple) -> None:
            for col, x in zip(out, (r[2], r[3], r[4], r[5]), strict=True):
                col.append(x)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (kind[0], pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc", "row", "n_lines", "places"])

        key, docs, doc, held, start = None, 0, None, [], True
        for r in _stream(batches, kind):
            if r[:2] != key:
                key, held = r[:2], []
                docs, doc = (before, last) if start and before else (0, object())
                start = False
            if docs == 0 or r[2] != doc:
                docs, doc = docs + 1, r[2]
            if docs == 1:
                continue
            if docs >= most:
                for x in held:
                    drop(x)
                held = []
                drop(r)
            else:
                held.append(r)
            if len(out[0]) >= BATCH:
                yield batch()
                out[:] = [[] for _ in range(4)]
        if docs + after >= most:
            for x in held:
                drop(x)
        if kind:
            yield batch()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, n = [], []
        for lines, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            bits = np.ones(lines, bool)
            for p in places:
                bits[np.frombuffer(p, np.int32)] = False
            n.append(int(lines - bits.sum()))
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int32()), pa.array(keep, pa.binary())], names=["doc", "row", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = 20, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, n_lines, n_dropped, keep) for each document that loses lines; see drop_common_lines.

    `row` is the hash of the text, which tells rows with one id apart; `keep` is a zlib-compressed bit per
    line. `most` must be 2 or more.
    """
    spark = docs.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))  # checkpoint() needs it in the context
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    keys = rows.mapInArrow(V.lean(_keys(least)), _ROW.format(kind))
    order = ("h1", "h2", F.col("doc").desc_nulls_last())
    # Ranges must be the same for both passes below, so the sorted rows are written once.
    ranged = keys.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "row").checkpoint()
    border = ranged.select("h1", "h2", "doc").mapInArrow(_borders(most), f"part int, single boolean, h1 long, h2 long, docs int, first_doc {kind}, last_doc {kind}")
    carry = spark.sparkContext.broadcast(_carry(border.collect(), most))  # two rows per partition
    gone = ranged.mapInArrow(V.lean(_verdicts(most, carry)), f"doc {kind}, row long, n_lines int, places binary")
    return gone.groupBy("doc", "row", "n_lines").agg(F.collect_set("places").alias("places")).mapInArrow(_bitmaps, f"doc {kind}, row long, n_lines int, n_dropped int, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, keep in zip(b.column(1), b.column(2), strict=True):
            lines = (text.as_py() or "").split("\n")
            if (bits := keep.as_py()) is not None:
                own = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
                left = [x for x, k in zip(lines, own, strict=True) if k]
            else:
                left = lines
            n_lines.append(len(lines)), n_dropped.append(len(lines) - len(left)), kept.append("\n".join(left))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def drop_common_lines(docs: DataFrame, least: int = 20, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) per input row.

    Texts are split at \\n; a null or empty text is one empty line. A line's key is the line without
    white space at its ends, A-Z folded. Keys of at least `least` code points that at least `most`
    documents hold lose all their lines except in the largest doc_id. Rows with one id are one document,
    and so are all rows with a null id, which is smaller than any other; repeated rows all stay as rows.
    Ids may have any type that has an order (strings: by code point).
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("r", F.xxhash64("text"))
    maps = keep_bitmaps(docs, least, most, id_col, text_col).select("doc", "row", "keep")
    joined = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("r") == F.col("row")), "left").select("doc_id", "text", "keep")
    return joined.mapInArrow(V.lean(_apply), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string")
