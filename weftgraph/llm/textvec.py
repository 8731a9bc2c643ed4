"""Words and word hashes of many texts at once, on the UTF-8 bytes, with numpy.

A word is a run of bytes other than space and \\t..\\r. Texts are worked on in blocks of a few MB, so that
memory is bounded by the block and the longest text. A word's 64-bit hash is a polynomial over random
byte values; two words of one corpus collide with a probability of about vocabulary^2 / 2^56.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17 | 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BLOCK_BYTES:  # one huge text must not leave its arrays behind
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word byte ranges, and per text the index of its first word (n + 1 values)."""
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    part = (_BYTE_LOWER if lower else _BYTE)[buf]
    part *= _power(_BASE, len(buf))
    np.cumsum(part, out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(buf) + 1)[starts])


def windows(hashes: np.ndarray, first: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(window hashes, first window of each text): n consecutive words of one text.

    short: a text with words, but fewer than n, has one window of all its words.
    """
    count = np.diff(first)
    per = np.maximum(count - n + 1, 0)
    if short:
        per = np.where((count > 0) & (count < n), 1, per)
    base = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=base[1:])
    at = np.arange(base[-1]) - np.repeat(base[:-1] - first[:-1], per)
    size = np.repeat(np.minimum(count, n), per)
    out = size.astype(np.uint64) * _COEF[-1]
    last = len(hashes) - 1
    for j in range(n):
        term = hashes[np.minimum(at + j, last)] * _COEF[j] if len(hashes) else np.zeros(0, np.uint64)
        out += np.where(size > j, term, np.uint64(0)) if short else term
    return mix(out), base


def give_back() -> None:
    """Returns freed memory, and the tables of powers, to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
        trim(0)


def lean(run: Callable) -> Callable:
    """A mapper that gives its memory back when its task ends; Python workers outlive their tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
