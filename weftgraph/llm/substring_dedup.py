"""Substring dedup with super-k-mer partitioning.

The minimiser of a window is the smallest hash of the M-word grams in it. Consecutive windows with one
minimiser form a super-k-mer: one packed string of word codes that goes to the minimiser's bucket, where
its windows are sorted with all others of that bucket and counted. Equal windows have equal minimisers,
so no count is split. Most minimisers occur once in the corpus and can't have a repeated window: a first
light pass counts them and its result, a bitmap of fixed size, keeps their super-k-mers at home. Equal
super-k-mers of a block of texts travel once with their number, so a passage that many texts share
doesn't fill its bucket; the bucket's verdict comes back by the digest of the packed string.

A passage that a large part of all texts holds still has as many surroundings as texts, all with its
minimisers. The first pass finds these: super-k-mers of the most frequent minimisers travel as 128-bit
digests of their windows, counted in the task that reads the texts and dealt over all buckets.

A word's code is a 64-bit hash; windows are equal if all their codes (there: their digests) are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .util import shuffle_partitions, stash

#: Words of a minimiser gram.
M = 8
#: log2 of the bitmap's bits: 16 MB, whatever the input. A fuller bitmap only keeps less at home.
BITMAP_LOG2 = 27
#: A minimiser of more than HOT_LEAST places is dealt over all buckets if it is among the HOT_MOST most
#: frequent of its range; there is a range per shuffle partition, so that bounds their list.
HOT_LEAST, HOT_MOST = 2000, 64
#: Digests of windows that a task holds to count them before they travel.
HELD = 500_000
#: Word codes that a bucket task works on at once; one minimiser may have more.
BUCKET_WORDS = 2_000_000
_R = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_R_INV = tuple(np.uint64(pow(int(r), -1, 2**64)) for r in _R)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    have, out = 1, x
    while 2 * have <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (n - have)], out[n - have :]) if n > have else out


def _grams(words: np.ndarray) -> np.ndarray:
    n = len(words) - M + 1
    out = np.zeros(n, np.uint64)
    for j in range(M):
        out += words[j : n + j] * V._COEF[j]
    return V.mix(out)


def _super_kmers(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, minimiser) of every super-k-mer."""
    count = np.diff(first)
    n = len(words)
    if n < k or not (count >= k).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    low = _sliding_min(_grams(words), k - M + 1)
    text = np.repeat(np.arange(len(count)), count)[: len(low)]
    ok = np.arange(len(low)) + k <= np.repeat(first[1:], count)[: len(low)]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new & ok)
    total = np.concatenate([[0], np.cumsum(ok)])
    end = np.append(np.flatnonzero(new), len(low))
    end = end[np.searchsorted(end, begin, side="right")]
    return text[begin], begin, total[end] - total[begin], low[begin]


def _minimiser_places(words: np.ndarray, k: int) -> np.ndarray:
    """The hash at every place that is some window's minimiser; a text can repeat one within a super-k-mer."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    grams, n = _grams(words), k - M + 1
    low = np.zeros(len(grams) + n - 1, np.uint64)
    low[n - 1 : len(grams)] = _sliding_min(grams, n)
    return grams[grams == ~_sliding_min(~low, n)]


def _digests(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word run."""
    out = []
    for r, inverse in zip(_R, _R_INV, strict=True):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * V._power(r, len(words)), out=total[1:])
        out.append(V.mix((total[begin + size] - total[begin]) * V._power(inverse, len(words) + 1)[begin] + size.astype(np.uint64)))
    return out[0], out[1]


def _each(texts: pa.Array):
    """(first row, first word of each text, word codes) block by block."""
    for lo, _, buf, off in V.blocks(texts):
        starts, ends, first = V.word_bounds(buf, off)
        yield lo, first, V.word_hashes(buf, starts, ends, lower=False)


def _minimisers(k: int, parts: int):
    """Texts -> (p, blob, more): minimisers of a block by range, listed up to twice; more holds (value, further places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([2**64 * i // parts for i in range(1, parts)], np.uint64)
        for b in batches:
            for _, _, words in _each(b.column(0)):
                value, count = np.unique(_minimiser_places(words, k), return_counts=True)
                more = np.stack([value, (count - 2).astype(np.uint64)], 1)[count > 2]
                value = np.concatenate([value, value[count > 1]])
                value.sort()
                cuts, more_cuts = ([0, *np.searchsorted(x, edges), len(x)] for x in (value, more[:, 0]))
                rows = [(i, value[cuts[i] : cuts[i + 1]].tobytes(), more[more_cuts[i] : more_cuts[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(cuts))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], x) for j, x in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["p", "blob", "more"])

    return run


def _repeated_slots(least: int, most: int):
    """Minimisers of some ranges -> bytes of the bitmap that have bits, and the values that are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.uint64)]
        for b in batches:
            held += [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            more += [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in b.column(2).to_pylist()]
        value = np.concatenate(held)
        value.sort()
        start = np.flatnonzero(np.diff(value, prepend=~value[:1]))
        places = np.diff(start, append=len(value))
        start, places = start[places > 1], places[places > 1]
        value, extra = value[start], np.concatenate(more)
        slots = np.unique(value >> np.uint64(64 - BITMAP_LOG2)).astype(np.uint32)
        np.add.at(places, np.searchsorted(value, extra[:, 0]), extra[:, 1].astype(np.int64))
        many = np.flatnonzero(places > least)
        hot = value[many[np.argsort(-places[many], kind="stable")[:most]]]
        yield pa.RecordBatch.from_arrays([pa.array([slots.tobytes()], pa.binary()), pa.array([hot.tobytes()], pa.binary())], names=["slots", "hot"])

    return run


def _known(texts: DataFrame, k: int) -> tuple[bytes, bytes]:
    """(bitmap, hot minimisers). A bit per slot of the minimiser range: some minimiser there occurs twice or more.

    Slots come to the driver one partition at a time; at most 2^BITMAP_LOG2 of them, whatever the input,
    and HOT_MOST values with them.
    """
    parts = shuffle_partitions(texts.sparkSession)
    rows = texts.mapInArrow(_minimisers(k, parts), "p int, blob binary, more binary").repartition(parts, "p").mapInArrow(_repeated_slots(HOT_LEAST, HOT_MOST), "slots binary, hot binary")
    bits, hot = np.zeros(2**BITMAP_LOG2 // 8, np.uint8), [np.zeros(0, np.uint64)]
    for r in rows.toLocalIterator(prefetchPartitions=True):
        slots = np.frombuffer(r["slots"], np.uint32)
        np.bitwise_or.at(bits, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
        hot.append(np.frombuffer(r["hot"], np.uint64))
    return bits.tobytes(), np.sort(np.concatenate(hot)).tobytes()


def _sent(words: np.ndarray, first: np.ndarray, k: int, known) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, minimiser, hot) of super-k-mers that may hold a repeated window.

    One of a hot minimiser is cut into its windows.
    """
    text, begin, n, low = _super_kmers(words, first, k)
    bits, values = (np.frombuffer(x, t) for x, t in zip(known.value, (np.uint8, np.uint64), strict=True))
    slot = (low >> np.uint64(64 - BITMAP_LOG2)).astype(np.int64)
    keep = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    text, begin, n, low = text[keep], begin[keep], n[keep], low[keep]
    hot = np.isin(low, values)
    times = np.where(hot, n, 1)
    at = np.repeat(np.arange(len(n)), times)
    step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    return text[at], begin[at] + step, np.where(hot, 1, n)[at], low[at], hot[at]


def _tally(d1: np.ndarray, d2: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal digests once, with the sum of their times."""
    order = np.lexsort((d2, d1))
    d1, d2 = d1[order], d2[order]
    new = np.ones(len(order), bool)
    new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    total = np.concatenate([[0], np.cumsum(times[order])])
    at = np.flatnonzero(new)
    return d1[at], d2[at], np.diff(total[np.append(at, len(order))])


def _packed(k: int, known):
    """Texts -> super-k-mers that may hold a repeated window, each once per block, with their number.

    Windows of hot minimisers have no codes, their first digest in the minimiser's place, and are counted
    over all blocks of the task as far as HELD allows.
    """

    def batch(mini: np.ndarray, d1: np.ndarray, d2: np.ndarray, times: np.ndarray, codes: list[bytes]) -> pa.RecordBatch:
        arrays = [*(pa.array(x.view(np.int64)) for x in (mini, d1, d2)), pa.array(times, pa.int64()), pa.array(codes, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["minimiser", "d1", "d2", "times", "codes"])

    def counted(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return _tally(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for _, first, words in _each(b.column(0)):
                _, begin, n, low, hot = _sent(words, first, k, known)
                size = n + k - 1
                d1, d2 = _digests(words, begin, size)
                if hot.any():
                    held.append((d1[hot], d2[hot], np.ones(int(hot.sum()), np.int64)))
                    if sum(len(x[0]) for x in held) > 2 * HELD:
                        held = [counted(held)]
                    if len(held[0][0]) > HELD:
                        yield batch(held[0][0], *held[0], [b""] * len(held[0][0]))
                        held = held[1:]
                order = np.flatnonzero(~hot)
                order = order[np.lexsort((d2[order], d1[order]))]
                new = np.ones(len(order), bool)
                new[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
                at = np.flatnonzero(new)
                own = order[at]
                codes = [words[i : i + s].tobytes() for i, s in zip(begin[own], size[own], strict=True)]
                yield batch(low[own], d1[own], d2[own], np.diff(at, append=len(order)), codes)
        if held:
            d1, d2, times = counted(held)
            for i in range(0, len(d1), HELD // 10):
                cut = slice(i, i + HELD // 10)
                yield batch(d1[cut], d1[cut], d2[cut], times[cut], [b""] * len(d1[cut]))

    return run


def _count_windows(k: int, mini: np.ndarray, times: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Marks the windows that occur twice or more; one mark per window, super-k-mer by super-k-mer."""
    n = size - k + 1
    base = np.concatenate([[0], np.cumsum(n)])
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    at = np.arange(base[-1]) - np.repeat(base[:-1] - begin, n)
    code = np.zeros(len(at), np.uint64)
    for j in range(k):
        code += words[at + j] * V._COEF[j]
    code = V.mix(code ^ V.mix(np.repeat(mini, n)))
    weight = np.repeat(times, n)
    order = np.argsort(code, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = code[order][1:] == code[order][:-1]
    maybe = np.flatnonzero(same)
    for j in range(k):  # equal hashes: compare the words themselves
        wrong = words[at[order[maybe]] + j] != words[at[order[maybe - 1]] + j]
        if wrong.any():
            rows = np.ascontiguousarray(np.stack([words[at + i] for i in range(k)], 1)).view(np.dtype((np.void, 8 * k))).ravel()
            _, inverse = np.unique(rows, return_inverse=True)
            return np.bincount(inverse, weight)[inverse] > 1
    group = np.cumsum(~same) - 1
    total = np.bincount(group, weight[order])
    out = np.empty(len(order), bool)
    out[order] = total[group] > 1
    return out


def _ranges(marks: np.ndarray, k: int) -> bytes:
    """Word ranges [from, to) that the marked windows cover, as int32 pairs."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + k - 1
    return np.stack([lo, hi], 1).astype(np.int32).tobytes()


def _buckets(k: int):
    """Packed super-k-mers, sorted by minimiser -> (d1, d2, ranges) for those with a repeated window.

    Rows are held until whole minimisers of BUCKET_WORDS codes are there, whatever the partition's size.
    """

    def digests(t: pa.Table) -> pa.RecordBatch:
        d1, d2, times = _tally(*(t[c].to_numpy() for c in ("d1", "d2", "times")))
        again = times > 1
        whole = np.array([0, k], np.int32).tobytes()
        return pa.RecordBatch.from_arrays([pa.array(d1[again]), pa.array(d2[again]), pa.array([whole] * int(again.sum()), pa.binary())], names=["m1", "m2", "ranges"])

    def windows(t: pa.Table) -> pa.RecordBatch:
        mini = t["minimiser"].to_numpy().view(np.uint64)
        d1, d2, times = (t[c].to_numpy() for c in ("d1", "d2", "times"))
        codes = t["codes"].to_pylist()
        size = np.array([len(x) // 8 for x in codes], np.int64)
        words = np.frombuffer(b"".join(codes), np.uint64)
        del codes
        marks = _count_windows(k, mini, times, words, size)
        base = np.concatenate([[0], np.cumsum(size - k + 1)])
        any_mark = np.concatenate([[0], np.cumsum(marks)])
        hit = np.flatnonzero(any_mark[base[1:]] > any_mark[base[:-1]])
        _, one = np.unique(np.stack([d1[hit], d2[hit]], 1), axis=0, return_index=True)
        hit = hit[one]
        return pa.RecordBatch.from_arrays([pa.array(d1[hit]), pa.array(d2[hit]), pa.array([_ranges(marks[base[i] : base[i + 1]], k) for i in hit], pa.binary())], names=["m1", "m2", "ranges"])

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole minimisers: those of digests alone and those of codes."""
        blank = pa.compute.equal(pa.compute.binary_length(t["codes"]), 0)
        for part, work in ((t.filter(blank), digests), (t.filter(pa.compute.invert(blank)), windows)):
            if part.num_rows:
                yield work(part.combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        load = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            load += b.num_rows + b.column(4).nbytes // 8
            mini = b.column(0).to_numpy()
            if load >= BUCKET_WORDS and mini[0] != mini[-1]:  # all but the last minimiser, which may go on
                cut = int(np.searchsorted(mini, mini[-1]))
                yield from done(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                held = [b.slice(cut)]
                load = held[0].num_rows + int(pa.compute.sum(pa.compute.binary_length(held[0].column(4))).as_py() or 0) // 8
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def _references(k: int, known):
    """Rows -> where each super-k-mer or window that was sent stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, first, words in _each(b.column(2)):
                text, begin, n, _, _ = _sent(words, first, k, known)
                d1, d2 = _digests(words, begin, n + k - 1)
                take = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array((begin - first[text]).astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=["r1", "r2", "at", "d1", "d2"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, hits) -> kept words joined by one space, and counts."""
    for b in batches:
        kept, n_words, n_removed = [], [], []
        hits = b.column(2)
        for lo, hi, buf, off in V.blocks(b.column(1)):
            starts, ends, first = V.word_bounds(buf, off)
            for i in range(hi - lo):
                a, z = first[i], first[i + 1]
                drop = np.zeros(z - a + 1, np.int32)
                for hit in hits[lo + i].as_py() or ():
                    r = np.frombuffer(hit["ranges"], np.int32).reshape(-1, 2) + hit["at"]
                    np.add.at(drop, r[:, 0], 1)
                    np.add.at(drop, r[:, 1], -1)
                keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                n_words.append(int(z - a))
                n_removed.append(int(z - a - len(keep)))
                own = buf[off[i] : off[i + 1]].tobytes()
                if len(keep) == z - a:
                    kept.append(b" ".join(own.split()))
                else:
                    kept.append(b" ".join(own[s:e] for s, e in zip(starts[a + keep] - off[i], ends[a + keep] - off[i], strict=True)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per input row: words in repeated k-word windows are gone.

    A window is repeated if its word sequence starts at another place too, in any row or the same one;
    all are judged on the input. Words are runs without white space, unchanged; kept words are joined by
    one space. Null, empty, blank and short texts (fewer than k words) keep all they have. Repeated rows
    make each other's windows repeated and all stay as rows. Ids may be null or repeat: rows are told
    apart by id and text. Extra columns are ignored; an empty table gives an empty result. k must be
    above M.
    """
    if k <= M:
        raise ValueError(f"k must be above {M}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = shuffle_partitions(spark)
    known = spark.sparkContext.broadcast(_known(rows.select("text"), k))  # 16 MB, and 512 bytes a partition
    packed = rows.select("text").mapInArrow(V.lean(_packed(k, known)), "minimiser long, d1 long, d2 long, times long, codes binary")
    repeated = stash(packed.repartition(parts, "minimiser").sortWithinPartitions("minimiser").mapInArrow(V.lean(_buckets(k)), "m1 long, m2 long, ranges binary"), "repeated")
    keyed = rows.withColumn("r1", F.xxhash64("doc_id", "text")).withColumn("r2", F.hash("text", "doc_id"))
    refs = keyed.select("r1", "r2", "text").mapInArrow(V.lean(_references(k, known)), "r1 long, r2 int, at int, d1 long, d2 long")
    hits = refs.join(repeated, (F.col("d1") == F.col("m1")) & (F.col("d2") == F.col("m2"))).groupBy(F.col("r1").alias("h1"), F.col("r2").alias("h2")).agg(F.collect_set(F.struct("at", "ranges")).alias("hits"))
    joined = keyed.join(hits, (F.col("r1") == F.col("h1")) & (F.col("r2") == F.col("h2")), "left").select("doc_id", "text", "hits")
    id_type = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(V.lean(_remove), f"doc_id {id_type}, n_words long, n_removed long, kept_text string")
