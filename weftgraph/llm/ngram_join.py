"""N-gram Jaccard join by vertical partitioning.

Texts that have the same n-gram set are one *entity* (a 64-bit digest of the set). The hash order of all
n-grams is cut into fragments. Each fragment finds the document frequency of its n-grams; only n-grams
that occur twice or more go on. With the global order (frequency, hash), two sets that reach the
threshold share an n-gram among the first n - ceil(t n) + 1 of each, so an entity whose unshared n-grams
fill that prefix has no partner. The few others meet in buckets by prefix n-gram. A bucket isn't
multiplied out: a hub (fewest unshared n-grams) is compared with the members of other components and the
components are merged, twice. Of buckets that still hold several components, those of a few members give
their distinct pairs, and larger ones are compared block by block, two blocks to a task, which returns
only links that merge components. The overlap of a pair is counted
in every fragment separately and the partial counts are summed.

A text travels to the fragments under a short name: its number among the texts that its task holds at
once. What one fragment gets of a text so costs a byte or two besides the n-grams, however many fragments
there are. Equal sets of different tasks meet in a directory by digest, dealt over the same tasks; one of
them stays, and an n-gram that only its copies hold is told from a shared one by the number of copies.

Hashes have 64 bits, of which the low 48 of an n-gram's travel: with the fragment's number about 52 at 12
partitions, and 48 and a quarter of the order in overlap counts. Equal hashes are taken as equal n-grams and equal digests as equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .components import components
from .util import free_name, quoted, shuffle_partitions, small, stash

#: N-grams that a task holds before they travel; one text may have more.
HELD = 1_000_000
#: An n-gram is hot from 1 / HOT of all texts on, and HOT_LEAST of them. A task reports what half that part of
#: its own texts hold, so at most half as much again can stay unseen and be counted in one fragment.
HOT, HOT_LEAST = 256, 10_000
#: Slices in which a task works through its fragment, to bound memory.
SLICES = 3
#: Fragments in which a pair's overlap is counted.
PARTS = 4
#: Rounds in which a bucket's hub is compared with its members; the rest is compared block by block.
HUB_ROUNDS = 2
#: Then buckets up to this size are compared pair by pair, each pair once for all its buckets.
FEW = 16
#: Members of a larger bucket's block, and n-grams of a fragment, when two blocks are compared.
BLOCK = 384
WIDTH = 4096


def _sets(texts: pa.Array, n: int, lower: bool) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(first row, sorted distinct n-gram hashes of each row, set digests) block by block."""
    for lo, _, buf, off in V.blocks(texts):
        starts, ends, first = V.word_bounds(buf, off)
        grams, base = V.windows(V.word_hashes(buf, starts, ends, lower), first, n, short=True)
        sets = [np.unique(grams[a:b]) for a, b in zip(base[:-1], base[1:], strict=True)]
        digest = np.array([int(V.mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
        size = np.array([len(s) for s in sets], np.uint64)
        yield lo, sets, V.mix(digest ^ (size * np.uint64(0xD6E8FEB86659FD93)))


def _frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that many of the held sets have, and how many do."""
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram, times = np.unique(np.concatenate(held), return_counts=True)
    many = times >= max(3, len(held) // (2 * HOT))
    return gram[many], times[many]


def _sizes(n: int, lower: bool):
    """Texts -> their columns with set size and digest; and (gram in ent, times) of n-grams that may be hot."""

    def frequent(held: list[np.ndarray], like: pa.RecordBatch) -> pa.RecordBatch:
        gram, times = _frequent(held)
        none = [pa.nulls(len(gram), c.type) for c in like.columns[:-1]]
        return pa.RecordBatch.from_arrays([*none, pa.nulls(len(gram), pa.int64()), pa.array(gram.view(np.int64)), pa.array(times, pa.int64())], names=[*like.schema.names[:-1], "n_shingles", "ent", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        load, b = 0, None
        for b in batches:
            size, ent = [], []
            for _, sets, digest in _sets(b.column(b.num_columns - 1), n, lower):
                size += [len(s) for s in sets]
                ent.append(digest.view(np.int64))
                for d, x in zip(digest.tolist(), sets, strict=True):
                    if d not in held and len(x):  # a copy adds nothing
                        held[d] = x
                        load += len(x)
                if load >= HELD:
                    yield frequent(list(held.values()), b)
                    held, load = {}, 0
            ents = np.concatenate(ent) if ent else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int64()), pa.array(ents), pa.nulls(len(size), pa.int64())], names=[*b.schema.names[:-1], "n_shingles", "ent", "times"])
        if held:
            yield frequent(list(held.values()), b)

    return run


def _six(grams: np.ndarray) -> bytes:
    """The low 48 bits of hashes; what a fragment leaves open of its hashes is told by fewer."""
    return np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte place by byte place, so that equal high bytes stand together and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(blob: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def _pack(name: np.ndarray, count: np.ndarray, grams: np.ndarray) -> bytes:
    """Ascending names (as differences), n-grams under each, and the n-grams' low 48 bits."""
    step = np.diff(name, prepend=np.uint64(0)).astype(np.uint64)
    return len(name).to_bytes(4, "little") + _planes(step) + _planes(count.astype(np.uint32)) + _six(grams)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Each n-gram's name, the n-grams, and what follows them."""
    k = int.from_bytes(blob[:4], "little")
    name = np.cumsum(_unplanes(blob[4:], np.uint64, k), dtype=np.uint64)
    count = _unplanes(blob[4 + 8 * k :], np.uint32, k)
    at = 4 + 12 * k
    end = at + 6 * int(count.sum(dtype=np.int64))
    return np.repeat(name, count), _eight(blob[at:end]), blob[end:]


def _runs(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a grouped array and their numbers."""
    start = np.flatnonzero(np.diff(name, prepend=~name[:1])) if len(name) else np.zeros(0, np.int64)
    return name[start], np.diff(start, append=len(name))


#: A text of a block in the directory: its number, set size and set digest.
_ENTRY = np.dtype([("ent", np.uint64), ("idx", np.uint32), ("n", np.uint32)])
#: The directory's answer: the one text that stands for its set, and how many do besides in other blocks.
_ANSWER = np.dtype([("name", np.uint64), ("ent", np.uint64), ("n", np.uint32), ("copies", np.uint32)])
#: A name is a block's number and a text's number in it; a block's is its task's and one of at most 2^20 in it.
_IDX_BITS, _TURN_BITS = np.uint64(24), 20


#: What a row between the texts and the fragments holds.
_GRAMS, _ENTRIES, _HOT = range(3)


def _segments(n: int, lower: bool, fragments: int, hot):
    """Texts -> (f, blk, what, blob): the part of every set that lies in fragment f, the directory's part f, hot n-grams.

    A hot n-gram is its place in the broadcast, sorted list.
    """

    def flush(held: list[tuple[list[np.ndarray], np.ndarray]], blk: int) -> Iterator[pa.RecordBatch]:
        digest = np.concatenate([d for _, d in held])
        _, keep = np.unique(digest, return_index=True)  # a copy within the block adds nothing
        sets = [x for xs, _ in held for x in xs]
        own = [sets[i] for i in keep if len(sets[i])]
        keep = [i for i in keep if len(sets[i])]
        if not keep:
            return
        size = np.array([len(x) for x in own], np.int64)
        grams = np.concatenate(own)
        names = np.repeat(np.arange(len(own), dtype=np.uint64), size)
        known = np.frombuffer(hot.value, np.uint64)
        if len(known):
            at = np.searchsorted(known, grams)
            is_hot = known[np.minimum(at, len(known) - 1)] == grams
            if is_hot.any():
                blob = _pack(*_runs(names[is_hot]), at[is_hot].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([blk % fragments], pa.int32()), pa.array([blk], pa.int64()), pa.array([_HOT], pa.int8()), pa.array([blob], pa.binary())], names=["f", "blk", "what", "blob"])
                grams, names = grams[~is_hot], names[~is_hot]
        f = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(f, kind="stable")
        cuts = np.searchsorted(f[order], np.arange(fragments + 1))
        grams, who = grams[order], names[order]
        del f, order, own, sets, names
        entries = np.zeros(len(keep), _ENTRY)
        entries["ent"], entries["idx"], entries["n"] = digest[keep], np.arange(len(keep)), size
        to = (V.mix(entries["ent"]) % np.uint64(fragments)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(fragments + 1))
        for lo in range(0, fragments, 256):
            fs, what, blobs = [], [], []
            for i in range(lo, min(fragments, lo + 256)):
                if cuts[i] < cuts[i + 1]:
                    own = slice(cuts[i], cuts[i + 1])
                    fs.append(i), what.append(_GRAMS), blobs.append(_pack(*_runs(who[own]), grams[own]))
                if ends[i] < ends[i + 1]:
                    fs.append(i), what.append(_ENTRIES), blobs.append(entries[order[ends[i] : ends[i + 1]]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fs, pa.int32()), pa.array([blk] * len(fs), pa.int64()), pa.array(what, pa.int8()), pa.array(blobs, pa.binary())], names=["f", "blk", "what", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, load, turn, first = [], 0, 0, TaskContext.get().partitionId() << _TURN_BITS
        for b in batches:
            for _, sets, digest in _sets(b.column(0), n, lower):
                held.append((sets, digest))
                load += sum(map(len, sets))
                if load >= HELD:
                    yield from flush(held, first + turn)
                    held, load, turn = [], 0, turn + 1
        if held:
            yield from flush(held, first + turn)

    return run


#: Stands for the fragment of hot n-grams; the bits that name a fragment are all set.
HOT_F = 2**16 - 1


def _rank(df: np.ndarray) -> np.ndarray:
    """8 steps an octave, in a byte: any order that is the same for all sets will do. 255 is for hot n-grams."""
    return np.minimum(8 * np.log2(df), 254).astype(np.uint8)


def _frequencies(groups: int):
    """Fragments -> (g, f, blob): n-grams that occur twice or more by text group, with the frequency's rank and low byte.

    Under f = -1: the directory's answers for a text group; under HOT_F: hot n-grams, the last in the order.
    """

    def shared(name: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        # An n-gram that occurs once needs no more work: most stop here.
        twice = np.zeros(len(g), bool)
        twice[1:] = g[1:] == g[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice]
        name, gram = name[order], gram[order]
        _, runs = _runs(gram)
        return name, gram, np.repeat(runs, runs)

    def parts(name: np.ndarray) -> Iterator[tuple[int, slice]]:
        cuts = np.searchsorted(_group(name, groups), np.arange(groups + 1))  # sorted by group
        for i in np.flatnonzero(np.diff(cuts)):
            yield int(i), slice(cuts[i], cuts[i + 1])

    def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["g", "f", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        entries: list[np.ndarray] = []
        for b in batches:
            for f, blk, what, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if what == _HOT:
                    name, gram, _ = _unpack(blob)
                    name = name + (np.uint64(blk) << _IDX_BITS)
                    order = np.lexsort((gram, name, _group(name, groups)))
                    name, gram = name[order], gram[order]
                    last = [(g, HOT_F, _pack(*_runs(name[own]), gram[own]) + b"\xff" * len(gram[own]) + bytes(len(gram[own]))) for g, own in parts(name)]
                    yield batch(last)
                elif what == _ENTRIES:
                    rows = np.frombuffer(blob, _ENTRY)
                    known = np.zeros(len(rows), _ANSWER)
                    known["ent"], known["n"], known["name"] = rows["ent"], rows["n"], (np.uint64(blk) << _IDX_BITS) + rows["idx"]
                    entries.append(known)
                else:
                    held.setdefault(f, []).append((blk, blob))
        if entries:
            known = np.concatenate(entries)
            del entries
            known = known[np.lexsort((known["name"], known["ent"]))]
            _, copies = _runs(known["ent"])
            known = known[np.cumsum(copies) - copies]  # of equal sets the smallest name stands for all
            known["copies"] = copies
            known = known[np.argsort(_group(known["name"], groups), kind="stable")]
            yield batch([(g, -1, known[own].tobytes()) for g, own in parts(known["name"])])
        for f in sorted(held):
            pieces = held.pop(f)
            names, grams = [], []
            while pieces:
                blk, blob = pieces.pop()
                name, gram, _ = _unpack(blob)
                names.append(name + (np.uint64(blk) << _IDX_BITS)), grams.append(gram)
            name, gram = np.concatenate(names), np.concatenate(grams)
            del names, grams
            which = V.mix(gram) % np.uint64(SLICES)
            found = [shared(name[own], gram[own]) for own in (which == i for i in range(SLICES))]
            del name, gram, which
            name, gram, df = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((gram, name, _group(name, groups)))
            name, gram, df = name[order], gram[order], df[order]
            rank, low = _rank(df), df.astype(np.uint8)
            yield batch([(g, f, _pack(*_runs(name[own]), gram[own]) + rank[own].tobytes() + low[own].tobytes()) for g, own in parts(name)])

    return run


def _group(name: np.ndarray, groups: int) -> np.ndarray:
    return V.mix(name) % np.uint64(groups)


def _prefixes(percent: int):
    """Text groups -> entities that may have a partner: their shared prefix n-grams and all shared ones.

    own counts the n-grams that no other entity has. Where more than 2,800 copies of a set make a frequency
    ambiguous, its n-grams count as shared, which only keeps an entity longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, ranks, lows, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)], [np.zeros(0, _ANSWER)]
        for b in batches:
            for f, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if f < 0:
                    known.append(np.frombuffer(blob, _ANSWER))
                    continue
                name, gram, more = _unpack(blob)
                names.append(name), grams.append(gram | np.uint64(f % 2**16) << np.uint64(48))
                ranks.append(np.frombuffer(more, np.uint8, len(gram))), lows.append(np.frombuffer(more, np.uint8, len(gram), len(gram)))
        name, gram, rank, low, known = (np.concatenate(x) for x in (names, grams, ranks, lows, known))
        del names, grams, ranks, lows
        known = known[np.argsort(known["name"])]
        at = np.searchsorted(known["name"], name)
        stays = known["name"][np.minimum(at, len(known) - 1)] == name if len(known) else np.zeros(len(name), bool)
        at = np.where(stays, at, 0)
        if len(known):  # n-grams that only the set's own copies hold
            copies = known["copies"][at]
            stays &= (copies == 1) | (copies > 2800) | (_rank(copies) != rank) | (copies.astype(np.uint8) != low)
        name, gram, rank, at = name[stays], gram[stays], rank[stays], at[stays]
        order = np.lexsort((gram, rank, name))
        name, gram, at = name[order], gram[order], at[order]
        _, runs = _runs(name)
        end = np.cumsum(runs)
        out = [[], [], [], [], []]
        for lo, hi, i in zip(end - runs, end, at[end - runs], strict=True):
            n, shared = int(known["n"][i]), int(hi - lo)
            need = -(-percent * n // 100)
            if shared < need:
                continue
            own = gram[lo:hi]
            for col, x in zip(out, (known["ent"][i].view(np.int64), n, n - shared, own[: shared - need + 1].view(np.int64).tolist(), np.sort(own).tobytes()), strict=True):
                col.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["ent", "n", "own", "prefix", "grams"])

    return run


def _cut_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ent, n, grams) -> (ent, n, part, grams): the set cut at fixed places of the order."""
    edges = np.array([(2**64 * i // PARTS) for i in range(1, PARTS)], np.uint64)
    for b in batches:
        ent, n, part, grams = [], [], [], []
        for e, k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            g = V.mix(np.frombuffer(blob, np.uint64))
            g.sort()
            for i, piece in enumerate(np.split(g, np.searchsorted(g, edges))):
                ent.append(e), n.append(k), part.append(i), grams.append(_six(piece))
        yield pa.RecordBatch.from_arrays([pa.array(ent, pa.int64()), pa.array(n, pa.int32()), pa.array(part, pa.int32()), pa.array(grams, pa.binary())], names=["ent", "n", "part", "grams"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets' fragment -> the partial overlap."""
    for b in batches:
        both = [len(np.intersect1d(_eight(x), _eight(y), assume_unique=True)) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "both"])


def _verify(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """Pairs whose Jaccard similarity reaches the threshold: partial overlaps by fragment, summed."""
    left = cut.select(F.col("ent").alias("a"), F.col("n").alias("na"), "part", F.col("grams").alias("ga"))
    right = cut.select(F.col("ent").alias("b"), F.col("n").alias("nb"), F.col("part").alias("part2"), F.col("grams").alias("gb"))
    joined = pairs.join(left, "a").join(right, (pairs["b"] == right["b"]) & (F.col("part") == F.col("part2"))).select(pairs["a"], pairs["b"], "na", "nb", "ga", "gb")
    part = joined.mapInArrow(V.lean(_overlaps), "a long, b long, na int, nb int, both long")
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return total.where(F.col("both") * 100 >= percent * (F.col("na").cast("long") + F.col("nb") - F.col("both"))).select("a", "b")


def _block_links(percent: int):
    """All rows of two blocks of a bucket -> links that join components, each at most once."""

    def run(table: pa.Table) -> pa.Table:
        ent, comp = table["ent"].to_pylist(), table["comp"].to_pylist()
        size = np.array(table["n"].to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
        grams, ids = np.unique(np.concatenate(sets), return_inverse=True)
        who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(ids, kind="stable")
        ids, who = ids[order], who[order]
        both = np.zeros((len(sets), len(sets)), np.float32)  # exact: counts stay far below 2^24
        for lo in range(0, len(grams), WIDTH):  # fragment by fragment
            i, j = np.searchsorted(ids, (lo, lo + WIDTH))
            part = np.zeros((len(sets), min(WIDTH, len(grams) - lo)), np.float32)
            part[who[i:j], ids[i:j] - lo] = 1
            both += part @ part.T
        shared = both.astype(np.int64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        out: list[tuple[int, int]] = []
        for i, j in np.argwhere(np.triu(shared * 100 >= percent * (size[:, None] + size[None, :] - shared), 1)):
            x, y = root(comp[i]), root(comp[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((ent[i], ent[j]))
        return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})

    return run


def links(entities: DataFrame, percent: int) -> DataFrame:
    """Links enough to connect what the threshold connects, among (ent, n, own, prefix, grams) rows."""
    cut = stash(entities.select("ent", "n", "grams").mapInArrow(V.lean(_cut_sets), "ent long, n int, part int, grams binary"), "cut")
    buckets = entities.select(F.explode("prefix").alias("gram"), "ent", "n", "own").withColumn("comp", F.col("ent"))
    found: DataFrame | None = None
    for _ in range(HUB_ROUNDS):
        buckets = stash(_open_buckets(buckets), "buckets")
        near = _may_link(percent, "hub.n", "hub.own", "hub.comp")
        pairs = buckets.where(near).select(F.least("ent", "hub.ent").alias("a"), F.greatest("ent", "hub.ent").alias("b")).distinct()
        new = stash(_verify(pairs, cut, percent), "found")
        found = new if found is None else found.unionByName(new)
        roots = components(found)
        buckets = buckets.where(F.col("ent") != F.col("hub.ent")).drop("size", "hub", "comp").join(roots, F.col("ent") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "ent")).drop("node", "root")
    rest = stash(_open_buckets(buckets).drop("hub"), "rest")
    few = rest.where(F.col("size") <= FEW)
    mate = few.select(F.col("gram").alias("k"), F.col("ent").alias("ent2"), F.col("n").alias("n2"), F.col("own").alias("own2"), F.col("comp").alias("comp2"))
    near = _may_link(percent, "n2", "own2", "comp2")
    pairs = few.join(mate, (F.col("gram") == F.col("k")) & (F.col("ent") < F.col("ent2"))).where(near).select(F.col("ent").alias("a"), F.col("ent2").alias("b")).distinct()
    found = found.unionByName(_verify(pairs, cut, percent))
    rest = rest.where(F.col("size") > FEW).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("ent"), F.col("blocks")).cast("int"))
    rest = rest.join(entities.select(F.col("ent").alias("k"), "grams"), F.col("ent") == F.col("k"))
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("gram", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "ent", "comp", "n", "grams")
    return found.unionByName(rest.groupBy("gram", "x", "y").applyInArrow(_block_links(percent), "a long, b long"))


def _may_link(percent: int, n2: str, own2: str, comp2: str):
    """Another component, and enough n-grams that are shared at all to reach the threshold."""
    most = F.least(F.col("n") - F.col("own"), F.col(n2) - F.col(own2)).cast("long")
    return (most * (100 + percent) >= (F.col("n") + F.col(n2)) * percent) & (F.col("comp") != F.col(comp2))


def _open_buckets(buckets: DataFrame) -> DataFrame:
    """Buckets that hold more than one component, with their size and hub; of those with the same members, one."""
    members = F.sum(F.xxhash64("ent").cast("decimal(38,0)")).alias("members")
    per = buckets.groupBy(F.col("gram").alias("k")).agg(members, F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct("own", "ent", "n", "comp")).alias("hub")).where("c0 <> c1")
    per = per.groupBy("members", "size").agg(F.min("k").alias("k"), F.first("hub").alias("hub"))
    return buckets.join(per.select("k", "size", "hub"), F.col("gram") == F.col("k")).drop("k")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """Near-duplicate classes: one row (doc_id, n_shingles, component_id) per input row.

    `with_row` adds row, the hash of the text, which tells rows with one id apart, and root, which names the
    class whatever its ids are (null for an empty set).

    A row's set holds its distinct n-word shingles (words are runs without white space; `lower` folds
    A-Z; fewer words than n: the whole sequence is one). Rows are linked when 100 * |intersection| >=
    percent * |union|; component_id is the smallest id that links reach. A null, empty or blank text has
    an empty set (n_shingles 0), is linked with nothing, and is its own component. Repeated rows stay,
    one output row each. Ids may have any type that has an order; rows with a null id can link others, and
    their component_id is the smallest id that isn't null, if any. Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    row = [F.xxhash64(text_col).alias("row")] if with_row else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *row, F.col(text_col).cast("string").alias("text"))
    first_pass = stash(rows.mapInArrow(V.lean(_sizes(n, lower)), f"doc_id {kind}, {'row long, ' * with_row}n_shingles long, ent long, times long"), "sizes")
    sizes = first_pass.where("times is null").drop("times")
    least = max(HOT_LEAST, sizes.where("n_shingles > 0").count() // HOT)
    # At most HOT times a text's mean number of n-grams: each has the places of a HOT-th of all texts.
    hot = first_pass.where("times is not null").groupBy("ent").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("ent")
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hot.collect()], np.int64).view(np.uint64)).tobytes())
    real = sizes.where("n_shingles > 0")
    parts = shuffle_partitions(spark)
    segments = rows.select("text").mapInArrow(V.lean(_segments(n, lower, parts, hot)), "f int, blk long, what byte, blob binary").repartitionById(parts, "f")
    shared = segments.mapInArrow(V.lean(_frequencies(parts)), "g int, f int, blob binary").repartitionById(parts, "g")
    entities = stash(shared.mapInArrow(V.lean(_prefixes(percent)), "ent long, n int, own int, prefix array<long>, grams binary"), "entities")
    roots = stash(components(links(entities, percent)), "roots")
    first = real.groupBy("ent").agg(F.min("doc_id").alias("first"))
    tagged = first.join(roots, F.col("ent") == F.col("node"), "left").withColumn("root", F.coalesce("root", "ent"))
    lowest = tagged.where("node is not null").groupBy(F.col("root").alias("r")).agg(F.min("first").alias("low"))
    classes = stash(tagged.join(lowest, F.col("root") == F.col("r"), "left").select(F.col("ent").alias("e"), F.coalesce("low", "first").alias("component_id"), *["root"] * with_row), "classes")
    out = sizes.join(classes, (F.col("ent") == F.col("e")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", *["row", "root"] * with_row, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, with all their columns, without near duplicates: one row of each class stays.

    It is the row of the smallest id; of rows that share it (or of a class without ids) the one of the
    smallest text hash, and of equal texts the one that comes first by its other columns. Texts without
    words are in no class and stay. Up to BROADCAST_ROWS rows that go, their keys are broadcast and no text
    moves; above that the texts are shuffled once.
    """
    classes = stash(jaccard_components(docs, n, percent, True, id_col, text_col, with_row=True).where("n_shingles > 0"), "rows")
    g, r = free_name(docs, "gone_id"), free_name(docs, "gone_row")
    heads = classes.where("doc_id <=> component_id")
    several = stash(heads.groupBy("root").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1"), "several")
    shared = heads.join(several, "root")
    keys = [F.col("doc_id").alias(g), F.col("row").alias(r)]
    gone = classes.where("not (doc_id <=> component_id)").select(*keys).unionByName(shared.select(*keys)).distinct()
    once = stash(shared.where("row = first").select(*keys).distinct(), "once")
    same = quoted(id_col).eqNullSafe(F.col(g)) & (F.xxhash64(quoted(text_col)) == F.col(r))
    out = docs.join(small(stash(gone, "gone")), same, "left_anti")
    if not once.isEmpty():  # ids that repeat: of equal texts one row stays
        rest = [c for c in docs.columns if c not in (id_col, text_col)]
        picked = docs.join(small(once), same, "left_semi")
        first = picked.groupBy(quoted(id_col), quoted(text_col)).agg(F.min(F.struct(*map(quoted, rest), F.lit(0))).alias("x")) if rest else picked.distinct()
        out = out.unionByName(first.select(quoted(id_col), quoted(text_col), *(F.col("x")[c].alias(c) for c in rest)).select(*map(quoted, docs.columns)))
    return out
