"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by (hash of the text, id), so equal texts are neighbours. A sample in which a record's
chance is proportional to its size gives the quantiles of that order by bytes; they cut it into ranges of
about equal size, and ranges that turn out too full are cut again by a denser sample of their own. The
ranges' exact sums then place every record: a range knows what precedes it, and inside it a running sum
does the rest. Shard borders fall between records, so shards differ by a record's size at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .util import quoted, shuffle_partitions, stash

#: Ranges: so many per shuffle partition, within these limits. The driver holds SAMPLE keys for each.
PER_PARTITION, LEAST_RANGES, MOST_RANGES, SAMPLE = 4, 64, 65_536, 24
#: A range is too full above so many times the mean, and is cut again up to ROUNDS times.
FULL, ROUNDS = 2.0, 3
_SPAN = 2**53


def _keys_range(splits: list[tuple[int, int]], k1: str, k2: str) -> Column:
    """Number of splitters below the key (k1, k2), by binary search in two constant arrays."""
    if not splits:
        return F.lit(0)
    steps, s = [], 1 << (len(splits).bit_length() - 1)
    while s:
        steps.append(s)
        s >>= 1

    def const(i: int) -> str:
        return "array(" + ", ".join(f"{x[i]}L" if x[i] > -(2**63) else f"({x[i] + 1}L - 1L)" for x in splits) + ")"

    place = "a + s - 1"
    below = f"get({const(0)}, {place}) < {k1} or (get({const(0)}, {place}) = {k1} and get({const(1)}, {place}) < {k2})"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (a, s) -> if(a + s <= {len(splits)} and ({below}), a + s, a))")


def _quantiles(keys: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if len(keys) >= n else sorted(set(keys))


def _sample(rows: DataFrame, rate: float | Column, seed: int) -> list[tuple[int, int]]:
    """Keys of a size-weighted sample: a record is drawn with probability min(1, size * rate)."""
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k1", "k2"), 11) / _SPAN
    return [(r["k1"], r["k2"]) for r in rows.where(chance < F.col("size") * rate).select("k1", "k2").collect()]


def _splitters(narrow: DataFrame, total: int, seed: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Splitters, and bytes and records of each range between them."""
    want = min(MOST_RANGES, max(LEAST_RANGES, PER_PARTITION * shuffle_partitions(narrow.sparkSession)))
    splits = _quantiles(_sample(narrow, want * SAMPLE / total, seed), want)
    for turn in range(ROUNDS + 1):
        ranged = narrow.withColumn("range", _keys_range(splits, "k1", "k2"))
        held = {r["range"]: (int(r["b"]), int(r["n"])) for r in ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        full = {k: b / (total / want) for k, (b, _) in held.items() if b > FULL * total / want}
        if not full or turn == ROUNDS:
            return splits, held
        keys = _sample(ranged.where(F.col("range").isin(list(full))), want * SAMPLE / total, seed + turn + 1)
        edges = [None, *splits, None]
        more: set[tuple[int, int]] = set()
        for k, times in full.items():
            own = [x for x in keys if (edges[k] is None or x > edges[k]) and (edges[k + 1] is None or x <= edges[k + 1])]
            more.update(_quantiles(own, int(times) + 1))
        if not more - set(splits):  # one key fills the range: records that can't be told apart
            return splits, held
        splits = sorted({*splits, *more})
    return splits, held


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input rows and columns plus shard_size, shard_crc32, shard, slot: bytes per shard are near equal.

    A record's size is the UTF-8 bytes of its text plus 1 (null: 0 bytes; its CRC is 0, as of an empty
    text). slot counts a shard's records from 0 without gaps. Equal texts are neighbours, so a group of
    equal texts is in one shard but for those that a border falls into: `shards` - 1 groups at most, and a
    group above a shard's bytes has to be among them. Repeated rows are placed each for itself, in either
    order; null ids come first among equal texts. Input columns named like the added ones are replaced, all
    other names are left alone. An empty table gives an empty result. Reruns agree.

    Records move once, to their range, which is a quarter of a shuffle partition up to MOST_RANGES ranges,
    and are sorted there with their columns, as they lie in the shard.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    key = quoted(id_col)
    k2 = F.coalesce(F.xxhash64(key), F.lit(0)) if docs.schema[id_col].dataType.typeName() == "string" else F.coalesce(key.cast("long"), F.lit(-(2**63)))
    own = [c for c in docs.columns if c not in ("shard_size", "shard_crc32", "shard", "slot")]
    # Input columns get numbers for names on the way, so none can have a name that is used here.
    carried = [quoted(c).alias(f"c{i}") for i, c in enumerate(own)]
    keyed = docs.select(*carried, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("k1"), k2.alias("k2"))
    narrow = stash(keyed.select("k1", "k2", "size"), "keys")
    total = int(narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    splits, held = _splitters(narrow, total, seed) if total else ([], {})
    start_b = start_n = 0
    starts, first, border = [(0, 0)] * (len(splits) + 1), {}, []

    def at(middle2: int) -> int:
        return min(shards - 1, middle2 * shards // (2 * max(1, total)))

    for k in sorted(held):
        b, n = held[k]
        starts[k] = (start_b, start_n)
        lo, hi = at(2 * start_b), at(2 * (start_b + b))
        if lo == hi:
            first[lo] = min(first.get(lo, start_n), start_n)
        else:
            border.append(k)
        start_b, start_n = start_b + b, start_n + n

    def placed(rows: DataFrame) -> DataFrame:
        """Running sums inside ranges; what stands before a range is looked up in constant arrays."""
        inside = W.partitionBy("range").orderBy("k1", "k2", "size")
        before_b, before_n = (F.expr(f"get(array({', '.join(f'{x[i]}L' for x in starts)}), range)") for i in (0, 1))
        rows = rows.withColumn("n", before_n + F.row_number().over(inside) - 1)
        upto = before_b + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))
        rows = rows.withColumn("twice", (2 * upto - F.col("size")) * shards)
        return rows.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"twice div {2 * max(1, total)}")).cast("int"))

    place = _keys_range(splits, "k1", "k2")
    if border:
        edge = placed(narrow.withColumn("range", place).where(F.col("range").isin(border)))
        for r in edge.groupBy("shard").agg(F.min("n").alias("n")).collect():
            first[r["shard"]] = min(first.get(r["shard"], r["n"]), r["n"])
    out = placed(keyed.withColumn("range", place))
    begin = F.element_at(F.create_map(*(F.lit(x) for s in range(shards) for x in (s, first.get(s, 0)))), F.col("shard")).cast("long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)), F.col("size").alias("shard_size"), F.col("crc").alias("shard_crc32"), "shard", (F.col("n") - begin).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a shard's records may be in several files, each sorted by slot."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
