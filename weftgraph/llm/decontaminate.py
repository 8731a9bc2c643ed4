"""Benchmark decontamination in DataFrame functions only.

The windows of the benchmark's normalised words form a hash set that every task gets. Texts are scanned
once: a window whose first, middle and last word hash into the set is a candidate, and a candidate whose
whole n-gram is in the set is a hit. No text is shuffled and nothing is joined to find or drop a text.

A benchmark above MAX_SET windows is met by hashes: each window of a text gives only its place and a
64-bit hash, which meets a broadcast block of the benchmark's hashes inside the scan; the words of the few
survivors are then compared in a join. A benchmark of several blocks is scanned for block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import free_name, quoted, small, stash

#: What stands between words: ASCII other than digits and letters. Fixed value of the contract.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that is not folded yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many windows go to the tasks as a hash set of n-grams, inside the scan's own expression.
MAX_SET = 50_000
#: Hashes of a larger benchmark that are broadcast at once (under 100 bytes each).
MAX_BROADCAST = 1_000_000
_SPANS = "array<struct<at: int, size: int>>"


def normal_words(text: Column) -> Column:
    """Words of a text, A-Z folded; null or no words: an empty array."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, NOT_WORD), "")


def benchmark_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win array<string>, size, anchor, items): distinct windows, each with all items that hold it.

    An item of fewer than n words, but not none, is one window.
    """
    words = items.select(F.col(id_col).alias("item"), normal_words(F.col(text_col)).alias("w")).where("size(w) > 0")
    size = F.least(F.lit(n), F.size("w"))
    each = words.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    wins = each.select("item", "size", F.slice("w", F.col("i"), F.col("size")).alias("win")).groupBy("win", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return wins.withColumn("anchor", F.expr("xxhash64(size, win[0], win[size div 2], win[size - 1])"))


def _long(x: int) -> str:
    return f"{x}L" if x > -(2**63) else f"({x + 1}L - 1L)"


def _anchor(z: int, at: str) -> str:
    return f"xxhash64({z}, get(words, {at}), get(words, {at} + {z // 2}), get(words, {at} + {z - 1}))"


def _spans(wins: list) -> Column:
    """Places in `words` (from 0) of the windows that are in the hash set: array of (at, size)."""
    found = []
    for z in sorted({len(w) for w, _ in wins}):
        anchors = ", ".join(sorted({_long(a) for w, a in wins if len(w) == z}))
        grams = ", ".join(f"'{' '.join(w)}'" for w, _ in wins if len(w) == z)  # words have no quotes or spaces
        places = f"filter(sequence(0, greatest(size(words) - {z}, 0)), i -> size(words) >= {z} and {_anchor(z, 'i')} in ({anchors}))"
        sure = f"filter({places}, i -> array_join(slice(words, i + 1, {z}), ' ') in ({grams}))"
        found.append(f"transform({sure}, i -> struct(i as at, {z} as size))")
    return F.expr(f"concat({', '.join(found)})" if found else f"cast(array() as {_SPANS})")


def _set_of(wins: DataFrame, max_set: int) -> list | None:
    """The windows with their anchors, if the hash set may hold them."""
    rows = wins.select("win", "anchor").limit(max_set + 1).collect()
    return [(r["win"], r["anchor"]) for r in rows] if len(rows) <= max_set else None


def _worded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, words). Through a generator, else a text is split again for each use of its words."""
    one = F.struct(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("row"), normal_words(quoted(text_col)).alias("words"))
    return docs.select(F.explode(F.array(one)).alias("s")).select("s.doc_id", "s.row", "s.words")


def _survivors(rows: DataFrame, wins: DataFrame, max_broadcast: int) -> DataFrame:
    """(doc_id, row, at, size, anchor, win) of windows whose hash the benchmark has."""
    sizes = sorted(r["size"] for r in wins.select("size").distinct().collect())  # n values at most
    blocks = max(1, -(-wins.count() // max(1, max_broadcast)))
    each = F.inline(F.expr("array(" + ", ".join(f"named_struct('size', {z}, 'anchor', if(at + {z} <= size(words), {_anchor(z, 'at')}, null))" for z in sizes) + ")"))
    out = None
    for block in range(blocks):
        anchors = wins.where(F.pmod(F.hash("anchor"), F.lit(blocks)) == block).select(F.col("anchor").alias("a")).distinct()
        places = rows.select("doc_id", "row", "words", F.explode_outer(F.expr("sequence(0, greatest(size(words) - 1, 0))")).alias("at"))
        met = places.select("doc_id", "row", "words", "at", each).join(F.broadcast(anchors), F.col("anchor") == F.col("a"))
        met = met.select("doc_id", "row", "at", "size", "anchor", F.expr("slice(words, at + 1, size)").alias("win"))
        out = met if out is None else out.unionByName(met)
    return out


def hits(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_set: int = MAX_SET, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, row, n_words, spans, items), one row per input row.

    `row` is the text's hash, which tells rows with one id apart; spans: the (at, size) word spans, from 0,
    in which a benchmark window occurs; items: the ids of all items with an occurring window, sorted. Both
    are empty for clean rows. Null, empty and wordless texts and items have no words and hit nothing;
    repeated rows get the same result each; an item with a null id hits but adds no id; an empty benchmark
    hits nothing. Extra columns are ignored. Results don't depend on max_set and max_broadcast.
    """
    wins = stash(benchmark_windows(items, n, item_id, item_text), "windows")
    known = _set_of(wins, max_set)
    rows = _worded(docs, id_col, text_col)
    n_words = F.size("words").cast("long").alias("n_words")
    if known is not None:  # hits are few: they are kept with the narrow rows, and the texts are read once
        scan = rows.withColumn("spans", _spans(known)).select("doc_id", "row", n_words, F.expr("transform(spans, s -> struct(s.at as at, s.size as size, slice(words, s.at + 1, s.size) as win))").alias("found"))
        scan = stash(scan, "scan")
        found = scan.select("doc_id", "row", F.explode("found").alias("c")).select("doc_id", "row", "c.at", "c.size", "c.win")
        on = F.col("win") == F.col("w")
    else:
        scan = rows.select("doc_id", "row", n_words)
        found = _survivors(rows, wins, max_broadcast)
        on = (F.col("anchor") == F.col("a")) & (F.col("win") == F.col("w"))
    side = small(wins.select(F.col("anchor").alias("a"), F.col("win").alias("w"), F.col("items").alias("own")))
    met = found.join(side, on)
    spans, ids = F.collect_set(F.struct("at", "size")), F.array_sort(F.array_distinct(F.flatten(F.collect_set("own"))))
    per = met.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(spans.alias("spans"), ids.alias("items"))
    out = scan.select("doc_id", "row", "n_words").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    kind = items.schema[item_id].dataType.simpleString()
    return out.select("doc_id", "row", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")).alias("spans"), F.coalesce("items", F.expr(f"cast(array() as array<{kind}>)")).alias("items"))


def n_hit(spans: Column) -> Column:
    """Words that any span covers."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))).cast("long")


def _with_spans(docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, item_id: str = "item_id", item_text: str = "text", max_set: int = MAX_SET, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, str]:
    """The input rows with their hits' (at, size) in a column of a free name; empty or null: none."""
    wins = stash(benchmark_windows(items, n, item_id, item_text), "windows")
    spans = free_name(docs, "spans")
    if (known := _set_of(wins, max_set)) is not None:
        whole = F.struct(F.struct(*map(quoted, docs.columns)).alias("doc"), normal_words(quoted(text_col)).alias("words"))
        rows = docs.select(F.explode(F.array(whole)).alias("s")).select("s.doc", "s.words").select("doc", _spans(known).alias("spans"))
        return rows.select(*(F.col("doc")[c].alias(c) for c in docs.columns), F.col("spans").alias(spans)), spans
    found = hits(docs, items, n, id_col, text_col, item_id, item_text, max_set, max_broadcast).where("size(spans) > 0")
    g, r = free_name(docs, "bad_doc"), free_name(docs, "bad_row")
    bad = small(stash(found.select(F.col("doc_id").alias(g), F.col("row").alias(r), F.col("spans").alias(spans)).dropDuplicates([g, r]), "bad"))
    joined = docs.join(bad, quoted(id_col).eqNullSafe(F.col(g)) & (F.xxhash64(quoted(text_col)) == F.col(r)), "left")
    return joined.drop(g, r), spans


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows, with all their columns, in which no benchmark window occurs. A hash set's is a filter."""
    rows, spans = _with_spans(docs, items, n, id_col, text_col, **options)
    return rows.where(F.coalesce(F.size(spans), F.lit(0)) <= 0).select(*map(quoted, docs.columns))


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows; every run of hit words is cut out of its text, with what stands between those words.

    Everything else (case, punctuation, lines) stays as it is, and so do clean texts.
    """
    rows, spans = _with_spans(docs, items, n, id_col, text_col, **options)
    text = quoted(text_col).cast("string")
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD)

    def hit(i: Column) -> Column:
        return F.exists(F.col(spans), lambda s: (s["at"] <= i) & (i < s["at"] + s["size"]))

    def piece(x: Column, i: Column) -> Column:
        gap = F.when(hit(i) & hit(i - 1), F.lit("")).otherwise(x["gap"])
        return F.concat(gap, F.when(hit(i), F.lit("")).otherwise(F.coalesce(x["word"], F.lit(""))))

    both = F.arrays_zip(gaps.alias("gap"), words.alias("word"))  # a gap before each word, and one after the last
    clean = F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.array_join(F.transform(both, piece), "")).otherwise(text)
    return rows.withColumn(text_col, clean).select(*map(quoted, docs.columns))
