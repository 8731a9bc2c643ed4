"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose feature is at least a cutoff. For every stratum (language) the rules are
made stricter together, step by step, one feature's cutoff at a time. After each step the exact
(Clopper-Pearson) upper bound of the rate at which all rules together reject labelled good texts must stay
below `risk`. The first failure ends the sequence, which needs no correction of its own (fixed-sequence
testing): its order comes from the good texts of the other strata and the bad texts of all, so the good
texts of the stratum itself are only tested. The bound's level is `doubt` divided by all strata
(Bonferroni). So with probability 1 - doubt no stratum loses more than `risk` of its good texts to all
rules together. A stratum with too few labels gets no cutoff and rejects nothing beyond the base rule: it
takes log(level) / log(1 - risk) good texts, 217 with four strata, if none of them is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as V
from .util import free_name, quoted, small, stash

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: feature -> its value per text, in 0..1. All are computed from the whole text.
FEATURES = {
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_text_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "shouts_per_word": "n_shouts / greatest(n_words, 1)",
}
#: Cutoffs that are tried, fixed before any label is seen.
GRID = tuple(i / 100 for i in (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 75))
#: At most so many strata are calibrated; more is an error, not a silent cut.
MAX_STRATA = 10_000

_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_KIND = {
    "n_symbols": _IS_SYMBOL,
    "n_upper": (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z")),
    "n_digits": (np.arange(256) >= ord("0")) & (np.arange(256) <= ord("9")),
    "n_shouts": np.arange(256) == ord("!"),
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_upper", "n_digits", "n_shouts"]


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _line_hashes(buf: np.ndarray, off: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that hold a word, and the first such line of each text."""
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    cut[:-1] |= buf == 10
    cut[1:] |= np.append(buf, 0)[:-1] == 10
    edge = np.flatnonzero(cut)
    lo, hi = edge[:-1], edge[1:]
    has = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi = lo[has], hi[has]
    return V.word_hashes(buf, lo, hi, lower=False), np.searchsorted(lo, off)


def _stats(text: int | None = None):
    """Batches -> the same columns and the counts. The text is the last column, which goes, or a field of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1) if text is None else pa.compute.struct_field(b.column(0), [text]).cast(pa.string())
            own = b.columns[: b.num_columns - (text is None)]
            yield pa.RecordBatch.from_arrays([*own, *_counted(texts)], names=[*b.schema.names[: len(own)], *_COUNTS])

    return run


def _counted(texts: pa.Array) -> list[pa.Array]:
    cols: dict[str, list] = {c: [] for c in _COUNTS}
    for lo, hi, buf, off in V.blocks(texts):
        starts, ends, first = V.word_bounds(buf, off)
        cols["n_words"].append(np.diff(first))
        cols["word_chars"].append(_per_text(~V._SPACE[buf] & ((buf & 0xC0) != 0x80), off))
        for name, kind in _KIND.items():
            cols[name].append(_per_text(kind[buf], off))
        words = V.word_hashes(buf, starts, ends, lower=False)
        grams, base = V.windows(words, first, 3, short=False)
        lines, line = _line_hashes(buf, off, starts)
        cols["n_text_lines"].append(np.diff(line))
        dup, rep = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        for i in range(hi - lo):
            own = lines[line[i] : line[i + 1]]
            if len(own) > 1:
                dup[i] = len(own) - len(np.unique(own))
            own = grams[base[i] : base[i + 1]]
            if len(own) > 1:
                order = np.argsort(own)
                s = own[order]
                same = s[1:] == s[:-1]
                if same.any():
                    twice = np.zeros(len(own) + 2, bool)
                    at = np.concatenate([order[1:][same], order[:-1][same]])
                    twice[at] = twice[at + 1] = twice[at + 2] = True
                    rep[i] = twice.sum()
        cols["n_dup_lines"].append(dup)
        cols["n_repeat_words"].append(rep)
    return [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in cols.values()]


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """Counts per input row. Null, empty and blank texts have zeros; a null stratum is its own ('')."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), _stratum(docs, stratum_col).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(V.lean(_stats()), f"doc_id {kind}, row long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS))


def _stratum(docs: DataFrame, stratum_col: str | None) -> Column:
    return F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the regularised incomplete beta I_{1-p}(n - k, k + 1).

    By its continued fraction, evaluated on the side where it converges fast; exact for any n.
    """
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log1p(-p) + b * log(p))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, p) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    out = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or 1e-300)
            c = (1 + term / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def binomial_upper(k: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a rate after k of n: the rate p at which P(X <= k) = level."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > level else (lo, mid)
    return hi


@dataclass(frozen=True)
class Cutoffs:
    """(stratum, feature) -> cutoff; no entry: the rule rejects nothing there."""

    values: dict[tuple[str, str], float]

    def rejects(self) -> Column:
        """On text_stats columns: some rule of the row's stratum rejects it."""
        out = F.lit(False)
        for name, value in FEATURES.items():
            own = {s: c for (s, f), c in self.values.items() if f == name}
            if own:
                cut = F.create_map(*(x for s, c in sorted(own.items()) for x in (F.lit(s), F.lit(float(c)))))[F.col("stratum")]
                out = out | F.coalesce(F.expr(value) >= cut, F.lit(False))
        return out


def _order(good: dict[str, int], bad: dict[str, int]) -> list[tuple[str, int]]:
    """(feature, grid place) steps in the order of their test, from counts `n` and `feature@place`.

    First those that take a larger share of the bad texts than of the good ones, by the good texts they
    take, then those that take none of these good texts; the mildest first among equals.
    """
    worth, free = [], []
    for f in FEATURES:
        lost = caught = 0
        for i in reversed(range(len(GRID))):
            g, b = good.get(f"{f}@{i}", 0), bad.get(f"{f}@{i}", 0)
            if (b - caught) * good.get("n", 0) > (g - lost) * bad.get("n", 0) or (b > caught and g == lost):
                worth.append((g, -i, len(worth), f))
                lost, caught = g, b
            elif g == 0:
                free.append((g, -i, len(free), f))
    return [(f, -i) for _, i, _, f in sorted(worth) + sorted(free)]


def calibrate(stats: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> Cutoffs:
    """Cutoffs from all labelled texts (labels: doc_id, quality) that pass the base rule.

    Only counts per stratum, feature and grid value, or per stratum and step, come to the driver. Several
    labels of one id count once, as good if any says so; null ids or labels are ignored.
    """
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q is not null").select(F.col("doc_id").alias("g"), (F.col("q") == 1).alias("good"))
    places = [sum((F.expr(v) >= F.lit(c)).cast("int") for c in GRID).alias(f) for f, v in FEATURES.items()]  # cutoffs that reject
    rows = stash(stats.join(named, F.col("doc_id") == F.col("g")).where(~base_failed()).select("stratum", "good", *places), "labelled")
    counts = [F.count("*").alias("n"), *(F.count_if(F.col(f) > i).alias(f"{f}@{i}") for f in FEATURES for i in range(len(GRID)))]
    found = [r.asDict() for r in rows.groupBy("stratum", "good").agg(*counts).limit(2 * MAX_STRATA + 1).collect()]
    good = {r["stratum"]: r for r in found if r["good"]}
    if len({r["stratum"] for r in found}) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    if not good:
        return Cutoffs({})
    keys = ["n", *(f"{f}@{i}" for f in FEATURES for i in range(len(GRID)))]
    all_good = {k: sum(r[k] for r in good.values()) for k in keys}
    all_bad = {k: sum(r[k] for r in found if not r["good"]) for k in keys}
    order, plan, never = {}, [], len(keys)
    for s, own in good.items():
        order[s] = _order({k: all_good[k] - own[k] for k in keys}, all_bad)
        step = {x: t for t, x in enumerate(order[s])}
        # The first step that rejects a text of this place, feature after feature.
        plan.append((s, [min((step.get((f, i), never) for i in range(place)), default=never) for f in FEATURES for place in range(len(GRID) + 1)]))
    planned = F.broadcast(stats.sparkSession.createDataFrame(plan, "s string, steps array<int>"))  # at most MAX_STRATA rows
    first = F.least(*(F.get("steps", F.lit(j * (len(GRID) + 1)) + F.col(f)) for j, f in enumerate(FEATURES)))
    hits = rows.where("good").join(planned, F.col("stratum") == F.col("s")).groupBy("stratum", first.alias("step")).agg(F.count("*").alias("k")).collect()
    lost = {(r["stratum"], r["step"]): r["k"] for r in hits}
    level = doubt / len(good)
    values: dict[tuple[str, str], float] = {}
    for s, own in good.items():
        k, tested = 0, -1
        for t, (f, i) in enumerate(order[s]):  # a fixed order, ended by the first failure
            k += lost.get((s, t), 0)
            if k > tested and (k > risk * own["n"] or binomial_upper(k, own["n"], level) > risk):
                break
            tested = k
            values[s, f] = min(GRID[i], values.get((s, f), 1.0))
    return Cutoffs(values)


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """One row per input row: doc_id, row, stratum, the counts, base_failed, kept.

    `row` is the hash of the text, which tells rows with one id apart.

    base_failed: fewer than 50 words, or more than half of them in 3-word windows found twice or more.
    Null, empty and blank texts fail it. kept: neither the base rule nor a calibrated rule rejects.
    Repeated rows are judged alike. An empty table, or one without labels, calibrates nothing.
    """
    stats = stash(text_stats(docs, id_col, text_col, stratum_col), "stats")
    cutoffs = calibrate(stats, labels, risk, doubt)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~cutoffs.rejects())


def keep(docs: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """The input rows, with all their columns, that judge() keeps.

    Only labelled texts are read to calibrate, if their ids are few enough to be broadcast; then every text
    is judged where it stands: no text is shuffled or joined. Repeated rows share their fate.
    """
    labelled = free_name(docs, "labelled_id")
    named = stash(labels.where("doc_id is not null").select(F.col("doc_id").alias(labelled)).distinct(), "labelled_ids")
    few = small(named)
    known = docs if few is named else docs.join(few, quoted(id_col) == F.col(labelled), "left_semi")
    cutoffs = calibrate(text_stats(known, id_col, text_col, stratum_col), labels, risk, doubt)
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), _stratum(docs, stratum_col).alias("stratum"))
    schema = T.StructType([T.StructField("doc", docs.schema), T.StructField("stratum", T.StringType()), *(T.StructField(c, T.LongType()) for c in _COUNTS)])
    judged = whole.mapInArrow(V.lean(_stats(docs.columns.index(text_col))), schema).where(~base_failed() & ~cutoffs.rejects())
    return judged.select(*(F.col("doc")[c].alias(c) for c in docs.columns))
