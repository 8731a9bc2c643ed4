"""Token counts with a digest cache.

Counts are stored under (tokenizer version digest, content digest). A run joins the texts' digests to the
cache, encodes one text per digest that is missing, appends those counts and joins again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as V
from .util import small, stash

#: At most so many digest rows are broadcast (about 100 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Texts that are encoded at once, and their bytes.
ENCODE_ROWS, ENCODE_BYTES = 256, 1_000_000

_loaded: dict[str, object] = {}


class TokenizerFile:
    """A public tokenizer file: .json for `tokenizers`, .model for `sentencepiece`. Executors get its bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.kind = path.rsplit(".", 1)[-1]
        if self.kind not in ("json", "model"):
            raise ValueError(f"{path}: neither .json nor .model")
        self.version = hashlib.sha256(self.kind.encode() + b"\0" + self.data).hexdigest()

    def counter(self):
        """texts -> numbers of tokens, without begin, end or added special tokens."""
        if self.version not in _loaded:
            if self.kind == "model":
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
                _loaded[self.version] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            else:
                from tokenizers import Tokenizer

                model = Tokenizer.from_str(self.data.decode())
                model.no_truncation(), model.no_padding()
                _loaded[self.version] = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
        return _loaded[self.version]


def _encode(tokenizer: TokenizerFile):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.counter()
        for b in batches:
            out: list[int] = []
            held: list[str] = []
            size = 0
            for x in b.column(1):
                held.append(x.as_py())
                size += len(held[-1])
                if len(held) >= ENCODE_ROWS or size >= ENCODE_BYTES:
                    out += count(held)
                    held, size = [], 0
            if held:
                out += count(held)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["digest", "n_tokens"])

    return run


def _read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("digest binary, n_tokens long").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def token_counts(docs: DataFrame, tokenizer: TokenizerFile, cache: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per input row.

    `cache` is a folder that all executors reach; later runs with the same tokenizer file find its
    counts. The content that is digested is the text with null as empty; any other normalisation could
    change a count. A null or empty text has 0 bytes; repeated rows and equal texts are encoded once.
    Special strings inside texts are handled as the library does by default; nothing is cut or padded.
    over_limit is n_tokens > limit. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = f"{cache.rstrip('/')}/version={tokenizer.version}"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # The corpus is read twice: once for digests and sizes, once for the texts that are missing.
    sized = stash(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    have = _read_cache(spark, path)
    # One row per digest is encoded: that of the smallest id.
    per = sized.groupBy("digest").agg(F.count("*").alias("times"), F.min("doc_id").alias("first"))
    texts = rows.select("doc_id", "digest", "text")
    if have is None:  # all are missing: only digests that repeat are joined, to leave out the further copies
        todo = _first_only(texts, per)
    else:
        missing = per.join(have.select(F.col("digest").alias("d")), F.col("digest") == F.col("d"), "left_anti").select(F.col("digest").alias("d"), "first")
        todo = texts.join(small(stash(missing, "missing"), BROADCAST_ROWS), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("digest", "text")
    # Rows that repeat an id and a text are encoded twice and stored once.
    counted = todo.mapInArrow(V.lean(_encode(tokenizer)), "digest binary, n_tokens long").groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    counted.write.mode("append").parquet(path)
    # Runs that overlap may both store a digest: one row of each counts.
    cached = _read_cache(spark, path).groupBy(F.col("digest").alias("d")).agg(F.first("n_tokens").alias("n_tokens"))
    return sized.join(cached, F.col("digest") == F.col("d")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _first_only(texts: DataFrame, per: DataFrame) -> DataFrame:
    """Texts without the further copies; only digests that repeat are joined, so most texts needn't move."""
    repeated = per.where("times > 1").select(F.col("digest").alias("d"), F.col("first"), F.lit(True).alias("again"))
    joined = texts.join(small(stash(repeated, "repeated"), BROADCAST_ROWS), F.col("digest") == F.col("d"), "left")
    return joined.where(F.col("again").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).select("digest", "text")
