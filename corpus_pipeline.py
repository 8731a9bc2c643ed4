"""A training corpus in five stages: quality, near duplicates, contamination, mix, shards.

Each stage is a function of (spark, docs, sf_dir). run() writes every stage's rows as Parquet to the
shared checkpoint folder and reads them back, so a stage can be redone without those before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, mixing, ngram_join, quality, sharding
from weftgraph.llm.util import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the calibrated rules keep."""
    return quality.keep(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, of the smallest id: five-word shingles, similarity of 0.8 or more.

    Of rows that share it (or of a class without ids) the one of the smallest text hash stays, and of equal
    texts the one of the smallest other columns. Texts without words are in no class and stay.
    """
    return ngram_join.one_of_each(docs.select(*COLUMNS), n=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no ten-word window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), n=10).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: none, one or two times."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    times = F.when(F.col("mix_size") > 0, F.col("mix_taken") / F.col("mix_size")).otherwise(F.lit(0)).cast("int")
    return mixed.withColumn("turn", F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with shard (0 to 7) and slot; shards are near equal by bytes."""
    out = sharding.shard(docs.select(*COLUMNS), shards=8)
    return out.select(*COLUMNS, F.col("shard_size").alias("size"), "shard", "slot")


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing to target weights", mix), ("sharding", shards)]

#: Calibrated thresholds and a seeded mix are not expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
