"""Shared pieces: the shared folder, intermediate tables, filters by row keys, free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many row keys (under 100 bytes each) are broadcast, by count; more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, however it was set.

    `SparkContext.setCheckpointDir` wins over `spark.checkpoint.dir`. Without either, a local session (one
    JVM, as in tests) sets its own beside its warehouse; a cluster has no folder that is known to be
    shared, and that is an error.
    """
    context = spark.sparkContext
    if not (path := context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("no shared folder for intermediate tables: set spark.checkpoint.dir at launch or call SparkContext.setCheckpointDir")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-checkpoints")
        path = context.getCheckpointDir()
    return path.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame once as a table in the shared folder and reads it back.

    This cuts lineage so that a lost executor costs a reread, and gives the planner real sizes.
    """
    path = f"{shared_folder(df.sparkSession)}/weftgraph-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows, by count; pass stashed frames."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the frame doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, wish
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
