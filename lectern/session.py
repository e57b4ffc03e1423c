"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """UTC, ANSI and adaptive execution; ``partitions`` only where the cluster's default doesn't fit."""
    builder = SparkSession.builder.appName("lectern").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only on a local master, where one machine is all there is, a folder of its
    own stands in for it; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "lectern-checkpoints")
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder as packed columns, for rows whose texts repeat."""
    path = f"{shared_folder(df.sparkSession)}/packed-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a partition that costly columns or groups are made of.
DEALT = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in partitions of a number in proportion to its rows, by ``keys``, however few and large its files' pieces are.

    For rows that are small when they are read and cost much, in time or memory,
    by what is made of them.
    """
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // DEALT)
    return df.repartition(partitions, *keys)
