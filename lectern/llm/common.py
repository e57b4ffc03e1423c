"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import shared_folder

#: Word characters of the operators' contracts: everything but the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the bit maps that screen rows for a join, 64 bits each; their size is fixed.
SCREEN_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str, of: str = "") -> F.Column:
    """A column of any name, dots and backticks included; ``of`` is the table's alias."""
    return F.col(f"{of}." * bool(of) + "`" + column.replace("`", "``") + "`")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that nothing refers to any more.

    Checkpoint files go too where the session was begun with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``get_session``
    does. The cleaner works when the driver collects its garbage, which a driver
    with little of its own to do may put off until disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a packed table of the shared folder, and its path, for ``remove``."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that is no longer read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def words_in(text) -> F.Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_of(share, *columns) -> F.Column:
    """Whether a row is in a sample of about ``share`` of all (a number or column), by a hash of its columns; shares may be as small as 2 ** -50."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)).cast("double") < share * F.lit(float(1 << 53))


def screened(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``columns`` are probably in ``wanted``, by a bit map of a fixed size; what it lets through by chance ends in a join."""
    h = F.xxhash64(*columns)
    named = ", ".join(f"`{c}`" for c in columns)
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64({named}), 32), 64) as int))")
    place = lambda df: df.withColumns({"_slot": F.pmod(h, F.lit(SCREEN_ROWS)), "_bit": bit})
    bits = place(wanted).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    return place(rows).join(F.broadcast(bits), "_slot").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_slot", "_bit", "_bits")


def parallelism(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
