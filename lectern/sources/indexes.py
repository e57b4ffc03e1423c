"""Derived tables that are built once and then read by many queries."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from lectern.session import shared_folder


def version_of(spark: SparkSession, paths: Sequence[str]) -> str:
    """A name for the files as they are: it changes with any path, length or time of change."""
    jvm, conf, seen = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), hashlib.sha1()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listStatus(at)
        seen.update(repr([(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]).encode())
    return seen.hexdigest()[:16]


def built(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """The table ``name`` made of the files ``inputs``: read if this application has built it from them, else built.

    It is written as Parquet in the shared folder under a name of its own and
    then renamed, so a reader never sees half of it and of two builders one
    wins. Each file is sorted by ``order``, so that a filter on it reads few pages
    of a file; rows, which are large, aren't shuffled for that.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    path, draft = f"{folder}/{name}-{version_of(spark, inputs)}", f"{folder}/draft-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    if not files.exists(at):
        rows = build()
        rows = rows.sortWithinPartitions(*order) if order else rows
        rows.write.parquet(draft)
        if not files.rename(jvm.org.apache.hadoop.fs.Path(draft), at) and not files.exists(at):
            raise OSError(f"{draft} could not be renamed to {path}")
    return spark.read.parquet(path)
