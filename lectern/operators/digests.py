"""Digest trees: leaves, folders of leaves and a root, each with a digest of what is below it.

A folder's digest is made of the number of its children and two sums over their
hashes, so it doesn't depend on their order, is added up where rows are read and
gathers no folder in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "path array<string>, leaf boolean, children long, digest string"
#: Changed files up to which just those are read again.
CHANGED = 10_000


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row's values as text, null as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def _sums(digest: Column) -> list[Column]:
    half = lambda i: F.sum(F.conv(F.substring(digest, i, 15), 16, 10).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("children"), half(1).alias("_a"), half(16).alias("_b")]


def folded(children: DataFrame) -> DataFrame:
    """Folders of nodes (path, digest): path, children and digest of each parent."""
    child = F.sha2(F.concat_ws(":", F.element_at("path", -1), "digest"), 256)
    rows = children.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), child.alias("h"))
    sums = rows.groupBy("path").agg(*_sums(F.col("h")))
    return sums.select("path", F.lit(False).alias("leaf"), "children", F.sha2(F.concat_ws("|", F.col("children").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string")), 256).alias("digest"))


def tree(leaves: DataFrame, depth: int) -> DataFrame:
    """All nodes (path, leaf, children, digest) over leaves (path, digest) of at most ``depth`` names; the root's path is empty."""
    level = lambda d: leaves.where(F.size("path") == d).select("path", F.lit(True).alias("leaf"), F.lit(0).cast("long").alias("children"), "digest")
    nodes, out = level(depth), []
    for d in range(depth, 0, -1):
        out.append(nodes)
        nodes = folded(nodes.select("path", "digest"))
        nodes = nodes if d == 1 else nodes.union(level(d - 1))
    return reduce(DataFrame.union, [*out, nodes])


def refreshed(before: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """The tree over ``leaves``, taken from the tree ``before`` but for branches with a leaf that changed, came or went."""
    old = before.where("leaf").select("path", F.col("digest").alias("was"))
    moved = old.join(leaves.select("path", "digest"), "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("digest"))).select("path")
    parents = lambda n: F.transform(F.sequence(F.lit(0), F.size(n) - 1), lambda k: F.slice(n, 1, k))
    touched = moved.select(F.explode(parents(F.col("path"))).alias("path")).distinct()
    kept = before.where("not leaf").join(touched, "path", "left_anti")
    level = lambda d: leaves.where(F.size("path") == d).select("path", F.lit(True).alias("leaf"), F.lit(0).cast("long").alias("children"), "digest")
    fresh, out = level(depth), [leaves.select("path", F.lit(True).alias("leaf"), F.lit(0).cast("long").alias("children"), "digest"), kept]
    for d in range(depth, 0, -1):
        parent = F.slice("path", F.lit(1), F.size("path") - 1)
        below = fresh.unionByName(kept.where(F.size("path") == d)).withColumn("parent", parent)
        below = below.join(touched.select(F.col("path").alias("parent")), "parent", "left_semi")
        made = folded(below.select("path", "digest"))
        out.append(made)
        fresh = made if d == 1 else made.union(level(d - 1))
    return reduce(DataFrame.union, out)


def file_leaves(spark: SparkSession, root: str, before: DataFrame | None = None) -> DataFrame:
    """path, digest, length and modified of all files under ``root``.

    With ``before``, leaves of an earlier run, files of the same length and time
    keep their digest and aren't opened; if few others are left, just those are
    read, by name.
    """
    read = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    base = read(root)
    names = lambda df: df.withColumn("names", F.split(F.regexp_replace(F.replace(F.col("path"), F.lit(full)), "^/", ""), "/"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    hashed = lambda df: names(df).select(F.col("names").alias("path"), F.sha2("content", 256).alias("digest"), "length", F.col("modificationTime").alias("modified"))
    if before is None:
        return hashed(base)
    # Without the content no file is opened.
    listed = names(base.select("path", "length", "modificationTime")).select(F.col("path").alias("file"), F.col("names").alias("path"), "length", F.col("modificationTime").alias("modified"))
    same = listed.join(before, ["path", "length", "modified"]).select("path", "digest", "length", "modified")
    changed = listed.join(before, ["path", "length", "modified"], "left_anti")
    some = [r[0] for r in changed.select("file").limit(CHANGED + 1).collect()]
    if not some:
        return same
    fresh = hashed(read(some)) if len(some) <= CHANGED else hashed(base).join(changed.select("path"), "path", "left_semi")
    return same.union(fresh)
