"""Comparison of two snapshots, digests and duplicate counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, guard: list[str], payload: list[str]) -> DataFrame:
    """Each key with its class: removed, added, mismatch (a guard column differs), changed or same."""
    a = before.select(F.col(key).alias("a_key"), *(F.col(c).alias(f"a_{c}") for c in {*guard, *payload}))
    b = after.select(F.col(key).alias("b_key"), *(F.col(c).alias(f"b_{c}") for c in {*guard, *payload}))
    differs = lambda columns: F.lit(False) if not columns else ~F.struct(*(f"a_{c}" for c in columns)).eqNullSafe(F.struct(*(F.col(f"b_{c}").alias(f"a_{c}") for c in columns)))
    kind = (
        F.when(F.col("b_key").isNull(), "removed").when(F.col("a_key").isNull(), "added").when(differs(guard), "mismatch").when(differs(payload), "changed").otherwise("same")
    )
    return a.join(b, F.col("a_key") == F.col("b_key"), "full_outer").select(F.coalesce("a_key", "b_key").alias(key), kind.alias("kind"))


def digest_sums(columns: list[str]) -> list[Column]:
    """Aggregates digest_a and digest_b: the two halves of each row's SHA-256 as numbers, added up."""
    h = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    return [F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)")).alias(name) for i, name in ((1, "digest_a"), (16, "digest_b"))]


def set_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_rows and a digest of the rows that doesn't depend on their order.

    The digest adds up two halves of each row's SHA-256 as numbers, repeats
    included, so it is a sum like any other: added up where rows are read, and
    no row's hash is gathered.
    """
    sums = rows.agg(F.count(F.lit(1)).alias("n_rows"), *digest_sums(columns))
    return sums.select("n_rows", *(F.col(c).cast("string").alias(c) for c in ("digest_a", "digest_b")))


def repair_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row of a repair: sections and shifted ones before and after, and keys whose sections changed; columns ``errors`` and ``payload``."""
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias(f"sections_{side}"), F.count_if(shifted(F.col("errors"))).alias(f"shifted_{side}"))
    digest = lambda df, side: df.groupBy(key).agg(F.sum(F.xxhash64("payload").cast("decimal(38,0)")).alias(side))
    changed = digest(before, "a").join(digest(after, "b"), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.count(F.lit(1)).alias("changed"))
    return count(before, "before").join(count(after, "after")).join(changed)


def rebuilt(index: DataFrame, repaired: DataFrame, derived: list[str], key: str = "course_uid") -> DataFrame:
    """The index with its derived columns taken from repaired rows, all else as it was; a key without a repaired row is an error."""
    fresh = repaired.select(key, F.lit(True).alias("here"), *derived)
    rows = index.drop(*derived).join(fresh, key, "left")
    there = F.when(F.col("here"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no repaired row of "), F.col(key))).cast(index.schema[key].dataType))
    return rows.withColumn(key, there).select(*index.columns)


def duplicate_histogram(rows: DataFrame, key: Column) -> DataFrame:
    """How many keys occur how often, for those that occur more than once."""
    counts = rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return counts.groupBy("copies").agg(F.count(F.lit(1)).alias("n_keys"))


def duplicate_excess(rows: DataFrame, key: Column) -> DataFrame:
    """One row: keys that occur more than once, and rows beyond the first of each."""
    counts = rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return counts.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("excess"))


def shifted(errors: Column) -> Column:
    """Whether a section's columns are shifted: its points can't be read."""
    return F.array_contains(errors, "invalid_points")
