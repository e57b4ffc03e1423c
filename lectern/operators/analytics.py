"""Statistics over the catalogue and general analytics on event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def counts_by(rows: DataFrame, name: Column, most: int = 20) -> DataFrame:
    """The ``most`` largest groups by count, ties by name; blank names count as UNKNOWN."""
    label = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "UNKNOWN").otherwise(name).alias("name")
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Sessions of each key: events no more than ``gap`` apart."""
    before = F.lag(at).over(W.partitionBy(key).orderBy(at))
    starts = events.withColumn("opens", (before.isNull() | (F.col(at) - before > F.expr(f"interval {gap}"))).cast("int"))
    number = F.sum("opens").over(W.partitionBy(key).orderBy(at).rangeBetween(W.unboundedPreceding, 0))
    return starts.withColumn("session", number).groupBy(key, "session").agg(F.min(at).alias("began"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n_events"))


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, span: str, micros: int) -> DataFrame:
    """Pairs of rows of one key with the right one after the left by at most ``span``.

    Both sides are dealt by key and slot of ``micros``; a left row meets its own
    slot and the next, so a busy key is spread over its slots.
    """
    slot = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / micros)
    a = left.withColumn("slot", F.explode(F.array(slot(F.col(at)), slot(F.col(at)) + 1)))
    b = right.select(F.col(key).alias("k"), slot(F.col(at)).alias("s"), *(F.col(c).alias(f"right_{c}") for c in right.columns if c != key))
    pairs = a.join(b, (F.col(key) == F.col("k")) & (F.col("slot") == F.col("s")))
    gap = F.col(f"right_{at}") - F.col(at)
    return pairs.where((gap > F.expr("interval 0 seconds")) & (gap <= F.expr(f"interval {span}"))).drop("k", "s", "slot")


def rate_bound(events: DataFrame, key: list[str], at: str, seconds: int) -> DataFrame:
    """Adds how many events of the key lie in the window that ends with each, an upper bound of the admitted ones."""
    stamp = F.unix_micros(F.col(at).cast("timestamp"))
    return events.withColumn("in_window", F.count(F.lit(1)).over(W.partitionBy(*key).orderBy(stamp).rangeBetween(-seconds * 1_000_000 + 1, 0)))
