"""Sliding-log rate limits: an event is admitted if fewer than ``limit`` admitted ones lie in the window before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def admit(log: list[int], at: int, micros: int, limit: int) -> bool:
    """Drop what left the window from ``log``; log and admit ``at`` if there is room."""
    cut = at - micros
    while log and log[0] <= cut:
        log.pop(0)
    if len(log) >= limit:
        return False
    log.append(at)
    return True


def admitted(events: DataFrame, keys: list[str], at: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """Events (keys, tie) with ``admitted``, in time order of each key.

    Rows come sorted by key and time; a task carries the log of one key from
    batch to batch, ``limit`` entries at most, so a key of any size streams by.
    """
    rows = events.select(*(F.col(k) for k in keys), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, []
        for batch in batches:
            out = []
            for now, moment in zip(batch[keys].itertuples(index=False, name=None), batch["at"], strict=True):
                if now != key:
                    key, log = now, []
                out.append(admit(log, moment, seconds * 1_000_000, limit))
            yield batch[[*keys, tie]].assign(admitted=out)

    schema = StructType([*(events.schema[k] for k in keys), events.schema[tie]]).add("admitted", "boolean")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "at", tie).mapInPandas(run, schema)


class SlidingLog(StatefulProcessor):
    """The same as a stream: state is the log of each key's admitted times."""

    def __init__(self, seconds: int, limit: int):
        self.micros, self.limit = seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = [r[0] for r in self.log.get()] if self.log.exists() else []
        for batch in rows:
            batch = batch.sort_values("at", kind="stable")
            yield pd.DataFrame({"key": [key[0]] * len(batch), "at": batch["at"], "admitted": [admit(log, t, self.micros, self.limit) for t in batch["at"]]})
        if log:
            self.log.put([(t,) for t in log])
        else:
            self.log.clear()

    def close(self) -> None:
        pass


def admitted_stream(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """A stream of (key, at in microseconds) to (key, at, admitted); needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=SlidingLog(seconds, limit), outputStructType="key string, at long, admitted boolean", outputMode="append", timeMode="none"
    )


def in_use(events: DataFrame, key: str, at: str, change: str) -> DataFrame:
    """Adds how many of a group run after each event, from +1 and -1 changes; refused ones have no change."""
    from pyspark.sql.window import Window as W

    return events.withColumn("in_use", F.sum(change).over(W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, 0)))
