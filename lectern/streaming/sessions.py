"""Caches of keyed state: answers that hold for a time, and sessions beyond a number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def answer(held: tuple[bool, int] | None, at: int, ok: bool, force: bool, keep: int) -> tuple[bool, bool, tuple[bool, int]]:
    """What a cache says at ``at``, whether it had to look, and what it holds then. An answer of age ``keep`` is too old."""
    if held and not force and at - held[1] < keep:
        return held[0], False, held
    return ok, True, (ok, at)


def cached_checks(asked: DataFrame, key: str, at: str, tie: str, ok: str, keep: int = 30, force: str | None = None) -> DataFrame:
    """Rows (key, tie) with available and probed: what a cache of ``keep`` seconds answers each time it is asked.

    ``ok`` is what a look would find. A task carries the answer of one key, so a
    key of any size streams by.
    """
    rows = asked.select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(ok).alias("_ok"), (F.col(force) if force else F.lit(False)).alias("_force"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            out = []
            for k, moment, found, forced in zip(batch[key], batch["_at"], batch["_ok"], batch["_force"], strict=True):
                if k != now:
                    now, held = k, None
                available, probed, held = answer(held, moment, bool(found), bool(forced), keep * 1_000_000)
                out.append((available, probed))
            yield batch[[key, tie]].assign(available=[a for a, _ in out], probed=[p for _, p in out])

    kind = rows.select(key, tie).schema.add("available", "boolean").add("probed", "boolean")
    return rows.repartition(key).sortWithinPartitions(key, "_at", tie).mapInPandas(run, kind)


class Answers(StatefulProcessor):
    """The same as a stream on the machine's clock: Spark's state TTL drops answers that are too old."""

    def __init__(self, keep: int):
        self.keep = 1000 * keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ok boolean", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.held.get()[0] if self.held.exists() else None
        for batch in rows:
            out = []
            for r in batch.itertuples():
                probed = known is None or bool(r.force)
                if probed:
                    known = bool(r.ok)
                    self.held.update((known,))
                out.append((key[0], r.id, known, probed))
            yield pd.DataFrame(out, columns=["key", "id", "available", "probed"])

    def close(self) -> None:
        pass


def checks_stream(asked: DataFrame, keep: int = 30) -> DataFrame:
    """A stream (key string, id, ok, force) to (key, id, available, probed); needs the RocksDB state store."""
    return asked.select("key", "id", "ok", "force").groupBy("key").transformWithStateInPandas(
        statefulProcessor=Answers(keep), outputStructType="key string, id long, available boolean, probed boolean", outputMode="append", timeMode="processingTime"
    )


def evicted(sessions: DataFrame, key: str, used: str, active: str, most: int) -> DataFrame:
    """Sessions to drop so that ``most`` stay, the least recently used first.

    An active session isn't dropped, and nor is one used after it: eviction
    waits for the oldest active one. The order is found by two aggregates of
    fixed size, not by sorting all sessions.
    """
    place = F.struct(used, key)
    newest = sessions.select(place.alias("place")).orderBy(F.desc("place")).limit(most)
    kept, waits = newest.agg(F.min("place")).first()[0], sessions.where(active).agg(F.min(place)).first()[0]
    before = lambda bound: (F.col(used) < bound[0]) | ((F.col(used) == bound[0]) & (F.col(key) < bound[1]))
    for bound in (kept, waits):
        sessions = sessions if bound is None else sessions.where(before(bound))
    return sessions
