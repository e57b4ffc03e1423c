"""Server-sent events: decoding of chunked streams and the order of their events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.streaming.chat import payloads

# Allowed successors in a stream; "" is its beginning.
NEXT = {
    "": ("meta", "error"), "meta": ("chunk", "fallback", "sources", "error"), "chunk": ("chunk", "fallback", "sources", "error"),
    "fallback": ("chunk", "sources", "error"), "sources": ("done", "error"), "done": (), "error": (),
}


def sample_stream(conversations: DataFrame) -> DataFrame:
    """Streams made of conversations: meta, a chunk per turn but the last, sources, done, cut into uneven network pieces."""
    event = lambda kind, text=None: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit(kind).alias("type"), *([text.alias("content")] if text is not None else []))), F.lit("\r\n\r\n"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", event("chunk", F.col("text")).alias("e")))).alias("s"))
    body = F.array_join(F.slice(F.transform("s", lambda x: x["e"]), 2, 1_000_000), "")
    whole = F.concat(event("meta"), body, event("sources"), event("done"))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length("w") / 37).cast("int") - 1), lambda i: F.struct(i.alias("seq"), F.substring("w", i * 37 + 1, F.lit(37)).alias("data")))
    return rows.select("conv_id", whole.alias("w")).select("conv_id", F.explode(pieces).alias("p")).select("conv_id", "p.seq", "p.data")


def decode(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """Events (key, pos, type, payload) of each stream, whatever the cuts between its pieces; a stream is one reply.

    A task goes through the pieces of one stream after another and holds what
    no event has ended yet, so a stream of any length passes by.
    """
    rows = chunks.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(data).cast("binary").alias("_data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rest, pos = None, b"", 0
        for batch in batches:
            out = []
            for k, piece in zip(batch["_key"], batch["_data"], strict=True):
                if k != now:
                    out += [(now, pos + i, p) for i, p in enumerate(payloads(rest, final=True)[0])]
                    now, rest, pos = k, b"", 0
                found, rest = payloads(rest + (piece or b""))
                out += [(now, pos + i, p) for i, p in enumerate(found)]
                pos += len(found)
            yield pd.DataFrame(out, columns=["_key", "pos", "payload"])
        yield pd.DataFrame([(now, pos + i, p) for i, p in enumerate(payloads(rest, final=True)[0])], columns=["_key", "pos", "payload"])

    kind = rows.select("_key").schema.add("pos", "integer").add("payload", "string")
    events = rows.where("_key is not null").repartition("_key").sortWithinPartitions("_key", "_order").mapInPandas(run, kind)
    return events.select(F.col("_key").alias(key), "pos", F.coalesce(F.get_json_object("payload", "$.type"), F.lit("malformed")).alias("type"), "payload")


def checked(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Whether each stream keeps the order of events, and its first problem; events are compared with the one before, not gathered."""
    before = F.coalesce(F.lag(kind).over(W.partitionBy(key).orderBy(order)), F.lit(""))
    allowed = F.create_map(*(F.lit(x) for k, v in NEXT.items() for x in (k, ",".join(v))))
    fits = F.find_in_set(F.col(kind), F.coalesce(F.try_element_at(allowed, before), F.lit(""))) > 0
    said = F.concat(F.col(kind), F.lit(" after "), F.when(before == "", "start").otherwise(before))
    rows = events.select(key, order, kind, F.when(~fits, said).alias("_wrong"))
    found = rows.groupBy(key).agg(F.min_by("_wrong", F.when(F.col("_wrong").isNotNull(), F.col(order))).alias("wrong"), F.max_by(kind, order).alias("last"))
    problem = F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("last").isin("done", "error"), "").otherwise("no end")
    return found.select(key, problem.alias("problem")).select(key, (F.col("problem") == "").alias("ok"), "problem")


def idle_gaps(events: DataFrame, key: str, at: str, seconds: int = 70) -> DataFrame:
    """Streams that fell silent for longer than allowed."""
    return events.groupBy(key, F.session_window(at, f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg((F.count(F.lit(1)) > 1).alias("timed_out"))
