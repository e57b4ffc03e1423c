"""Chat replies as one stream: network pieces are decoded, their events checked, and a turn is committed when its reply has ended well.

Input rows (conv_id, seq, at, kind, data): ``question`` opens a turn, ``bytes``
is a piece of the reply, cut anywhere, also inside a character, ``close`` the
end of the connection. ``seq`` counts the rows of a conversation from 0; rows
that come early wait for those before them, and rows that come again are
dropped. Output is a row for each turn that ends: committed, broken off by an error
event, by the connection, by a breach of the protocol or by a time limit; and one for each
conversation that is forgotten.

``ChatState`` is the state of one conversation and knows neither Spark nor
clocks. ``chat_stream`` keeps it in a state store with timers; ``replayed`` runs
it over a finished log, in order of each key, without gathering a key.

Time limits follow the rows' own clock and the watermark (``eventTime``), or the
machine's (``processingTime``), where Spark's state TTL forgets histories.
A conversation with an open turn isn't forgotten. All that stays of a forgotten
one is the number of its next row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from lectern.streaming.conversation import trimmed

INPUT = "conv_id long, seq long, at timestamp, kind string, data binary"
OUTPUT = "conv_id long, seq long, outcome string, detail string, question string, answer string, turns long"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
BLOCK_END = re.compile(rb"\r?\n\r?\n")
TAG = re.compile("<think>", re.I | re.A)
END_TAG = re.compile("</think>", re.I | re.A)
#: Bytes that an event may have before its end has come.
LONGEST = 4 << 20


class ThoughtFilter:
    """Takes <think> blocks out of a text that comes in pieces; holds back what may be the beginning of a tag."""

    def __init__(self, tail: str = "", inside: bool = False):
        self.tail, self.inside = tail, inside

    def push(self, text: str, final: bool = False) -> str:
        rest, out = self.tail + text, []
        while True:
            tag = END_TAG if self.inside else TAG
            met = tag.search(rest)
            if not met:
                break
            if not self.inside:
                out.append(rest[: met.start()])
            rest, self.inside = rest[met.end() :], not self.inside
        held = 0 if final else next((k for k in range(min(len(rest), len(tag.pattern) - 1), 0, -1) if tag.pattern.startswith(rest[-k:].lower()) and rest[-k:].isascii()), 0)
        if not self.inside:
            out.append(rest[: len(rest) - held])
        self.tail = rest[len(rest) - held :] if held else ""
        return "".join(out)


def payloads(buffer: bytes, final: bool = False) -> tuple[list[str], bytes]:
    """Payloads of the whole event blocks of a buffer, and what is left of it."""
    out, at = [], 0
    for end in BLOCK_END.finditer(buffer):
        out.append(buffer[at : end.start()])
        at = end.end()
    rest = buffer[at:]
    if final and rest.strip():
        out, rest = [*out, rest], b""
    lines = ([x[5:].removeprefix(" ") for x in re.split(r"\r?\n", block.decode("utf-8", "replace")) if x.startswith("data:")] for block in out)
    return ["\n".join(x).strip() for x in lines if x], rest


class Limits(NamedTuple):
    """Of a history, in turns and characters, and of time, in milliseconds: for the first event, between events, and for an idle conversation (None: for ever)."""

    turns: int
    chars: int
    first: int
    idle: int
    keep: int | None


@dataclass
class ChatState:
    """One conversation: the undecoded rest of its bytes, the open turn with what its events have said, and the committed history."""

    expected: int = 0
    due: int | None = None
    buffer: bytes = b""
    question: str | None = None
    answer: str = ""
    seen: list[str] = field(default_factory=list)
    provider: str | None = None
    may_fall_back: bool = False
    reason: str | None = None
    tail: str = ""
    inside: bool = False
    history: list[tuple[str, str]] = field(default_factory=list)

    @property
    def open(self) -> bool:
        return self.question is not None

    def end(self, outcome: str, detail: str = "") -> tuple[str, str, str, str]:
        """The turn is over; what is left of its bytes is of no use."""
        out = (outcome, detail, self.question or "", self.answer)
        self.question, self.answer, self.buffer, self.seen = None, "", b"", []
        self.provider, self.may_fall_back, self.reason, self.tail, self.inside = None, False, None, "", False
        return out

    def event(self, payload: str, limits: Limits) -> tuple[str, str, str, str] | None:
        """Take one event; the end of the turn, if it is that."""
        try:
            said = json.loads(payload)
        except ValueError:
            return self.end("problem", "malformed event" if payload else "empty event")
        kind = said.get("type") if isinstance(said, dict) else None
        if not isinstance(kind, str):
            return self.end("problem", "event without a type")
        seen, broken = self.seen, self.end
        fell_back = "fallback" in seen
        if kind == "error":
            known = {"provider": self.provider, "fallback_used": fell_back, "fallback_reason": self.reason}
            contradicts = "meta" in seen and any(said[k] != known[k] for k in known if k in said)
            return broken("problem", "error contradicts the reply") if contradicts else broken("error", str(said.get("message") or ""))
        if kind not in ("meta", "chunk", "fallback", "sources", "done"):
            return broken("problem", f"unknown event {kind}")
        if (kind == "meta") == ("meta" in seen) or ("sources" in seen) != (kind == "done"):
            return broken("problem", f"{kind} out of order")
        if kind == "meta":
            self.provider, self.may_fall_back = said.get("provider"), said.get("fallback_available") is True
        elif kind == "chunk":
            if not isinstance(said.get("content"), str) or not said["content"]:
                return broken("problem", "chunk without text")
            thoughts = ThoughtFilter(self.tail, self.inside)
            self.answer += thoughts.push(said["content"])
            self.tail, self.inside = thoughts.tail, thoughts.inside
        elif kind == "fallback":
            if fell_back or not self.may_fall_back or said.get("from") != self.provider:
                return broken("problem", "fallback out of order")
            # The new provider answers from the beginning.
            self.provider, self.reason, self.answer, self.tail, self.inside = said.get("to"), said.get("reason"), "", "", False
            self.seen = [x for x in seen if x != "chunk"]
        elif kind == "sources":
            if "chunk" not in seen:
                return broken("problem", "sources out of order")
            self.answer += ThoughtFilter(self.tail, self.inside).push("", final=True)
        else:
            if said.get("provider") != self.provider or said.get("fallback_used") is not fell_back or said.get("fallback_reason") != self.reason:
                return broken("problem", "done contradicts the reply")
            self.history = trimmed([*self.history, (self.question or "", self.answer)], limits.turns, limits.chars)
            return self.end("commit")
        if kind not in self.seen:
            self.seen.append(kind)
        return None

    def expire(self, now: int, limits: Limits) -> Iterator[tuple[str, str, str, str, int]]:
        """What time limits have ended by ``now``."""
        while self.due is not None and self.due < now:
            if self.open:
                yield (*self.end("timeout", "no event in time" if self.seen else "no first event in time"), len(self.history))
                self.due = None if limits.keep is None else self.due + limits.keep
            else:
                yield ("forgotten", "", "", "", len(self.history))
                self.history, self.due = [], None

    def take(self, kind: str, data: bytes | None, now: int, limits: Limits) -> Iterator[tuple[str, str, str, str, int]]:
        """Take the next row; the ends of turns that it brings, each with the number of turns held then."""
        yield from self.expire(now, limits)
        self.expected += 1
        for end in self.ends(kind, data or b"", limits):
            yield (*end, len(self.history))
        wait = (limits.idle if self.seen else limits.first) if self.open else limits.keep
        self.due = None if wait is None else now + wait

    def ends(self, kind: str, data: bytes, limits: Limits) -> Iterator[tuple[str, str, str, str]]:
        if kind == "question":
            if self.open:
                yield self.end("superseded")
            self.question = data.decode("utf-8", "replace")
            return
        if not self.open:
            return  # what comes after a turn's end says nothing
        found, self.buffer = payloads(self.buffer + data, kind == "close")
        for payload in found:
            done = self.event(payload, limits)
            if done:
                yield done
                return
        if len(self.buffer) > LONGEST:
            yield self.end("problem", "event too long")
        elif kind == "close":
            yield self.end("early end")


class Chats(StatefulProcessor):
    """``ChatState`` in a state store, and a timer for when it is due."""

    def __init__(self, limits: Limits, clock: str):
        self.by_rows = clock == "eventTime"
        # On the machine's clock Spark forgets.
        self.limits, self.keep = limits if self.by_rows else limits._replace(keep=None), limits.keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", "question string, answer string", None if self.by_rows else self.keep)
        self.turn = handle.getValueState("turn", "expected long, due long, buffer binary, open string")
        self.early = handle.getMapState("early", "seq long", "kind string, data binary, at long")

    def load(self) -> ChatState:
        history = [tuple(r) for r in self.history.get()] if self.history.exists() else []
        if not self.turn.exists():
            return ChatState(history=history)
        expected, due, buffer, held = self.turn.get()
        return ChatState(expected=expected, due=due, buffer=bytes(buffer), history=history, **json.loads(held))

    def save(self, state: ChatState, timer: int | None) -> None:
        held = {k: v for k, v in asdict(state).items() if k not in ("expected", "due", "buffer", "history")}
        self.turn.update((state.expected, state.due, state.buffer, json.dumps(held)))
        # Putting it again also keeps the history of an open turn from running out.
        self.history.put(state.history) if state.history else self.history.clear()
        if timer != state.due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if state.due is not None:
                self.handle.registerTimer(state.due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = self.load(), []
        timer, held = state.due, {k[0]: tuple(v) for k, v in self.early.iterator()} if self.early.exists() else {}
        waiting = set(held)
        for batch in rows:
            for r in batch.itertuples():
                if r.seq >= state.expected:
                    held.setdefault(int(r.seq), (r.kind, r.data, int(r.at.value // 1_000_000)))
                # Whatever is next in order, as long as it is there.
                while state.expected in held:
                    seq = state.expected
                    kind, data, at = held.pop(seq)
                    now = at if self.by_rows else timerValues.getCurrentProcessingTimeInMs()
                    out += [(key[0], seq - (end[0] in ("timeout", "forgotten")), *end) for end in state.take(kind, data, now, self.limits)]
        for seq in waiting - set(held):
            self.early.removeKey((seq,))
        for seq in set(held) - waiting:
            self.early.updateValue((seq,), held[seq])
        self.save(state, timer)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, now = self.load(), expiredTimerInfo.getExpiryTimeInMs()
        out = [(key[0], state.expected - 1, *end) for end in state.expire(now + 1, self.limits)]
        self.save(state, None if state.due is None or state.due > now else state.due)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def chat_stream(pieces: DataFrame, turns: int = 10, chars: int = 12_000, first: int = 70, idle: int = 70, keep: int = 86_400, clock: str = "eventTime", late: str = "0 seconds") -> DataFrame:
    """A stream of pieces to a stream of ended turns; limits in seconds. Needs the RocksDB state store."""
    if clock not in ("eventTime", "processingTime"):
        raise ValueError("clock is eventTime or processingTime")
    limits = Limits(turns, chars, 1000 * first, 1000 * idle, 1000 * keep)
    rows = pieces.withWatermark("at", late) if clock == "eventTime" else pieces
    return rows.select("conv_id", "seq", "at", "kind", "data").groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=Chats(limits, clock), outputStructType=OUTPUT, outputMode="append", timeMode=clock
    )


def replayed(pieces: DataFrame, turns: int = 10, chars: int = 12_000, first: int = 70, idle: int = 70, keep: int = 86_400) -> DataFrame:
    """What ``chat_stream`` gives for a finished log on the rows' clock, but for what would still happen after its last row.

    A task holds the state of one conversation at a time, however long its log is.
    Rows of a number already seen are dropped; after a missing number the rest of the conversation waits for ever.
    """
    rows = pieces.select("conv_id", "seq", F.unix_millis(F.col("at").cast("timestamp")).alias("at"), "kind", "data")

    limits = Limits(turns, chars, 1000 * first, 1000 * idle, 1000 * keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, ChatState()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.conv_id != key:
                    key, state = r.conv_id, ChatState()
                if r.seq == state.expected:
                    out += [(key, r.seq - (end[0] in ("timeout", "forgotten")), *end) for end in state.take(r.kind, r.data, r.at, limits)]
            yield pd.DataFrame(out, columns=COLUMNS)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInPandas(run, OUTPUT)


def chat_log(conversations: DataFrame, piece: int = 37) -> DataFrame:
    """Pieces made of conversations (conv_id, turn, role, text): a user's turn asks, the assistant's next one answers.

    One reply in five falls back after its first chunk, one ends in an error,
    one is cut off (of these, one in two after a silence of 100 seconds), one has its thoughts in it, cut inside the tags.
    """
    turns = W.partitionBy("conv_id").orderBy("turn")
    asked = conversations.withColumns({"reply": F.lead("text").over(turns), "by": F.lead("role").over(turns)}).where("role = 'user' and `by` = 'assistant' and reply <> ''")
    event = lambda kind, *more: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit(kind).alias("type"), *more), {"ignoreNullFields": "false"}), F.lit("\r\n\r\n"))
    chunk = lambda text: event("chunk", text.alias("content"))
    a, b = F.lit("one").alias("provider"), F.lit("two").alias("provider")
    done = lambda who, used, why: event("done", who, F.lit(used).alias("fallback_used"), F.lit(why).cast("string").alias("fallback_reason"))
    meta, sources = event("meta", a, F.lit(True).alias("fallback_available")), event("sources")
    back = event("fallback", F.lit("reset").alias("action"), F.lit("one").alias("from"), F.lit("two").alias("to"), F.lit("busy").alias("reason"))
    text, way = F.col("reply"), (F.col("conv_id") + F.col("turn")) % 5
    reply = (
        F.when(way == 1, F.concat(meta, chunk(text), back, chunk(text), sources, done(b, True, "busy")))
        .when(way == 2, F.concat(meta, chunk(text), event("error", F.lit("overloaded").alias("message"))))
        .when(way == 3, F.concat(meta, chunk(text), sources))
        .when(way == 4, F.concat(meta, chunk(F.lit("<think>so</th")), chunk(F.concat(F.lit("ink>"), text, F.lit("<thi"))), sources, done(a, False, None)))
        .otherwise(F.concat(meta, chunk(text), chunk(text), sources, done(a, False, None)))
    ).cast("binary")
    wire = asked.select("conv_id", "turn", ((way == 3) & (F.col("turn") % 4 == 0)).alias("silent"), F.col("text").cast("binary").alias("question"), reply.alias("reply"))
    cut = lambda i: F.substr("reply", i * piece + 1, F.lit(piece))
    pieces = F.ceil(F.octet_length("reply") / piece).cast("int")
    rows = wire.select("conv_id", "turn", "silent", "question", "reply", pieces.alias("pieces"), F.explode(F.sequence(F.lit(-1), pieces)).alias("i"))
    kind = F.when(F.col("i") < 0, "question").when(F.col("i") < F.col("pieces"), "bytes").otherwise("close")
    data = F.when(F.col("i") < 0, F.col("question")).when(F.col("i") < F.col("pieces"), cut(F.col("i")))
    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "i")) - 1
    at = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("turn") * 600_000 + F.col("i") * 10 + F.when(F.col("silent") & (F.col("i") == F.col("pieces")), 100_000).otherwise(0))
    return rows.select("conv_id", seq.cast("long").alias("seq"), at.alias("at"), kind.alias("kind"), data.alias("data"))
