"""Conversation state: a turn enters the history when its stream has ended well, not before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def trimmed(history: list[tuple[str, str]], turns: int, chars: int) -> list[tuple[str, str]]:
    """The newest whole turns (question, answer) within both limits."""
    kept, left = [], chars
    for turn in reversed(history[-turns:]):
        left -= len(turn[0]) + len(turn[1])
        if left < 0:
            break
        kept.append(turn)
    return kept[::-1]


def advance(history: list[tuple[str, str]], open_turn: list[str] | None, kind: str, text: str, turns: int, chars: int):
    """History and open turn (question, answer so far) after one event.

    ``question`` opens a turn, ``chunk`` adds to its answer, ``fallback`` starts
    the answer anew, ``done`` commits the turn, ``error`` drops it.
    """
    if kind == "question":
        return history, [text, ""]
    if open_turn is None:
        return history, None
    if kind == "chunk":
        return history, [open_turn[0], open_turn[1] + text]
    if kind == "fallback":
        return history, [open_turn[0], ""]
    if kind == "done":
        return trimmed([*history, (open_turn[0], open_turn[1])], turns, chars), None
    return history, None


class Conversations(StatefulProcessor):
    """Committed history and open turn of each conversation; emits the number of turns after every commit."""

    def __init__(self, turns: int, chars: int):
        self.turns, self.chars = turns, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "question string, answer string")
        self.open_turn = handle.getValueState("open_turn", "question string, answer string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        history = [tuple(r) for r in self.history.get()] if self.history.exists() else []
        turn = list(self.open_turn.get()) if self.open_turn.exists() else None
        for batch in rows:
            out = []
            for r in batch.sort_values("seq").itertuples():
                history, turn = advance(history, turn, r.type, r.text or "", self.turns, self.chars)
                if r.type == "done":
                    out.append((key[0], r.seq, len(history)))
            yield pd.DataFrame(out, columns=["conv_id", "seq", "turns"])
        self.history.put(history) if history else self.history.clear()
        self.open_turn.update(tuple(turn)) if turn else self.open_turn.clear()

    def close(self) -> None:
        pass


def conversation_stream(events: DataFrame, turns: int = 10, chars: int = 12_000) -> DataFrame:
    """A stream (conv_id, seq, type, text) to (conv_id, seq, turns); needs the RocksDB state store."""
    return events.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=Conversations(turns, chars), outputStructType="conv_id long, seq long, turns long", outputMode="append", timeMode="none"
    )
