"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie end to end in one symbol array. A round
looks up the rank of every adjacent pair, takes the lowest of each pre-token,
and merges all its occurrences in all pre-tokens at once; a pre-token without a
known pair is done, and what is left of it are its tokens. Batches are cut by
text size, so memory is bounded by a batch and its longest text.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
count each; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that are cut into pre-tokens at a time.
BATCH_CHARS = 1 << 20
#: Pre-tokens whose counts a task remembers before it starts anew.
REMEMBERED = 1_000_000
NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b not in (0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Merge table as arrays: sorted pair keys, and the rank and new symbol of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.first = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(pairs), dtype=np.int64)[order]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.special = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for a pair that is never merged."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def surviving(merges: Merges, pieces: list[bytes]) -> np.ndarray:
    """Number of symbols left of each (non-empty) piece when nothing can be merged."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    out = sizes.copy()
    symbols = merges.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    while len(symbols):
        same = owner[:-1] == owner[1:]
        rank = np.append(np.where(same, merges.rank(symbols[:-1], symbols[1:]), NONE), NONE)
        starts = np.flatnonzero(np.append(True, ~same))
        lowest = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        out[owner[starts]] = lengths
        live = np.repeat(lowest < NONE, lengths)
        if not live.any():
            break
        hit = live & (rank == np.repeat(lowest, lengths))
        at = np.flatnonzero(hit)
        # In a run of one repeated symbol every second occurrence overlaps the one before.
        fresh = np.append(True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        symbols[at] = merges.made[rank[at]]
        live[at + 1] = False
        symbols, owner = symbols[live], owner[live]
    return out


def count_batches(batches: Iterator[pd.Series], merges: Merges) -> Iterator[pd.Series]:
    """Token counts of each batch of texts."""
    cut = regex.compile(public_tokenizers.PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
    known: dict[str, int] = {}

    def counts(texts: list[str]) -> list[int]:
        pieces, extra = [], []
        for text in texts:
            parts = special.split(text) if special else [text]
            extra.append(len(parts) - 1)
            pieces.append([p for part in parts for p in cut(part)])
        new = list({p for ps in pieces for p in ps if p not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({p for ps in pieces for p in ps})
        if new:
            known.update(zip(new, surviving(merges, [p.encode() for p in new]).tolist(), strict=True))
        return [sum(map(known.__getitem__, ps)) + e for ps, e in zip(pieces, extra, strict=True)]

    for batch in batches:
        out: list[int] = []
        held: list[str] = []
        size = 0
        for text in batch:
            held.append(text or "")
            size += len(held[-1])
            if size >= BATCH_CHARS:
                out += counts(held)
                held, size = [], 0
        out += counts(held)
        yield pd.Series(out, index=batch.index, dtype="int64")


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text."""
    merges = docs.sparkSession.sparkContext.broadcast(Merges(vocabulary or public_tokenizers.path("byte_bpe_50k.json")))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from count_batches(batches, merges.value)

    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
