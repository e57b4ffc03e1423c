"""Vectorised word and shingle hashes of batches of texts (numpy, runs inside tasks).

A batch is one byte buffer. Word boundaries come from a byte table, the hash of
a word from differences of one running polynomial sum modulo 2**64, and the hash
of a shingle from the hashes of its words, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that are hashed at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
P = 0x9E3779B97F4A7C15 | 1
P_INVERSE = pow(P, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
STEP = np.uint64(0x94D049BB133111EB)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_OTHER = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of each hash spread over the word."""
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * STEP
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, BATCH_BYTES + 1)
            self.up, self.down = np.full(size, P, dtype=np.uint64), np.full(size, P_INVERSE, dtype=np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up[:n], self.down[:n]


class Words:
    """Words of a batch: byte bounds in the lower-cased buffer, text index, and the first word of each text."""

    def __init__(self, texts: Sequence[bytes], punctuation: bool):
        """punctuation: whether ASCII punctuation belongs to words."""
        self.data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        inside = ~(_SPACE if punctuation else _OTHER)[self.data]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.last = np.searchsorted(self.starts, limits)  # of each text, one past its last word
        self.first = np.concatenate(([0], self.last[:-1])).astype(np.int64)

    def hashes(self, powers: Powers) -> np.ndarray:
        up, down = powers.upto(len(self.data) + 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        return mixed((total[self.ends] - total[self.starts]) * down[self.starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size - 1`` have none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = out * STEP + words[i : i + n]
    return mixed(out)


def by_size(texts: Sequence[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of about ``limit`` bytes together."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
