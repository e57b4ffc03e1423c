"""Language ID: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of a lower-cased text in which every ASCII
character but letters is a blank. A text is the average of its subwords'
embedding rows; embeddings and softmax are trained together by stochastic
gradient descent in numpy on about ``per_language`` documents at most of each
language and about ``SAMPLE`` in all, picked by hash. As both are linear, a
trained model is one row of class scores per bucket, and a text's scores are the
average of those rows. A fifth of the sample is not trained on: it sets the
temperature of the softmax, and the score below which an answer is ``rejected``,
the least one from which on ``PRECISION`` of the answers are right.

Learned from documents whose crc32(doc_id as text) mod 5 is not 0.

Defined results: ``und`` with score 0 for null texts and texts without a letter;
a document without doc_id is held out; repeated rows are each answered; without
any labelled language every answer is ``und``; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable, share_of
from lectern.llm.shingles import by_size

NGRAMS = (2, 3, 4)
BITS = 12
BUCKETS = 1 << BITS
WIDTH = 16
#: Documents to learn from, about so many at most of a language, and of all languages: what reaches the driver is no more.
PER_LANGUAGE, SAMPLE = 600, 8_000
#: Share of right answers among those that are not rejected.
PRECISION = 0.99
EPOCHS = 15
ENTRY = np.dtype([("bucket", "<u2"), ("share", "<f4")])
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[65:91] += 32
_BLANK[[b for b in range(128) if not chr(b).isalpha()]] = 32


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram from each byte on (BUCKETS where there is none), and where texts begin."""
    data = _BLANK[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    starts = ends - np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    letters = np.concatenate(([0], np.cumsum(data != 32)))
    room = np.repeat(ends, ends - starts) - np.arange(len(data))
    for n in NGRAMS:
        size = len(data) - n + 1
        out = np.full(len(data), BUCKETS, dtype=np.int32)
        if size > 0:
            h = np.full(size, n, dtype=np.uint32)
            for i in range(n):
                h = (h ^ data[i : i + size]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            good = (room[:size] >= n) & (letters[n:] > letters[:size])
            out[:size] = np.where(good, (h >> np.uint32(32 - BITS)).astype(np.int32), BUCKETS)
        yield out, starts


def bag(text: str) -> np.ndarray:
    """Number and share of the buckets that a text has, as rows of a little-endian record array."""
    counts = np.zeros(BUCKETS + 1)
    for part in by_size([(text or "").encode()]):
        for buckets, _ in windows(part):
            counts += np.bincount(buckets, minlength=BUCKETS + 1)
    held = np.flatnonzero(counts[:BUCKETS])
    return np.array(list(zip(held.tolist(), (counts[held] / counts[held].sum()).tolist(), strict=True)), dtype=ENTRY)


def least_accepted(score: np.ndarray, right: np.ndarray) -> float:
    """The least score from which on ``PRECISION`` of the answers are right; above all scores if there is none."""
    order = np.argsort(-score, kind="stable")
    score, right = score[order], right[order]
    good = np.cumsum(right) >= PRECISION * np.arange(1, len(score) + 1)
    # Answers of one score are accepted together.
    good &= np.append(score[1:] != score[:-1], True)
    return float(score[np.flatnonzero(good)[-1]]) if good.any() else float(np.nextafter(score.max(), 2))


class Model:
    """Class scores per bucket, their offsets, temperature and the least score of an accepted answer."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray, check: np.ndarray, seed: int = 1):
        self.names = names
        rng = np.random.default_rng(seed)
        k = len(names)
        embed = rng.normal(0, 1.0, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH**0.5
        soft, bias = np.zeros((WIDTH, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
        scale = np.float32(BUCKETS**0.5)  # of an average of rows, which is small
        fit = np.flatnonzero(~check) if (~check).any() else np.arange(len(y))
        steps = 0
        total = max(1, EPOCHS * max(1, len(fit) // 32))
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
                rate = 0.2 * (1 - steps / total)
                steps += 1
                xb = x[at] * scale
                hidden = xb @ embed
                z = hidden @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(at)), y[at]] -= 1
                p /= max(len(at), 1)
                back = p @ soft.T
                soft -= rate * (hidden.T @ p)
                bias -= rate * p.sum(0)
                embed -= rate * (xb.T @ back)
        self.table = np.vstack((scale * (embed @ soft), np.zeros((1, k), dtype=np.float32)))
        self.bias = bias
        self.temperature, self.least = 1.0, 0.0
        test = np.flatnonzero(check)
        if len(test):
            z = x[test] @ self.table[:BUCKETS] + bias
            loss = {t: -np.log(np.maximum(self.soft(z / t)[np.arange(len(test)), y[test]], 1e-12)).mean() for t in np.geomspace(0.25, 8, 41)}
            self.temperature = float(min(loss, key=loss.get))
            p = self.soft(z / self.temperature)
            self.least = least_accepted(p.max(1), p.argmax(1) == y[test])

    @staticmethod
    def soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def answers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language of each text and its probability."""
        total, count = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for buckets, starts in windows(texts):
            count += np.add.reduceat(buckets < BUCKETS, starts)
            for k in range(len(self.names)):
                total[:, k] += np.add.reduceat(self.table[:, k][buckets], starts, dtype=np.float64)
        p = self.soft((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
        return p.argmax(1), p.max(1)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from about ``per_language`` documents at most of each language that are not held out."""
    known = docs.where("lang is not null and text is not null").where(~held_out()).select("doc_id", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    per_language = min(per_language, max(1, SAMPLE // len(counts)))
    # A hash picks about the wanted number of every language, wherever its rows lie.
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    picked = known.where(share_of(shares[F.col("lang")], "doc_id"))
    picked = durable(picked.dropDuplicates(["doc_id"]).withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))))

    @F.pandas_udf("binary")
    def bags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([bag(t).tobytes() for t in batch], index=batch.index, dtype=object)

    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    data = sorted(texts.select("place", "lang", "doc_id", bags("text").alias("bag")).collect())
    if not data:
        return None
    names = sorted({r["lang"] for r in data}, key=str.encode)
    index = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(data), BUCKETS), dtype=np.float32)
    for row, r in zip(x, data, strict=True):
        held = np.frombuffer(r["bag"], dtype=ENTRY)
        row[held["bucket"]] = held["share"]
    return Model(names, x, np.array([index[r["lang"]] for r in data]), np.array([r["place"] % 5 == 0 for r in data]))


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))

    @F.pandas_udf("struct<lang:string,score:double,rejected:boolean>")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            best, score = [], []
            for texts in by_size([(t or "").encode() for t in batch]) if model else ():
                a, b = model.answers(texts)
                best += a.tolist()
                score += b.tolist()
            if model is None:
                yield pd.DataFrame({"lang": ["und"] * len(batch), "score": [0.0] * len(batch), "rejected": [True] * len(batch)})
            else:
                yield pd.DataFrame({"lang": [model.names[i] for i in best], "score": score, "rejected": [s < model.least for s in score]})

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out().alias("held_out"), lettered.alias("lettered"), answer("text").alias("a"))
    return rows.select(
        "doc_id", "held_out", F.when(F.col("lettered"), F.col("a.lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.col("a.score")).otherwise(0.0).alias("score"), (F.col("a.rejected") | ~F.col("lettered")).alias("rejected"),
    )
