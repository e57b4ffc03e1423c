"""Toxicity: boosted trees over dense text features, with isotonic calibration.

Features are rates of a whole text: words of a general insult lexicon and of a
lexicon learned from labelled texts (words and word beginnings that toxic texts
use far more often), how near a second-person word these stand, capitals,
punctuation, and obfuscated spelling. At most ``sample`` labelled documents,
picked by a hash of doc_id, are used to learn; the lexicon that a training row
is measured with is learned from the other half of them, and calibration uses
margins of models that have not seen the row.

Labels are learned from documents whose crc32(doc_id as text) mod 5 is not 0.

Defined results: null text counts as empty and is scored; a document without
doc_id is held out and scored; repeated rows are scored each; with no label or
one class only the score is the rate of label 1 (0.5 without labels); other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.boosting import Boosted, Isotonic
from lectern.llm.common import durable, share_of

#: Labelled documents to learn from, at most about so many.
SAMPLE = 16_000
#: Lexicon entries to keep, and the least evidence (in standard errors) for one.
LEXICON, EVIDENCE = 4_000, 3.0
PREFIXES = (4, 5, 6, 7)
NEAR = 5
CACHE = 400_000
#: General English insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown "
    "imbecile fool jerk creep freak filth vermin ugly hate shut kill die bastard crap damn hell sucks".split()
)
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")

LETTERS = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"(?<![^\s])[^\s]*[^\W\d_][\d@$!*.\-_]+[^\W\d_][^\s]*")
RUNS = re.compile(r"[!?.*#$%&]{2,}")
UPPER, PUNCTUATION = np.zeros(256, dtype=bool), np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
UPPER[65:91] = True


def beginnings(word: str) -> list[str]:
    """A word's lexicon keys: itself and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


class Weights(dict):
    """Weight of a word under a lexicon, kept for words seen before; -1 marks a second-person word."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        weight = -1.0 if word in SECOND_PERSON else max(map(self.lexicon.get, beginnings(word), [0.0] * (1 + len(PREFIXES))))
        if len(self) > CACHE:
            self.clear()
        self[word] = weight
        return weight


def features(texts: list[str], weights: Weights) -> np.ndarray:
    """One row of features per text."""
    out = np.zeros((len(texts), 17))
    for row, text in zip(out, texts, strict=True):
        data = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
        words = LETTERS.findall(text.lower())
        n, chars = max(len(words), 1), max(int(data.sum()), 1)
        w = np.fromiter(map(weights.__getitem__, words), dtype=np.float64, count=len(words))
        second, hit = np.flatnonzero(w < 0), np.flatnonzero(w > 0)
        general = sum(x in INSULTS for x in words)
        near = 0
        if len(second) and len(hit):
            right = np.searchsorted(second, hit)
            gap = np.minimum(np.abs(second[np.minimum(right, len(second) - 1)] - hit), np.abs(hit - second[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        odd = ODD.findall(text)
        plain = sum(any(x in INSULTS for x in LETTERS.findall(o.lower().translate(LOOKALIKE))) for o in odd)
        strong = w[hit]
        caps = sum(x.isupper() and len(x) > 1 for x in text.split()) if data[65:91].sum() > 0.1 * chars else 0
        row[:] = (
            general / n, np.log1p(general), len(hit) / n, np.log1p(len(hit)), strong.sum() / n, strong.max(initial=0.0),
            np.log1p(len({words[i] for i in hit})), near / n, len(second) / n, data[UPPER].sum() / chars, caps / n,
            data[33] / chars, data[PUNCTUATION].sum() / chars, len(RUNS.findall(text)) / n, len(odd) / n, plain / n, np.log1p(len(words)),
        )
    return out


def lexicon_of(counts: pd.DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Keys by their log odds between toxic and clean texts, those with enough evidence."""
    p, n = counts["toxic"].to_numpy() + 0.5, counts["clean"].to_numpy() + 0.5
    odds = np.log(p / (toxic + 1)) - np.log(n / (clean + 1))
    z = odds / np.sqrt(1 / p + 1 / n)
    best = np.argsort(-z, kind="stable")[:LEXICON]
    best = best[z[best] >= EVIDENCE]
    return dict(zip(counts["key"].to_numpy()[best].tolist(), odds[best].tolist(), strict=True))


def count_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each class and half that have a key, summed over the batch."""
    for batch in batches:
        counts: Counter = Counter()
        for text, toxic, half in zip(batch["text"], batch["toxic"], batch["half"], strict=True):
            keys = {k for w in set(LETTERS.findall((text or "").lower())) for k in beginnings(w)}
            counts.update((k, half, toxic) for k in keys)
        yield pd.DataFrame([(k, h, c if y == 1 else 0, c if y == 0 else 0) for (k, h, y), c in counts.items()], columns=["key", "half", "toxic", "clean"])


class Model:
    """Lexicon, trees and calibration; scores texts."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, steps: Isotonic | None, rate: float):
        self.lexicon, self.trees, self.steps, self.rate = lexicon, trees, steps, rate

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        margin = self.trees.margin(x)
        return 0.999 * self.steps.predict(margin) + 0.001 / (1 + np.exp(-margin))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.toxic`` from at most about ``sample`` labelled documents that are not held out."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(known.count(), 1))
    known = known.where(share_of(share, "doc_id", F.lit(7)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), F.pmod(F.xxhash64("text", F.lit(5)), F.lit(4)).cast("int").alias("fold"))
    rows = durable(rows.dropDuplicates(["text", "toxic"]))
    sizes = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    total = lambda y, halves=(0, 1): sum(sizes.get((h, y), 0) for h in halves)
    rate = total(1) / (total(0) + total(1)) if sizes else 0.5
    if not total(1) or not total(0):
        return Model({}, None, None, rate)
    counts = rows.select("text", "toxic", "half").mapInPandas(count_keys, "key string, half int, toxic long, clean long")
    # A key needs a few toxic texts to have enough evidence.
    counts = counts.groupBy("key").pivot("half", [0, 1]).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).na.fill(0)
    counts = counts.where("`0_toxic` + `1_toxic` >= 3 and `0_toxic` + `1_toxic` > `0_clean` + `1_clean`").toPandas().sort_values("key")
    half = lambda h: counts.rename(columns={f"{h}_toxic": "toxic", f"{h}_clean": "clean"})
    both = counts.assign(toxic=counts["0_toxic"] + counts["1_toxic"], clean=counts["0_clean"] + counts["1_clean"])
    lexicons = [lexicon_of(half(1 - h), total(1, [1 - h]), total(0, [1 - h])) for h in (0, 1)]
    shared = spark.sparkContext.broadcast(lexicons)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = [Weights(x) for x in shared.value]
        for batch in batches:
            x = [features([t or ""], weights[h])[0] for t, h in zip(batch["text"], batch["half"], strict=True)]
            yield pd.DataFrame({"x": [v.tolist() for v in x], "y": batch["toxic"].astype("int32"), "fold": batch["fold"]})

    data = rows.select("text", "toxic", "half", "fold").mapInPandas(measure, "x array<double>, y int, fold int").toPandas()
    x, y, fold = np.array(data["x"].tolist()), data["y"].to_numpy(dtype=np.float64), data["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    margins = np.zeros(len(y))
    for k in range(4):
        if (fold == k).any():
            margins[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicon_of(both, total(1), total(0)), Boosted().fit(x, y), Isotonic().fit(margins, y), rate)


def scorer(spark, model: Model):
    """A column function: score of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = Weights(shared.value.lexicon)
        for batch in batches:
            x = features([t or "" for t in batch], weights)
            yield pd.Series(np.clip(shared.value.scores(x), 0.0, 1.0), index=batch.index)

    return score


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = scorer(docs.sparkSession, train(docs, labels, sample))
    rows = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the model doesn't call toxic, with their own columns."""
    score = scorer(docs.sparkSession, train(docs, labels, sample))
    return docs.where(score("text") < 0.5)
