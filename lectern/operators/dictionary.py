"""Phrases in texts: a join of any number of phrases with any number of texts.

A phrase is filed under its first characters, as many as its class of lengths
has; a text asks with the characters at each of its places, once for each class.
Places whose characters no phrase begins with are left out first, by their
hashes in bit maps of a fixed size; what those let through meets on equality and
is compared in full, so a text costs its length, however many phrases there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of lengths: a phrase belongs to the greatest that it reaches. Each is twice the one before.
CLASSES = (1, 2, 4, 8, 16)
#: Characters of a text that are looked through together, and of texts whose hashes are made together.
PIECE, TOGETHER = 1024, 1 << 19
#: Phrase text up to which the dictionary goes to every task.
BROADCAST_BYTES = 16 << 20
#: Bits of a class' map, as a power of two.
BITS = 22


def head_slots(chars: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each class up to ``longest`` the slots, in its bit map, of the characters from each place on."""
    h, base, n = chars.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while n <= longest and len(h):
        yield n, (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = (base * base + 2) % 2**64, 2 * n


def phrase_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (n, head) to (n, word, bits): a word of 64 bits of the bit map of class n."""
    for batch in batches:
        out = []
        for n, head in zip(batch["n"].tolist(), batch["head"].tolist(), strict=True):
            slot = int(dict(head_slots(np.frombuffer(head.encode("utf-32-le"), dtype="<u4"), n))[n][0])
            out.append((n, slot >> 6, int(np.uint64(1 << (slot & 63)).view(np.int64))))
        yield pd.DataFrame(out, columns=["n", "word", "bits"])


def places_of(maps: dict[int, bytes]) -> Callable[[Column], Column]:
    """A function of a piece to its places, below ``PIECE``, whose characters may begin a phrase: place << 5 | class."""

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = {n: np.unpackbits(np.frombuffer(m, dtype=np.uint8), bitorder="little").view(bool) for n, m in maps.items()}
        for batch in batches:
            bodies, out, per = batch.to_list(), [], max(1, TOGETHER // (2 * PIECE))
            for i in range(0, len(bodies), per):
                texts = bodies[i : i + per]
                size = np.array([len(x) for x in texts])
                owner = np.repeat(np.arange(len(texts)), size)
                inside = np.arange(size.sum()) - (np.cumsum(size) - size)[owner]
                # Not from what overlaps the next piece, and not beyond the end of its own.
                room = np.where(inside < PIECE, size[owner] - inside, 0)
                whose, code = [], []
                for n, slots in head_slots(np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4"), max(bits)):
                    if n in bits:
                        at = np.flatnonzero(bits[n][slots] & (room[: len(slots)] >= n))
                        whose.append(owner[at])
                        code.append((inside[at] << 5 | n).astype(np.int32))
                whose, code = np.concatenate([*whose, []]), np.concatenate([*code, np.empty(0, np.int32)])
                order = np.argsort(whose, kind="stable")
                out += np.split(code[order], np.searchsorted(whose[order], np.arange(1, len(texts))))
            yield pd.Series(out, dtype=object)

    return places


def found(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, words: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, phrase, start): every place (from 0) where a phrase is in a text, letters in either case; ``words``: not inside a word of letters and digits.

    Defined results: null and empty phrases are nowhere; equal phrases are one;
    null texts hold none; keys that repeat are searched each.
    """
    terms = phrases.select(F.lower(F.col(phrase)).alias("term"), F.col(phrase).alias("phrase")).where("term <> ''").distinct()
    held = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)), F.collect_set(size_class(F.length("term"))).alias("classes")).first()
    terms = terms.withColumn("n", size_class(F.length("term"))).withColumn("head", F.substr("term", F.lit(1), F.col("n")))
    if not held["classes"]:
        return texts.select(key).limit(0).withColumns({"phrase": F.lit(""), "start": F.lit(0)})
    longest = terms.agg(F.max(F.length("term"))).first()[0]
    # Cut in pieces first, each with what its last phrase may need, as a place in a long text takes time to reach.
    rows = texts.where(F.col(text).isNotNull()).select(key, F.lower(F.col(text)).alias("body"))
    rows = rows.withColumn("from", F.explode(F.sequence(F.lit(0), F.greatest(F.length("body") - 1, F.lit(0)), F.lit(PIECE))))
    before = F.when(F.col("from") > 0, F.substr("body", F.col("from"), F.lit(1))).otherwise("")
    rows = rows.select(key, "from", before.alias("before"), F.substr("body", F.col("from") + 1, F.lit(PIECE + longest)).alias("body"))
    # The maps have one size, whatever the number of phrases.
    maps = {n: np.zeros(1 << (BITS - 6), dtype="<i8") for n in held["classes"]}
    for r in terms.select("n", "head").distinct().mapInPandas(phrase_slots, "n int, word int, bits long").groupBy("n", "word").agg(F.bit_or("bits").alias("bits")).collect():
        maps[r["n"]][r["word"]] = r["bits"]
    rows = rows.withColumn("place", F.explode(places_of({n: m.tobytes() for n, m in maps.items()})("body")))
    rows = rows.withColumns({"at": F.shiftright("place", 5), "n": F.col("place").bitwiseAND(31)})
    before = F.when(F.col("at") > 0, F.substr("body", F.col("at"), F.lit(1))).otherwise(F.col("before"))
    asked = rows.select(key, "n", (F.col("from") + F.col("at")).alias("start"), before.alias("before"), F.substr("body", F.col("at") + 1, F.lit(longest + 1)).alias("piece"))
    asked = asked.withColumn("head", F.substr("piece", F.lit(1), F.col("n")))
    small = F.broadcast if held[0] <= broadcast_bytes else (lambda x: x)
    met = asked.join(small(terms), ["n", "head"]).where(F.startswith("piece", F.col("term")))
    if words:
        after = F.substr("piece", F.length("term") + 1, F.lit(1))
        met = met.where(~F.col("before").rlike("[a-z0-9_]") & ~after.rlike("[a-z0-9_]"))
    return met.select(key, "phrase", "start")


def size_class(n: Column) -> Column:
    out = F.lit(CLASSES[0])
    for c in CLASSES[1:]:
        out = F.when(n >= c, c).otherwise(out)
    return out


def first_found(places: DataFrame, key: str) -> DataFrame:
    """The phrase that comes first in each text, the longest of several at one place."""
    return places.groupBy(key).agg(F.min(F.struct("start", -F.length("phrase"), "phrase")).alias("m")).select(key, "m.phrase", "m.start")


def all_matches(rows: DataFrame, catalogue: DataFrame, by: Column, of: Column) -> DataFrame:
    """Rows with every catalogue row of the same key, such as a normal code; null keys match nothing."""
    return rows.withColumn("_key", by).join(catalogue.withColumn("_key", of), "_key").drop("_key")


def first_match(rows: DataFrame, catalogue: DataFrame, by: Column, of: Column, position: str) -> DataFrame:
    """Rows with the first catalogue row of the same key, by ``position``: each key's is found before rows meet it."""
    rest = [c for c in catalogue.columns]
    first = catalogue.withColumn("_key", of).where("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*rest), position).alias("_m"))
    return rows.withColumn("_key", by).join(first, "_key").drop("_key").select(*rows.columns, *(F.col(f"_m.{c}").alias(c) for c in rest))
