"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct word shingles. An item of
``q`` shingles is contained if at least ``ceil(t * q)`` of them occur in a
document, so at most ``q - ceil(t * q)`` are missing, and one of any one more is
found. The ``b`` smallest hashes of an item are its signature, ``b`` set for the
largest item of its partition. A sketch of a long document would hide a short
item, so the document side is not sketched: all its shingle hashes are probed
against the signatures, which leaves no contained item out. Candidates are
verified by exact containment of shingles of words.

Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII
letters lower-cased. Items of fewer than five words are one shingle of all their
words; items without words match nothing.

Defined results: null text has no words; repeated rows are reported each; items
with equal texts are reported each; other columns are ignored; empty tables give
no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable, named
from lectern.llm.shingles import Powers, Words, by_size, shingle_hashes

SIZE = 5
#: Benchmark text up to which the items go to every task; beyond it hashes are joined.
BROADCAST_BYTES = 32 << 20
#: Groups that the candidates of one document are dealt over.
PARTS = 8
FOUND = "array<struct<item_id:long,shared:long,shingles:long>>"
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def needed(count: int, threshold: float) -> int:
    """Shingles of ``count`` that a document must have."""
    return max(1, math.ceil(threshold * count - 1e-9))


def signatures(items: list[tuple[int, str]], threshold: float) -> list[dict]:
    """For each partition (shingle length, size class): sorted signature hashes and the item of each, and the least number of words of a document."""
    powers, parts = Powers(), {}
    for item_id, text in items:
        words = words_of(text)
        size = min(SIZE, len(words))
        if not size:
            continue
        raw = Words([text.encode()], punctuation=False)
        hashes = np.unique(shingle_hashes(raw.hashes(powers), size))
        parts.setdefault((size, len(hashes).bit_length()), []).append((item_id, hashes))
    out = []
    for (size, _), members in sorted(parts.items()):
        largest, least = max(len(h) for _, h in members), min(len(h) for _, h in members)
        b = largest - needed(largest, threshold) + 1
        keys = np.concatenate([h[:b] for _, h in members])
        owner = np.concatenate([np.full(min(b, len(h)), i) for i, h in members])
        order = np.argsort(keys, kind="stable")
        out.append({"size": size, "least": needed(least, threshold), "keys": keys[order], "owner": owner[order]})
    return out


def verified(text: str, candidates: dict[int, set], size: int, threshold: float) -> list[dict]:
    """Of the candidates (item to shingle set), those that ``text`` contains."""
    here = shingle_set(words_of(text), size)
    found = []
    for item, shingles in sorted(candidates.items()):
        shared = len(shingles & here)
        if shared >= needed(len(shingles), threshold):
            found.append({"item_id": item, "shared": shared, "shingles": len(shingles)})
    return found


def finder(spark, items: list[tuple[int, str]], threshold: float):
    """A column function: the items that a text contains."""
    texts_by_place = [t for _, t in items]
    index = spark.sparkContext.broadcast((signatures(list(enumerate(texts_by_place)), threshold), texts_by_place, [i for i, _ in items]))

    @F.pandas_udf(FOUND)
    def contained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts, texts_of, ids = index.value
        powers, sets = Powers(), {}

        def shingles(item: int, size: int) -> set:
            if item not in sets:
                sets[item] = shingle_set(words_of(texts_of[item]), size)
            return sets[item]

        seen = [np.zeros(1 << 16, dtype=bool) for _ in parts]
        for p, bits in zip(parts, seen, strict=True):
            bits[(p["keys"] & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            out: list[list[dict]] = []
            for texts in by_size([(t or "").encode() for t in batch]):
                words = Words(texts, punctuation=False)
                hashes, made = words.hashes(powers), {}
                found: list[dict[int, set[int]]] = [{} for _ in texts]  # shingle length to candidates
                for p, bits in zip(parts, seen, strict=True):
                    if p["size"] not in made:
                        made[p["size"]] = shingle_hashes(hashes, p["size"])
                    h = made[p["size"]]
                    at = np.flatnonzero(bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
                    lo, hi = (np.searchsorted(p["keys"], h[at], side) for side in ("left", "right"))
                    at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
                    text = np.searchsorted(words.last, at, side="right")
                    whole = (at + p["size"] <= words.last[text]) & (words.last[text] - words.first[text] >= p["least"])
                    for t, a, b in zip(text[whole].tolist(), lo[whole].tolist(), hi[whole].tolist(), strict=True):
                        found[t].setdefault(p["size"], set()).update(p["owner"][a:b].tolist())
                for t, groups in enumerate(found):
                    text = texts[t].decode() if groups else ""
                    out.append([x | {"item_id": ids[x["item_id"]]} for size, c in groups.items() for x in verified(text, {i: shingles(i, size) for i in c}, size, threshold)])
            yield pd.Series(out, index=batch.index, dtype=object)

    return contained


def joined_leaks(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """What ``finder`` gives, for benchmarks of any size: signatures and shingle hashes meet in a join.

    ``docs`` has a column ``row`` that names its rows, ``items`` a column ``key``
    that names its rows, so that items of one id stay apart. A document's text
    goes once to each of ``PARTS`` groups of its candidates, which tell it from each of them.
    """

    def item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in signatures([(i, t or "") for i, t in zip(batch["key"], batch["text"], strict=True)], threshold):
                yield pd.DataFrame({"key": p["owner"], "size": p["size"], "hash": p["keys"].view(np.int64)})

    signed = items.select("key", "text").mapInPandas(item_rows, "key long, size int, hash long")
    sizes = [r[0] for r in signed.select("size").distinct().collect()]

    def doc_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                hashes = Words([(text or "").encode()], punctuation=False).hashes(powers)
                for size in sizes:
                    made = np.unique(shingle_hashes(hashes, size))
                    yield pd.DataFrame({"row": row, "size": size, "hash": made.view(np.int64)})

    probes = docs.select("row", "text").mapInPandas(doc_rows, "row long, size int, hash long")
    part = F.pmod("key", F.lit(PARTS)).cast("int").alias("part")
    pairs = durable(probes.join(signed, ["size", "hash"]).select("row", "key", "size", part).distinct())
    asked = pairs.join(items.select("key", "item_id", F.col("text").alias("item")), "key")
    texts = pairs.select(F.col("row").alias("held"), F.col("part").alias("place")).distinct().join(docs.select(F.col("row").alias("held"), "text"), "held")

    def check(held: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out, here = [], {}
        words = words_of(held["text"].iloc[0]) if len(held) else []
        for size, item_id, item in zip(candidates["size"], candidates["item_id"], candidates["item"], strict=True):
            if size not in here:
                here[size] = shingle_set(words, size)
            wanted = shingle_set(words_of(item), size)
            shared = len(wanted & here[size])
            if shared >= needed(len(wanted), threshold):
                out.append((int(held["held"].iloc[0]), item_id, shared, len(wanted)))
        return pd.DataFrame(out, columns=["row", "item_id", "shared", "shingles"])

    found = texts.groupBy("held", "place").cogroup(asked.groupBy("row", "part")).applyInPandas(check, "row long, item_id long, shared long, shingles long")
    return found.groupBy("row").agg(F.collect_list(F.struct("item_id", "shared", "shingles")).cast(FOUND).alias("leaks"))


def with_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with a column ``leaks``: the items that each text contains, with shared and all shingles."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    held = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if held <= broadcast_bytes:
        found = finder(docs.sparkSession, [tuple(r) for r in items.collect()], threshold)
        return docs.withColumn("leaks", found("text"))
    rows = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    # Numbers of rows, written down so that they stay what they are.
    items = durable(items.withColumn("key", F.monotonically_increasing_id()))
    found = joined_leaks(rows.select("row", "text").dropDuplicates(["row"]), items, threshold)
    return rows.join(found, "row", "left").drop("row").withColumn("leaks", F.coalesce("leaks", F.array().cast(FOUND)))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, shared, shingles, containment."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, threshold).select("doc_id", F.explode("leaks").alias("l"))
    return found.select("doc_id", "l.item_id", "l.shared", "l.shingles", (F.col("l.shared") / F.col("l.shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that contain no item, with their own columns."""
    held = docs.columns
    inner = docs.select("text", F.struct(*map(named, docs.columns)).alias("kept"), "doc_id")
    clean = with_leaks(inner, benchmark, threshold).where(F.size("leaks") == 0)
    return clean.select(*(F.col("kept").getField(c).alias(c) for c in held))
