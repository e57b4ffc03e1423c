"""SimHash near-duplicates by pigeonhole blocks.

The 64 bits are cut into ``BLOCKS`` blocks. Fingerprints that differ in at most
``distance`` bits agree on at least ``BLOCKS - distance`` whole blocks, so they
share one of the keys made of so many blocks. Distinct fingerprints are dealt by
those keys, compared inside each key's group, and a spanning forest of the links
found there goes on: never all pairs. A group above ``GROUP`` fingerprints is
cut into chunks that share one of its fingerprints; where that leaves a group in
pieces each pair of its chunks is a task-sized group of its own. Components of
the links are the near-duplicate classes.

Defined results: null and word-less texts have fingerprint zero, linked like any
other; equal texts share a fingerprint and so a class; rows without a doc_id
link nothing and get the class of their fingerprint, null if it has none;
other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lectern.llm.common import durable, release, screened
from lectern.llm.graph import components
from lectern.llm.shingles import Words, by_size

BLOCKS = 7
#: Fingerprints of one key that are compared in one piece.
GROUP = 2048


def fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    """64-bit SimHash of each text's word shingles under XXH64 with seed 42."""
    words = Words(texts, punctuation=True)
    # The words again, one space apart.
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    keep = np.repeat(words.starts - starts, lengths + 1) + np.arange(len(words.starts) + int(lengths.sum()))
    flat = words.data[np.minimum(keep, len(words.data) - 1)] if len(keep) else np.empty(0, dtype=np.uint8)
    flat[ends] = 0x20
    flat = flat.tobytes()
    count = words.last - words.first
    made = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    base = np.cumsum(made) - made
    first = np.arange(int(made.sum())) - np.repeat(base - words.first, made)
    last = np.minimum(first + size, np.repeat(words.last, made)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), dtype="<u8", count=len(first))
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(made)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, base[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > made[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


@F.pandas_udf(LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch]
        parts = [fingerprints(part, 4) for part in by_size(texts)]
        yield pd.Series(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64), index=batch.index)


def masks(distance: int) -> list[int]:
    """For each choice of the blocks that must agree, the bits that they hold, as signed longs."""
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    chosen = [sum(block[i] for i in pick) for pick in combinations(range(BLOCKS), BLOCKS - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def forest(prints: np.ndarray, ids: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Edges that connect what is linked within one group."""
    left = np.arange(len(prints))
    while len(left) > 1:
        frontier, root, left = left[:1], ids[left[0]], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in frontier:
                near |= np.bitwise_count(prints[left] ^ prints[at]) <= distance
            frontier, left = left[near], left[~near]
            for x in ids[frontier]:
                yield root, x


def links_of_runs(distance: int):
    """A mapper over rows (group columns..., fp, rep), each group's rows in a row, to edges."""

    def mapper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def edges(rows: pd.DataFrame) -> pd.DataFrame:
            keys = [rows[c].to_numpy() for c in rows.columns[:-2]]
            prints, ids = rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy()
            new = np.ones(len(rows), dtype=bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(rows)))
            two = starts[sizes == 2]
            two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= distance]
            found = [(u, v) for a, n in zip(starts[sizes > 2], sizes[sizes > 2]) for u, v in forest(prints[a : a + n], ids[a : a + n], distance)]
            more = np.array(found, dtype=np.int64).reshape(-1, 2)
            return pd.DataFrame({"u": np.concatenate((ids[two], more[:, 0])), "v": np.concatenate((ids[two + 1], more[:, 1]))})

        for batch in batches:
            if not len(batch):
                continue
            keys = batch.columns[:-2]
            # The last group may go on in the next batch.
            same = np.all([batch[k].to_numpy() == batch[k].iloc[-1] for k in keys], axis=0)
            cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if cut:
                yield edges(pd.concat([*held, batch[:cut]], ignore_index=True))
                held = []
            elif held and any(held[-1][k].iloc[-1] != batch[k].iloc[-1] for k in keys):
                yield edges(pd.concat(held, ignore_index=True))
                held = []
            held.append(batch[cut:])
        if held:
            yield edges(pd.concat(held, ignore_index=True))

    return mapper


def near_links(prints: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) between the ids of distinct fingerprints (fp, rep) that connect all within ``distance`` bits."""
    key = ["pick", "key"]
    keyed = prints.select("fp", "rep", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(distance)))).alias(*key))
    # Rows of a key are counted where they are read, so a frequent key is no large task.
    groups = durable(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("hub")).where("n > 1"))
    dealt = durable(screened(keyed, groups, *key).join(groups, key))
    release(prints.sparkSession)

    def linked(rows: DataFrame, *by: str) -> DataFrame:
        return rows.select(*by, "fp", "rep").repartition(*by).sortWithinPartitions(*by).mapInPandas(links_of_runs(distance), "u long, v long")

    edges = linked(dealt.where(F.col("n") <= GROUP), *key)
    chunks = F.ceil(F.col("n") / GROUP)
    large = dealt.where(F.col("n") > GROUP).withColumns({"chunks": chunks, "a": F.pmod(F.xxhash64("fp"), chunks)})
    if groups.where(F.col("n") > GROUP).isEmpty():
        return edges
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    # One fingerprint of a large group goes to all of its chunks, so a group of near copies is connected through it.
    hubs = large.where("fp = hub").withColumn("a", every)
    edges = durable(edges.union(linked(large.union(hubs), *key, "a")))
    named = components(edges).select(F.col("node").alias("rep"), "component")
    label = large.join(named, "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    # Only groups that are still in pieces are compared chunk by chunk.
    apart = label.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(*key)
    left = label.join(apart, key, "left_semi").withColumn("b", every)
    pairs = left.select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "fp", "rep")
    return edges.union(linked(pairs, *key, "a", "b"))


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = durable(docs.select("doc_id", fingerprint("text").alias("fp")))
    classes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = components(near_links(classes, distance))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
