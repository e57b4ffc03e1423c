"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by a hash of doc_id and text into blocks of about
``block_docs`` documents. A source's target is met by whole passes over its blocks and one
partial pass over a permuted prefix of them; the document at the cut gives only
the words that are still missing. All drawn blocks are then shared among the
output shards: a binary tree over the shards splits the exact per-source block
quotas, each split a multivariate-hypergeometric draw, and every shard takes
the next run of each source's permuted blocks. Rows inside a shard carry a
random ``order_key`` to sort by. What a document gives is what its placements in
shards add up to. ``draw`` makes the mixed corpus of it.

Only one row per source reaches the driver. Windows run over the blocks of a
source (a ``block_docs``-th of its rows) and over the rows of one block, so a
source with most of the corpus makes no large task.

Defined results: null text has size 0; null is a source of its own and sorts
last; repeated rows, and rows of one or no doc_id, count each; a source whose
texts have no words has target 0; ties in the order of blocks and documents go by
their numbers and ids; an empty table gives no rows; other columns of the input
are ignored by ``mix`` and kept by ``draw``. Rows that are equal in doc_id and
text share a block, so a table of mostly such rows makes a large task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.llm.common import WORD, durable, named, parallelism, words_in

#: Rows of the per-source plan up to which it is broadcast (about 200 bytes a row).
BROADCAST_SOURCES = 20_000


class Quota(NamedTuple):
    """Plan of one source."""

    source: str | None
    words: int
    target: float
    blocks: int
    passes: int
    rest: int


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Words of each source: ``share`` of all words by weight, none above ``cap`` times its size.

    What a capped source leaves over is shared again among the others by weight.
    """
    want, limit = share * sum(sizes), [cap * s for s in sizes]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * want / total > limit[i]}
        if not full:
            for i in free:
                out[i] = weights[i] * want / total
            break
        for i in full:
            out[i] = limit[i]
            want -= limit[i]
        free -= full
    return out


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """``shards`` rows of per-source block counts; columns add up to ``quotas``.

    The node of a range of shards draws the blocks of its left half without
    replacement from its own blocks, in proportion to the shards there.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    nodes = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while nodes:
        lo, hi, have = nodes.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        left = int(have.sum()) * (mid - lo) // (hi - lo)
        drawn = rng.multivariate_hypergeometric(have, left, method="marginals")
        nodes += [(mid, hi, have - drawn), (lo, mid, drawn)]
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 16,
    block_docs: int = 512,
    seed: int = 42,
    whole: bool = False,
) -> DataFrame:
    """Mixing plan: doc_id, source, size, source_size, target, taken, placements.

    Sources in code-point order, null last, get ``weights`` in turn.
    ``placements`` lists, per pass that takes words of the document, the pass,
    the words, the output shard and the key to order the shard by. ``whole``
    adds ``document``, all columns of the input.
    """
    spark, carried = docs.sparkSession, ["document"] * whole
    sized = docs.select("doc_id", "source", words_in("text").alias("size"), F.xxhash64("doc_id", "text").alias("h"), *([F.struct(*map(named, docs.columns)).alias("document")] * whole))
    sized = sized if whole else durable(sized)
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    aims = targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, cap)
    plan = []
    for r, aim in zip(found, aims, strict=True):
        passes = int(aim // r["words"]) if r["words"] else 0
        plan.append(Quota(r["source"], r["words"], aim, -(-r["n"] // block_docs), passes, round(aim) - passes * r["words"]))
    quota_type = "k int, source string, words long, target double, blocks long, passes int, rest long"
    quotas = spark.createDataFrame([(k, *q) for k, q in enumerate(plan)], quota_type)
    small = F.broadcast if len(plan) <= BROADCAST_SOURCES else (lambda x: x)

    rows = sized.alias("d").join(small(quotas).alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")))
    rows = rows.select("d.doc_id", "d.source", "d.size", "d.h", *carried, "q.k", "q.words", "q.target", "q.passes", "q.rest",
                       F.pmod(F.xxhash64("d.h", F.lit(seed)), F.col("q.blocks")).alias("block"))
    blocks = rows.groupBy("k", "block").agg(F.sum("size").alias("held"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    permuted = W.partitionBy("k").orderBy(F.xxhash64("k", "block", F.lit(seed + 1)), "block")
    blocks = durable(blocks.select(
        "k", "block", "rest", "passes",
        (F.sum("held").over(permuted.rowsBetween(W.unboundedPreceding, 0)) - F.col("held")).alias("before"),
        (F.row_number().over(permuted) - 1).alias("place"),
    ))
    # A source's drawn blocks: all of them once a pass, then those that begin before the rest is met.
    partial = (F.col("before") < F.col("rest")).cast("int")
    drawn = {r["k"]: (r["blocks"], r["partial"]) for r in blocks.groupBy("k").agg(F.count(F.lit(1)).alias("blocks"), F.sum(partial).alias("partial")).collect()}
    counts = [plan[k].passes * drawn[k][0] + drawn[k][1] for k in range(len(plan))]
    ends = split_quotas(counts, shards, seed).cumsum(axis=0)
    dealt = spark.createDataFrame([(k, drawn[k][0], ends[:, k].tolist()) for k in range(len(plan))], "k int, per_pass long, ends array<long>")
    blocks = blocks.join(small(dealt), "k").select(
        "k", "block", "before",
        F.when(F.col("passes") + partial > 0, F.expr(
            "transform(sequence(0, passes - 1 + if(before < rest, 1, 0)), p -> size(filter(ends, e -> e <= p * per_pass + place)))"
        )).alias("shards"),
    )

    inside = W.partitionBy("k", "block").orderBy(F.xxhash64("h", F.lit(seed + 2)), "doc_id", "size")
    rows = rows.join(blocks, ["k", "block"])
    done = F.col("before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - done)))
    placed = F.expr(
        "filter(transform(coalesce(shards, array()), (s, p) -> named_struct('pass', p, 'words', if(p < passes, size, part), "
        f"'shard', s, 'order_key', xxhash64(h, p, {seed + 3}))), x -> x.words > 0)"
    )
    rows = rows.withColumn("placements", placed)
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    return rows.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", taken.alias("taken"), "placements", *carried)


def draw(docs: DataFrame, shards: int = 16, length: str | None = None, **settings) -> DataFrame:
    """The mixed corpus: the documents' columns, one row per document and pass, and shard, pass and words.

    The text of a row with fewer words than the document is cut after so many
    words; ``length`` names a column that follows a cut text's length. A shard's rows are together and in random order; a large shard goes
    over several partitions, each a range of that order. Columns of the
    documents named shard, pass or words are kept as doc_shard, doc_pass and doc_words.
    """
    plan = mix(docs, shards=shards, whole=True, **settings)
    rows = plan.select("document", "size", F.explode("placements").alias("p"))
    pieces = max(1, -(-parallelism(docs) // shards))
    piece = F.floor((F.col("p.order_key") / F.lit(2.0**64) + 0.5) * pieces)
    words = F.regexp_extract_all("document.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.col("p.words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(words, 1, F.col("p.words").cast("int")), "")).otherwise(F.col("document.text"))
    size = lambda c: F.when(cut, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col("document").getField(c))
    kept = {c: f"doc_{c}" if c in ("shard", "pass", "words") else c for c in docs.columns}
    own = [text.alias(name) if c == "text" else size(c).alias(name) if c == length else F.col("document").getField(c).alias(name) for c, name in kept.items()]
    rows = rows.withColumn("piece", piece).repartition("p.shard", "piece").sortWithinPartitions("p.shard", "p.order_key")
    return rows.select(*own, "p.shard", "p.pass", "p.words")
