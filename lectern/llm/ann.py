"""Approximate nearest neighbours over learned partitions.

A bounded sample of vectors gives a neighbour graph; the graph is cut into
balanced parts that keep neighbours together, and a small softmax network learns
to tell the parts of a vector's neighbours from the vector. Tables of more than
``DEEP`` vectors have a second level: every part is cut again in
the same way, from a sample of its own, so parts stay about as large up to
``PARTS * SUB_PARTS * PART_ROWS`` vectors (some four million; beyond that they grow). It then names the
part of every indexed vector, and the parts that a query probes: as many of the
likeliest as the sample needs to find ``aim`` of its true neighbours. Candidates
of the probed parts are ranked by exact cosine in double precision.

Of equal vectors only the ``k + 1`` smallest ids can be among a query's ``k``
nearest, so the index keeps those and no more. A large part is dealt over
blocks of bounded size, and its queries likewise, so one part makes no large
task.

Defined results: vectors that are null or zero or hold a null or non-finite
component, and rows without vec_id, take no part; rows that repeat a vec_id are
never each other's neighbours and count once, with the nearest of their vectors;
vectors are compared with those of their own length, each length searched for itself; under ``2 * LEAST_PART`` different vectors are
one part, which is searched exactly; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.llm.common import durable, share_of

#: Vectors that the partitioning is learned from, at most about so many.
SAMPLE = 8192
#: Indexed vectors for each part, and the most parts.
PART_ROWS, PARTS = 1024, 128
#: Vectors from which an index has two levels: eight times as many as fill the parts of one, so that what the second one saves is worth its training.
DEEP = 8 * PARTS * PART_ROWS
#: Vectors of a part that its second level is learned from, and the most parts there.
SUB_SAMPLE, SUB_PARTS = 2048, 32
#: Sampled vectors that a part is learned from at least; a sample of fewer than two parts' makes one part, which is searched whole.
LEAST_PART = 32
NEIGHBOURS = 10
SCHEMA = "query_id long, rank int, vec_id long, score double"
#: Rows of a block of a part, and of a block of queries to it.
BLOCK, QUERY_BLOCK = 8192, 1024


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def graph_of(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest of every row."""
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """A part for every node of the graph, none above ``slack`` times its share.

    Starts from halvings along each piece's main direction; then nodes move to
    the part of most of their neighbours while there is room.
    """
    part = np.zeros(len(x), dtype=np.int64)
    pieces = [(np.arange(len(x)), 0, parts)]
    while pieces:
        rows, first, count = pieces.pop()
        if count == 1:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        way = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order, left = rows[np.argsort(centred @ way, kind="stable")], count // 2
        cut = len(rows) * left // count
        pieces += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    limit = int(slack * len(x) / parts) + 1
    held = np.bincount(part, minlength=parts)
    rows = np.arange(len(x))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (rows[:, None], part[graph]), 1.0)
        np.add.at(votes, (graph, part[:, None]), 1.0)
        gain = votes.max(1) - votes[rows, part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if held[to] < limit:
                held[part[i]] -= 1
                held[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer and a softmax over parts, trained on the parts of a vector's neighbours."""

    def __init__(self, x: np.ndarray, aim: np.ndarray, hidden: int = 128, epochs: int = 25, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, p = x.shape[1], aim.shape[1]
        self.a, self.b = rng.normal(0, 1 / d**0.5, (d, hidden)) * 4, np.zeros(hidden)
        self.c, self.e = rng.normal(0, 1 / hidden**0.5, (hidden, p)), np.zeros(p)
        slots = [np.zeros_like(w) for w in (self.a, self.b, self.c, self.e)]
        squares = [np.zeros_like(w) for w in (self.a, self.b, self.c, self.e)]
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                h = np.maximum(x[at] @ self.a + self.b, 0)
                g = (self.soft(h @ self.c + self.e) - aim[at]) / len(at)
                back = (g @ self.c.T) * (h > 0)
                step += 1
                for w, m, v, q in zip((self.a, self.b, self.c, self.e), slots, squares, (x[at].T @ back, back.sum(0), h.T @ g, g.sum(0)), strict=True):
                    m += 0.1 * (q - m)
                    v += 0.001 * (q * q - v)
                    w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, c: np.ndarray, e: np.ndarray) -> Router:
        """A router of known weights."""
        made = cls.__new__(cls)
        made.a, made.b, made.c, made.e = a, b, c, e
        return made

    @staticmethod
    def soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the likeliest first."""
        return np.argsort(-(np.maximum(x @ self.a + self.b, 0) @ self.c + self.e), axis=1, kind="stable")


class Index:
    """A router and the number of parts to probe; without a router there is one part."""

    def __init__(self, router: Router | None, probes: int):
        self.router, self.probes = router, probes

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return self.router.ranked(unit(x)) if self.router else np.zeros((len(x), 1), dtype=np.int64)


class Tree:
    """An index of parts and, for some of them, one of its parts in turn; a place is ``part * SUB_PARTS + sub``."""

    def __init__(self, top: Index, below: dict[int, Index]):
        self.top, self.below = top, below

    def placed(self, x: np.ndarray) -> np.ndarray:
        """The likeliest place of each row."""
        part = self.top.ranked(x)[:, 0]
        out = part * SUB_PARTS
        for p in np.unique(part).tolist():
            if p in self.below:
                at = part == p
                out[at] += self.below[p].ranked(x[at])[:, 0]
        return out

    def probed(self, x: np.ndarray, held: dict[int, int], enough: int) -> list[np.ndarray]:
        """Places that each row asks: of the parts that it probes those that each probes in turn, and on until there are ``enough`` vectors."""
        ranked = self.top.ranked(x)
        subs = {p: index.ranked(x) for p, index in self.below.items()}
        out = []
        for i, parts in enumerate(ranked.tolist()):
            places, have = [], 0
            for n, p in enumerate(parts):
                if n >= self.top.probes and have >= enough:
                    break
                for m, sub in enumerate(subs[p][i].tolist() if p in subs else (0,)):
                    if p in subs and m >= self.below[p].probes and have >= enough:
                        break
                    places.append(p * SUB_PARTS + sub)
                    have += held.get(places[-1], 0)
            out.append(np.array(places, dtype="int32"))
        return out


def learn(x: np.ndarray, rows: int, k: int, aim: float, most: int = PARTS) -> Index:
    """An index for ``rows`` vectors from a sample of them."""
    parts = min(most, max(2, rows // PART_ROWS), len(x) // LEAST_PART)
    if parts < 2:
        return Index(None, 1)
    x = unit(x)
    graph = graph_of(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (np.arange(len(x))[:, None], part[graph]), 1.0 / (NEIGHBOURS + 1))
    wanted[np.arange(len(x)), part] += 1.0 / (NEIGHBOURS + 1)
    # The probes are set on rows that a first router hasn't seen.
    test = np.arange(len(x)) % 5 == 0
    router = Router(x[~test], wanted[~test])
    ranked = router.ranked(x)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None, :], axis=1)
    near = graph_of(x, k)[test]
    needed = np.sort(np.take_along_axis(place[test], ranked[:, 0][near], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) + 1
    return Index(Router(x, wanted), min(parts, probes))


def usable(vector: str = "embedding") -> F.Column:
    """Whether a vector can be compared: finite components, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    return v.isNotNull() & finite & F.exists(v, lambda c: c != 0)


def search(embeddings: DataFrame, is_query: F.Column, k: int = 5, aim: float = 0.94, sample: int = SAMPLE, levels_from: int = DEEP) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every query row; from ``levels_from`` vectors on the index has two levels."""
    spark = embeddings.sparkSession
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable()).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0)).alias("v"), is_query.alias("asks"))
    rows = rows.withColumn("h", F.xxhash64("v"))
    alike = W.partitionBy("h", "v").orderBy("vec_id")
    distinct = rows.select("vec_id", "v", "h").distinct()
    base = durable(distinct.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1).select("vec_id", "v", "h"))
    found = [same_length(base.where(F.size("v") == n), rows.where(F.size("v") == n), count, n, k, aim, sample, levels_from) for n, count in sorted(base.groupBy(F.size("v")).count().collect())]
    return reduce(DataFrame.union, found, spark.createDataFrame([], SCHEMA)) if len(found) != 1 else found[0]


def same_length(base: DataFrame, rows: DataFrame, count: int, width: int, k: int, aim: float, sample: int, levels_from: int) -> DataFrame:
    """``search`` for the ``count`` indexed vectors ``base`` and the rows of one length."""
    spark = base.sparkSession
    share = min(1.0, sample / max(count, 1))
    picked = base.where(share_of(share, "h")).select("v").distinct().toPandas()["v"].to_list()
    # Two levels must find together what one has to.
    deep = count > levels_from
    top = learn(np.array(sorted(map(tuple, picked))).reshape(-1, width), count, k, aim**0.5 if deep else aim)
    below: dict[int, Index] = {}
    if deep and top.router:
        first = spark.sparkContext.broadcast(top)

        @F.pandas_udf("int")
        def top_part(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(first.value.ranked(np.stack(batch))[:, 0] if len(batch) else [], index=batch.index, dtype="int32")

        parted = durable(base.withColumn("part", top_part("v")))
        sizes = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per part
        some = parted.join(F.broadcast(sizes), "part").where(share_of(F.lit(float(SUB_SAMPLE)) / F.col("n"), "h", F.lit(2)))

        def train(group: pd.DataFrame) -> pd.DataFrame:
            x = np.stack([v for _, v in sorted(zip(group["h"], group["v"], strict=True), key=lambda r: (r[0], tuple(r[1])))])
            found = learn(x, int(group["n"].iloc[0]), k, aim**0.5, SUB_PARTS)
            weights = [pickle.dumps((r.a, r.b, r.c, r.e))] if (r := found.router) else [None]
            return pd.DataFrame({"part": [int(group["part"].iloc[0])], "probes": [found.probes], "weights": weights})

        models = some.select("part", "n", "h", "v").groupBy("part").applyInPandas(train, "part int, probes int, weights binary").where("weights is not null").collect()
        below = {r["part"]: Index(Router.of(*pickle.loads(r["weights"])), r["probes"]) for r in models}
    shared = spark.sparkContext.broadcast(Tree(top, below))

    @F.pandas_udf("int")
    def part_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.placed(np.stack(batch)) if len(batch) else [], index=batch.index, dtype="int32")

    base = durable(base.withColumn("part", part_of("v")))
    held = {r["part"]: r["count"] for r in base.groupBy("part").count().collect()}  # a row per part

    @F.pandas_udf("array<int>")
    def probed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            # At least the set number of parts, and enough for k neighbours.
            yield pd.Series(shared.value.probed(np.stack(batch), held, k + 1) if len(batch) else [], index=batch.index, dtype=object)

    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.xxhash64("vec_id").alias("hq"))
    queries = durable(queries.withColumn("part", F.explode(probed("q"))))
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    blocks = {p: (-(-n // BLOCK), max(1, -(-asked.get(p, 0) // QUERY_BLOCK))) for p, n in held.items()}
    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    cuts = F.create_map(*(x for p, (a, b) in sorted(blocks.items()) for x in (F.lit(p), F.struct(F.lit(a).alias("base"), F.lit(b).alias("queries")))))
    of_base, of_queries = cuts[F.col("part")]["base"], cuts[F.col("part")]["queries"]
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.where(cuts[F.col("part")].isNotNull()).withColumn("b", F.pmod("hq", of_queries).cast("int")).withColumn("a", every(of_base))
    right = base.withColumn("a", F.pmod(F.xxhash64("h", "vec_id"), of_base).cast("int")).withColumn("b", every(of_queries))

    def nearest(asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(have):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        have = have.sort_values("vec_id")
        q, v, ids, own = np.stack(asks["q"]), np.stack(have["v"]), have["vec_id"].to_numpy(), asks["query_id"].to_numpy()
        s = unit(q) @ unit(v).T
        s[own[:, None] == ids[None, :]] = -np.inf
        # All rows as near as the k-th vec_id, with room for rounding; exact scores then choose among them.
        each = np.maximum.reduceat(s, np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), axis=1)
        at = max(0, each.shape[1] - k)
        x, y = np.nonzero(s >= np.partition(each, at, axis=1)[:, at, None] - 1e-9)
        keep = own[x] != ids[y]
        x, y = x[keep], y[keep]
        score = (q[x] * v[y]).sum(1) / (np.sqrt((q[x] ** 2).sum(1)) * np.sqrt((v[y] ** 2).sum(1)))
        out = pd.DataFrame({"query_id": own[x], "vec_id": ids[y], "score": score}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return out.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)

    keys = ["part", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
