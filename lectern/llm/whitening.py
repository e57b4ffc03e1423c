"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V are found without forming it. A
block Q of a few more vectors than wanted is multiplied by V in a pass over all
rows, each centred before anything is multiplied: sum of x (x'Q) over n. A
Chebyshev polynomial in V, one pass a degree, damps the part of the spectrum
below the block and lifts what is above; QR and a Rayleigh-Ritz step follow, and
the whole repeats until the residual of every wanted pair is at rounding level.
Converged pairs are locked and taken out of the block. A single vector rides
along in the first passes as a Lanczos process, which tells where the unwanted spectrum
begins. Where sweeps gain too little the block grows, up to the
whole width, where Rayleigh-Ritz is exact.

Entries become integers, x = floor(scale * c) + offset, so n and the sums S are
exact, and x - S/n is rounded once.

A pass leaves one block of numbers a task, added up in about the square root of as many
tasks, so the driver gets the square root of the number of tasks in blocks of
width times block size. Nothing is kept between passes; a lost executor costs
its tasks of one pass.

Defined results: vectors that are null or hold a null or non-finite entry, or
one of 2 ** 40 or more, are dropped; of vectors of several lengths the
commonest length is taken (the greater on a tie) and others are dropped like these; rows that repeat are fitted and
returned each, missing ids stay null; components whose eigenvalue is under 1e-12 of the largest
(constant dimensions, fewer rows than dimensions) are left out, so equal vectors, a
single row and an empty table give no rows; a deviation beyond a long is null;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
LIMIT = 2.0**40
COMPONENTS = 32
#: Vectors of the block beyond those wanted.
GUARD = 16
#: Residual of a pair, against its eigenvalue, at which it is certified, or against the largest one, that rounding alone may leave.
TOLERANCE, ROUNDING = 1e-13, 2e-15
#: Components under this share of the largest eigenvalue aren't reported.
LEAST = 1e-12
#: Highest degree of one sweep, and how far it may spread a block apart.
DEGREE, SPREAD = 24, 1e9
#: Lanczos steps that ride along; a block that gains less than ``GAIN`` in two sweeps running grows.
SCOUTED, GAIN = 12, 4
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """The fit list: how many vectors of what width, and their sums as ``n * base + rest``."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n


def usable(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Row numbers and integer vectors by width, of the vectors that take part (of one width, if given)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows, vectors = {}, {}
    for w in np.unique(lengths).tolist() if width is None else [width]:
        at = np.flatnonzero(lengths == w)
        if w <= 0 or not len(at):
            continue
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        c = flat.reshape(-1, w)
        with np.errstate(invalid="ignore"):
            good = (np.abs(c) < LIMIT).all(axis=1)  # false for NaN and null, too
        rows[w], vectors[w] = at[good], np.floor(SCALE * c[good]).astype(np.int64) + OFFSET
    return rows, vectors


def fit_of(vectors: DataFrame) -> Fit | None:
    """Width, count and exact sums of the fit list; None if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for w, x in usable(batch.column(0))[1].items():
                if len(x):
                    n, high, low = held.get(w, (0, 0, 0))
                    held[w] = [n + len(x), high + (x >> 24).sum(0), low + (x & 0xFFFFFF).sum(0)]
        for w, (n, high, low) in held.items():
            yield pa.RecordBatch.from_pydict({"width": [w] * w, "i": np.arange(w, dtype=np.int32), "n": [n] * w, "high": high, "low": low}, schema=schema)

    schema = pa.schema([("width", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
    sums = vectors.mapInArrow(run, "width int, i int, n long, high long, low long").groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    widest = sums.where("i = 0").orderBy(F.desc("n"), F.desc("width")).limit(1).select("width")
    rows = sorted(sums.join(widest, "width").collect(), key=lambda r: r["i"])  # a row a dimension
    if not rows:
        return None
    n, totals = rows[0]["n"], [(r["high"] << 24) + r["low"] for r in rows]
    return Fit(n, np.array([t // n for t in totals], dtype=np.int64), np.array([t % n for t in totals], dtype=np.int64))


def added(vectors: DataFrame, size: int, of_batch: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """``size`` numbers of every batch, added up over all of them."""
    schema = pa.schema([("block", pa.binary())])

    def block(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of_batch(batch.column(0))
        yield block(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for one in batch.column(0):
                total += np.frombuffer(one.as_py())
        yield block(total)

    tasks = vectors.rdd.getNumPartitions()
    blocks = vectors.mapInArrow(begin, "block binary")
    if tasks > 8:
        blocks = blocks.repartition(math.isqrt(tasks)).mapInArrow(merge, "block binary")
    return sum((np.frombuffer(r[0]) for r in blocks.collect()), np.zeros(size))


def product(vectors: DataFrame, fit: Fit, q: np.ndarray) -> np.ndarray:
    """V q, in one pass."""
    width = len(fit.base)

    def of_batch(column: pa.Array) -> np.ndarray:
        x = usable(column, width)[1].get(width)
        if x is None:
            return np.zeros(q.size)
        c = fit.centred(x)
        return (c.T @ (c @ q)).ravel()

    return added(vectors, q.size, of_batch).reshape(q.shape) / fit.n


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, vectors and their products with V of the space that the orthonormal ``q`` spans, by falling value."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def orthonormal(y: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``y`` apart from ``locked``, twice for rounding."""
    for _ in range(2):
        y = np.linalg.qr(y - locked @ (locked.T @ y))[0]
    return y


class Lanczos:
    """Bounds of the spectrum from a vector that rides along."""

    def __init__(self, width: int, rng: np.random.Generator):
        v = rng.normal(size=width)
        self.basis, self.a, self.b = [v / np.linalg.norm(v)], [], []

    def next(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def take(self, vv: np.ndarray) -> None:
        v, w = self.basis[-1], vv[:, 0].copy()
        self.a.append(float(v @ w))
        known = np.array(self.basis)
        for _ in range(2):
            w -= known.T @ (known @ w)
        self.b.append(float(np.linalg.norm(w)))
        self.basis.append(w / self.b[-1] if self.b[-1] > 1e-9 * abs(self.a[0]) else np.zeros_like(w))

    def low(self) -> float:
        """A value that little of the spectrum lies below: the least Ritz value less its residual."""
        if len(self.a) < SCOUTED // 2:
            return 0.0
        values, vectors = np.linalg.eigh(np.diag(self.a) + np.diag(self.b[:-1], 1) + np.diag(self.b[:-1], -1))
        return max(0.0, float(values[0] - self.b[-1] * abs(vectors[-1, 0])))


def leading(multiply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """Values and vectors of the ``wanted`` leading eigenpairs, and the passes it took."""
    rng = np.random.default_rng(seed)
    size, wanted = min(width, wanted + guard), min(wanted, width)
    locked, held = np.zeros((width, 0)), np.zeros(0)
    scout, riding, passes, best, slow = Lanczos(width, rng), True, 0, math.inf, 0

    def times(y: np.ndarray) -> np.ndarray:
        nonlocal passes, riding
        passes += 1
        if not riding:
            return multiply(y)
        out = multiply(np.hstack([y, scout.next()]))
        scout.take(out[:, -1:])
        riding = len(scout.a) < min(width, SCOUTED)
        return out[:, :-1]

    q = orthonormal(rng.normal(size=(width, size)), locked)
    while True:
        values, q, vq = ritz(q, times(q))
        whole = q.shape[1] + locked.shape[1] >= width
        top = max(held[0] if len(held) else 0.0, values[0], np.finfo(float).tiny)
        residuals = np.linalg.norm(vq - q * values, axis=0) / np.maximum(values, ROUNDING * top / tolerance)
        missing = wanted - len(held)
        worst = float(residuals[:missing].max())
        if whole or worst <= tolerance:
            order = np.argsort(-np.concatenate([held, values[:missing]]), kind="stable")
            return np.concatenate([held, values[:missing]])[order], np.hstack([locked, q[:, :missing]])[:, order], passes
        # Lock what has converged, from the top without a gap.
        done = 0
        while done < missing and residuals[done] <= tolerance:
            done += 1
        locked, held = np.hstack([locked, q[:, :done]]), np.concatenate([held, values[:done]])
        q, vq, values, missing, residuals = q[:, done:], vq[:, done:], values[done:], missing - done, residuals[done:]
        slow = slow + 1 if worst * GAIN > best else 0
        if slow == 2:
            # A larger block has a wider gap below the wanted pairs.
            more = min(max(8, size // 2), width - locked.shape[1] - q.shape[1])
            q = orthonormal(np.hstack([q, rng.normal(size=(width, more))]), locked)
            best, slow = math.inf, 0
            continue
        best = worst
        low, cut = min(scout.low(), values[-1]), values[-1]
        half, middle = max((cut - low) / 2, 1e-12 * top), (cut + low) / 2
        gain = lambda value: math.acosh(max(1.0, (value - middle) / half))  # noqa: E731  log of the growth a degree
        weak, strong = gain(values[missing - 1]), gain(values[0])
        degree = math.ceil(math.log(10 * worst / tolerance) / weak) if weak > 0 else DEGREE
        if strong > weak:
            degree = min(degree, math.floor(math.log(SPREAD) / (strong - weak)))
        degree = max(2, min(DEGREE, degree))
        sigma = half / max(values[0] - middle, half)
        tau = 2 / sigma
        y, previous = (vq - middle * q) * (sigma / half), q
        for _ in range(degree - 1):
            y -= locked @ (locked.T @ y)
            then = 1 / (tau - sigma)
            y, previous = (times(y) - middle * y) * (2 * then / half) - (sigma * then) * previous, y
            sigma = then
        q = orthonormal(y, locked)


def deviations(x: np.ndarray, fit: Fit) -> pa.Array:
    """Sums of (n x - S) ** 2, exact; null beyond a long."""
    apart = x - fit.base
    if (int(np.abs(apart).max(initial=0)) + 1) ** 2 * fit.n**2 * len(fit.base) < 1 << 63:
        return pa.array(((fit.n * apart - fit.rest) ** 2).sum(axis=1), pa.int64())
    exact = ((fit.n * apart.astype(object) - fit.rest.astype(object)) ** 2).sum(axis=1)
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whitened(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(f"`{vector}`").alias("v"))
    fit = fit_of(vectors)
    if fit is None:
        return spark.createDataFrame([], OUT)
    width = len(fit.base)
    values, axes, _ = leading(lambda q: product(vectors, fit, q), width, components)

    kept = values > LEAST * max(values[0], 0.0)
    values, axes = values[kept], axes[:, kept]
    if not len(values):
        return spark.createDataFrame([], OUT)
    scale, count = axes / np.sqrt(values), len(values)

    def moments(column: pa.Array) -> np.ndarray:
        x = usable(column, width)[1].get(width)
        if x is None:
            return np.zeros(count * count + count + 1)
        c = fit.centred(x)
        w = c @ scale
        return np.concatenate([(w.T @ w).ravel(), w.sum(0), [(c**2).sum()]])

    sums = added(vectors, count * count + count + 1, moments) / fit.n
    mean, trace = sums[-count - 1 : -1], sums[-1]
    error = float(np.abs(sums[: count * count].reshape(count, count) - np.outer(mean, mean) - np.eye(count)).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1), width)
            if width not in x or not len(x[width]):
                continue
            w, many = fit.centred(x[width]) @ scale, len(x[width])
            each = pa.array(np.repeat(np.arange(many), count))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at[width])).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), many)), pa.array(np.full(many * count, fit.n)),
                deviations(x[width], fit).take(each), pa.array(w.ravel()), pa.array(np.tile(values / trace, many)), pa.array(np.full(many * count, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col(f"`{vector}`")).mapInArrow(rows, OUT)
