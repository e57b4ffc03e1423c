"""Whitening against numpy's eigenvectors, exact deviations, and the edges."""

import math

import numpy as np
import pytest

from lectern.llm import whitening

KIND = "vec_id long, embedding array<double>, label int, component string, `a.b` map<string,int>"


def made(spark, vectors, slices=4):
    return spark.createDataFrame([(i, v, 1, "clash", {"k": 1}) for i, v in vectors], KIND).repartition(slices)


def check(rows, vectors, components):
    """All that the contract says of a result."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    centred = np.array([[float(c) for c in r] for r in (n * x - s)]) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    wanted = [k for k in range(min(components, len(values))) if values[k] > 1e-11 * values[0]]
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert sum(len(v) for g in got.values() for v in g.values()) == n * len(wanted)
    ids = [i for i, _ in vectors]
    deviation = ((n * x - s) ** 2).sum(1)
    for k in wanted:
        w = np.array([got[i, int(d) if d < 2**63 else None][k + 1][0]["whitened"] for i, d in zip(ids, deviation, strict=True)])
        cross = axes.T @ (centred.T @ w / n) / math.sqrt(values[k])  # an eigenvector, in the basis of all of them
        if min(abs(values[k] - values[j]) for j in range(len(values)) if j != k) > 1e-3 * values[0]:
            assert abs(abs(cross[k]) - 1) < 1e-9 and np.abs(np.delete(cross, k)).max() < 1e-7
        first = got[ids[0], int(deviation[0]) if deviation[0] < 2**63 else None][k + 1][0]
        assert first["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9) and first["n"] == n
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-7


@pytest.mark.parametrize(("rows", "width", "components"), [(400, 64, 32), (90, 70, 8), (300, 5, 32), (12, 40, 32), (2, 3, 2)])
def test_against_numpy(spark, rows, width, components):
    rng = np.random.default_rng(rows)
    vectors = [(i, (rng.normal(size=width) * np.linspace(1, 3, width)).tolist()) for i in range(rows)]
    check(whitening.whitened(made(spark, vectors), components).collect(), vectors, components)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=12).tolist()) for i in range(60)] + [(3, rng.normal(size=12).tolist()), (None, rng.normal(size=12).tolist())]
    good += [(100 + i, good[0][1]) for i in range(200)]  # one vector of most rows
    bad = [(900, None), (901, [None, *good[0][1][1:]]), (902, [math.nan, *good[0][1][1:]]), (903, [math.inf, *good[0][1][1:]]), (904, []), (905, [1.0, 2.0]), (906, [1e300, *good[0][1][1:]])]
    check(whitening.whitened(made(spark, good + bad), 6).collect(), good, 6)


def test_scales(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(c) for c in rng.normal(size=8) * [1, 1, 1, 1, 1, 1, 30, 1e4]]) for i in range(200)]
    check(whitening.whitened(made(spark, vectors), 4).collect(), vectors, 4)
    large = [(i, [1e6 * c for c in v]) for i, v in vectors]
    assert {r["deviation"] for r in whitening.whitened(made(spark, large), 4).collect()} >= {None}
    check(whitening.whitened(made(spark, large), 1).collect(), large, 1)


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        df = made(spark, vectors or [(1, [1.0])])
        assert whitening.whitened(df if vectors else df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["flat", "decay", "close", "wide", "rank"])
def test_leading(kind):
    rng = np.random.default_rng(9)
    width = 400 if kind == "wide" else 80
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    spectrum = {"flat": np.ones(width), "decay": 0.7 ** np.arange(width), "close": 1 + 1e-3 * rng.random(width), "wide": np.sort(rng.random(width))[::-1] + 1, "rank": np.r_[np.ones(5), np.zeros(width - 5)]}[kind]
    v = (turn * spectrum) @ turn.T
    values, axes, passes = whitening.leading(lambda q: v @ q, width, 20)
    assert np.abs(values - np.sort(spectrum)[::-1][:20]).max() < 1e-11 and np.linalg.norm(v @ axes - axes * values, axis=0).max() < 1e-11
    assert np.abs(axes.T @ axes - np.eye(20)).max() < 1e-11 and passes < 300
