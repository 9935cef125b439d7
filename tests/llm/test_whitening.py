"""Whitening against the plain covariance of all distinct vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridlake.llm import whitening as W


def plain(vectors: list[list[float]], most: int):
    """x by row, and mean, eigenvalues and vectors of the distinct rows."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit - s / n).astype(float)
    e, w = np.linalg.eigh(centred.T @ centred / n)
    deviation = [int(sum((n * v - t) ** 2 for v, t in zip(r, s, strict=True))) for r in x]
    return x, n, s, e[::-1][:most], w[:, ::-1][:, :most], e.sum(), deviation


@pytest.mark.parametrize(("d", "tile", "rows"), [(7, 3, 300), (20, 32, 90), (33, 8, 1500)])
def test_same_as_plain(spark, d, tile, rows):
    rng = np.random.default_rng(d)
    data = (rng.normal(size=(rows, d)) * rng.uniform(0.2, 3, d) + rng.normal(size=d) * 5).astype(np.float32)
    data[10:20] = data[5]
    vectors = data.tolist()
    table = [(i if i % 50 else None, 1, v) for i, v in enumerate(vectors)]
    bad = [(9000, 1, None), (9001, 1, []), (9002, 1, [None] + [0.0] * (d - 1)), (9003, 1, [float("nan")] * d), (9004, 1, [float("-inf")] * d), (9005, 1, [1.0])]
    df = spark.createDataFrame(table + bad, "vec_id long, n int, embedding array<float>").repartition(5)
    got = W.whiten(df, tile=tile).collect()
    most = min(16, d)
    x, n, s, e, w, trace, deviation = plain(vectors, most)
    assert len(got) == rows * most and {r.n for r in got} == {n}
    want_ids = sorted(repr(i) for i, _, _ in table)
    assert sorted(repr(r.vec_id) for r in got if r.component == 1) == want_ids
    by = {(r.vec_id, r.component): r for r in got if r.vec_id is not None}
    white = (x - s / n).astype(float) @ (w / np.sqrt(e))
    sign = {}
    for i, _, _ in table:
        if i is None:
            continue
        assert by[i, 1].deviation == deviation[i]
        for c in range(most):
            r = by[i, c + 1]
            assert r.explained == pytest.approx(e[c] / trace, rel=1e-9)
            if abs(white[i, c]) > 1e-6:
                sign.setdefault(c, math.copysign(1, r.whitened * white[i, c]))
            assert r.whitened == pytest.approx(white[i, c] * sign.get(c, 1), rel=1e-7, abs=1e-7)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-6


def test_products_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(-(10**6), 10**6, (500, 12))
    fit = spark.createDataFrame([(r,) for r in data.tolist()], "x array<long>").repartition(3)
    fit = W.materialize(fit)
    shift = data.mean(axis=0)
    want = (data - shift).T @ (data - shift)
    for tile in (1, 5, 12, 40):
        assert np.allclose(W.tiled_products(fit, 12, lambda m: m, shift, tile), want, rtol=1e-12)


def test_few_vectors(spark):
    one = W.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    two = W.whiten(spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    first = {r.vec_id: r.whitened for r in two if r.component == 1}
    assert sorted(first.values()) == pytest.approx([-1, 1]) and {r.whitened for r in two if r.component > 1} == {0.0}
    assert two[0].identity_error < 1e-9
    far = W.whiten(spark.createDataFrame([(i, [3e38 * (i % 2), float(i)]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert len(far) == 8 and all(math.isfinite(r.whitened) for r in far) and {r.deviation for r in far} == {None}
    empty = spark.createDataFrame([], "vec_id int, embedding array<float>")
    out = W.whiten(empty)
    assert out.schema["vec_id"].dataType.simpleString() == "int" and out.collect() == []
