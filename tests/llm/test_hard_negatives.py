"""Hard negatives against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridlake.llm import dual_tree as T
from gridlake.llm import hard_negatives as H


def plain(table, every=100, positives=5, negatives=10):
    rows = []
    for i, label, v in table:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, y in sorted({r for r in rows if r[0] % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(y, z)), j, m) for j, m, z in rows if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit)]
    return sorted(out)


def got(df, **how):
    return sorted(tuple(r) for r in H.mined(df, **how).collect())


SCHEMA = "vec_id long, label int, embedding array<float>, y int, Cell string"


def table(n, d, seed, centres=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, d)) / math.sqrt(d)
    if centres:
        data = data * 0.2 + (rng.normal(size=(centres, d)) / math.sqrt(d))[rng.integers(0, centres, n)]
    return [(i, int(rng.integers(0, 10)), [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]


@pytest.mark.parametrize(("n", "d", "centres", "part_rows", "sample"), [(900, 6, 0, 65_536, 8192), (1200, 12, 9, 50, 64), (700, 3, 0, 100, 2)])
def test_same_as_plain(spark, n, d, centres, part_rows, sample):
    rows = table(n, d, n, centres)
    rows += [(rows[3][0], rows[3][1], rows[3][2]), (100, rows[100][1], rows[100][2]), (200, 3, rows[9][2])]  # repeated ids
    rows += [(2 * n + i, 4, rows[100][2]) for i in range(60)]  # many copies of an anchor's vector
    rows += [(None, 1, rows[0][2]), (9100, None, rows[0][2]), (9200, 1, None), (9300, 1, [None] * d), (9400, 1, [float("inf")] * d), (9500, 1, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    want = plain(rows, every=20)
    assert len(want) > 500
    assert got(df, every=20, part_rows=part_rows, sample=sample) == want


def test_ties_and_hot_vector(spark):
    rows = [(i, i % 3, [1.0, 0.0] if i % 3 else [0.5, 0.25 * (i % 5)]) for i in range(600)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert got(df, every=50, part_rows=64, sample=32) == plain(rows, every=50)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.mined(df).collect() == []
    one = spark.createDataFrame([(100, 1, [1.0], 1, "x")], SCHEMA)
    assert H.mined(one).collect() == []


def test_ends():
    for s in range(-300, 300):
        low, high = (int(x[0]) for x in H.ends(np.array([s])))
        fit = [t for t in range(-400, 400) if 30 * s <= 100 * t <= 90 * s]
        assert fit == list(range(low, high + 1))


def test_large_components_are_exact():
    rng = np.random.default_rng(3)
    for most in (1 << 10, 1 << 28, (1 << 31) - 1):
        a, b = (rng.integers(-most, most, (5, 4)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert T.products(a, b).astype(object).tolist() == [[max(-(2**63) + 1, min(2**63 - 1, w)) for w in r] for r in want]
    assert T.products(a[:0], b).shape == (0, 5)


def test_clusters_are_pruned():
    """Tight clusters far apart: most leaf pairs are never scored, and the result is that of all pairs."""
    rng = np.random.default_rng(8)
    centre = rng.integers(-2000, 2000, (64, 16))
    rows = (centre[np.arange(64 * 64) % 64] + rng.integers(-20, 20, (64 * 64, 16))).astype(np.int64)
    ids, labels = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    tree = T.Candidates(ids, labels, rows, leaf=64)
    pick = np.arange(0, len(rows), 16)
    wants = T.Requests(np.arange(len(pick)), np.full(len(pick), -T.FAR), np.full(len(pick), T.FAR))
    scored = tree.search(ids[pick], labels[pick], rows[pick], wants, True, 5, leaf=16)
    leaves = sum(c is None for c in tree.tree.child)
    assert scored < 0.4 * leaves * len(pick) / 8
    s = rows[pick] @ rows.T
    for k, i in enumerate(pick):
        order = [j for j in np.lexsort((ids, -s[k])) if j != i][:5]
        assert wants.found[k][1].tolist() == order
