"""Targets, flows and whole mixes of many sources against plain forms."""

from __future__ import annotations

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gridlake.llm import mixing as M


def plain_targets(sizes, weights, share, most):
    caps = [most * s for s in sizes]
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > caps[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = caps[i]
            open_.discard(i)
        left -= sum(caps[i] for i in over)
    return out


@pytest.mark.parametrize("share", [0.3, 1.5, 2.0, 5.0])
def test_targets(spark, share):
    rng = random.Random(3)
    sizes = [rng.choice([0, rng.randrange(50), rng.randrange(5000)]) for _ in range(200)]
    weights = [rng.choice([3.0, 1.0, 2.0]) for _ in sizes]
    df = spark.createDataFrame(list(zip(range(200), sizes, weights)), "i int, size long, weight double").repartition(5)
    got = [r.target for r in M.with_targets(df, share, 2).orderBy("i").collect()]
    assert got == pytest.approx(plain_targets(sizes, weights, share, 2), rel=1e-12, abs=1e-9)
    assert M.with_targets(df.limit(0), share, 2).collect() == []


def brute_flow(capacity, members, quota, repeats):
    """(words, cost) of a cheapest largest flow, by the smallest cut for each number of uses."""

    def largest(uses):
        best = None
        for n in range(len(quota) + 1):
            for full in combinations(range(len(quota)), n):
                cut = sum(quota[s] for s in full) + sum(uses * c for c, m in zip(capacity, members) if not set(m) <= set(full))
                best = cut if best is None else min(best, cut)
        return best

    flows = [largest(u) for u in range(repeats + 1)]
    return flows[-1], sum(u * (flows[u + 1] - flows[u]) for u in range(repeats))


def test_flow_is_largest_and_cheapest():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(1, 5)
        members = [tuple(sorted(rng.sample(range(n), rng.randrange(1, n + 1)))) for _ in range(rng.randrange(1, 7))]
        capacity = [rng.randrange(0, 30) for _ in members]
        quota, repeats = [rng.randrange(0, 60) for _ in range(n)], rng.randrange(1, 4)
        flow = M.min_cost_flow(capacity, members, quota, repeats)
        used = [sum(f.values()) for f in flow]
        assert all(v >= 0 and s in m for f, m in zip(flow, members) for s, v in f.items())
        assert all(u <= repeats * c for u, c in zip(used, capacity))
        assert all(sum(f.get(s, 0) for f in flow) <= quota[s] for s in range(n))
        cost = sum(sum(max(0, min(u - k * c, c)) * k for k in range(repeats)) for u, c in zip(used, capacity))
        assert (sum(used), cost) == brute_flow(capacity, members, quota, repeats)


def test_many_overlapping_patterns():
    rng = random.Random(1)
    members = list({tuple(sorted(rng.sample(range(300), rng.randrange(1, 5)))) for _ in range(21_000)})
    capacity = [rng.randrange(1, 1000) for _ in members]
    total = sum(capacity)
    quota = [round(1.5 * total / 300 * rng.uniform(0.2, 1.8)) for _ in range(300)]
    began = time.process_time()
    flow = M.min_cost_flow(capacity, members, quota, 2)
    assert time.process_time() - began < 60
    into = [sum(f.get(s, 0) for f in flow) for s in range(300)]
    assert all(a <= b for a, b in zip(into, quota)) and sum(into) >= 0.99 * min(sum(quota), 2 * total)


def test_many_sources(spark):
    """One source a document: no pattern is shared, so no flow is routed and nothing is bounded by a number of sources."""
    n = 120_000
    sized = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("s%07d", F.col("id")).alias("source"), (F.col("id") % 9 + 1).alias("size"))
    mix = M.plan_mix(sized)
    assert mix.n_sources == n and mix.n_plan == n > M.BROADCAST_ROWS
    taken = mix.apply(sized).withColumn("taken", F.col("size") * F.col("repeats"))
    rows = taken.join(mix.table.select("source", "target", F.col("size").alias("all")), "source")
    out = rows.agg(F.max(F.col("taken") - F.col("target")), F.sum(F.col("target")), F.sum("size"), F.max(F.col("repeats")), F.count(F.lit(1))).first()
    assert out[0] <= 0.5 and out[3] <= 2 and out[4] == n
    assert out[1] == pytest.approx(1.5 * out[2])


def test_components_apart_and_together(spark):
    """Two overlapping groups, sources on their own, no source and a null one, in one table."""
    rng = random.Random(4)
    kinds = [["a"], ["a", "b"], ["b", "c"], ["x", "y"], ["y"], ["lone"], [None], [], None, ["c", "a", "a"]]
    rows = [(i, rng.choice(kinds), rng.randrange(0, 40)) for i in range(800)]
    table = spark.createDataFrame(rows, "doc_id long, source array<string>, size long").repartition(4)
    mix = M.plan_mix(table, share=0.8)
    sources = {s: (size, target) for s, size, target in mix.sources}
    assert list(sources) == ["a", "b", "c", "lone", "x", "y", None]
    size = {s: sum(z for _, m, z in rows if m and s in m) for s in sources}
    assert {s: v[0] for s, v in sources.items()} == size
    want = plain_targets([size[s] for s in sources], [(3.0, 1.0, 2.0)[i % 3] for i in range(7)], 0.8, 2)
    assert [t for _, t in sources.values()] == pytest.approx(want)
    got = {r.doc_id: r.repeats for r in mix.apply(table).collect()}
    assert all(got[i] == 0 for i, m, _ in rows if not m) and max(got.values()) <= 2
    taken = {True: 0, False: 0}
    for i, m, z in rows:
        taken[bool(m) and set(m) <= {"x", "y"}] += got[i] * z
    pair = sum(round(sources[s][1]) for s in ("x", "y"))
    most = 2 * sum(z for _, m, z in rows if m and set(m) <= {"x", "y"})
    assert abs(taken[True] - min(pair, most)) <= 160
    assert got == {r.doc_id: r.repeats for r in M.plan_mix(table, share=0.8).apply(table).collect()}


def test_stage_with_a_clashing_name(spark):
    from gridlake.llm.near_dedup import kept_documents

    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "x"), (2, text, "y"), (3, "other words here", "z")], "doc_id long, text string, gone string").withColumn("_gone", F.lit(1))
    out = kept_documents(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
