"""Bus ids that two types share; islands of any size listed whole; pairs of copies made in blocks;
case files of a bounded size."""

from __future__ import annotations

from collections import Counter
from glob import glob

import pytest
from pyspark.sql import functions as F

from gridlake.operators import checks as C
from gridlake.operators import graph as G
from gridlake.operators import linkage as L
from gridlake.plans import catalog_sources
from gridlake.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    """Tables whose parts and suppliers share bus ids, as they do from a million parts on."""
    d = str(tmp_path_factory.mktemp("shared"))
    orders, part, supplier = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "part", "supplier"))
    more = part.limit(40).withColumn("p_partkey", F.col("p_partkey") + 1_000_000)
    part.unionAll(more).write.parquet(f"{d}/part.parquet")
    supplier.write.parquet(f"{d}/supplier.parquet")
    far = orders.limit(9).withColumns({"o_orderkey": F.col("o_orderkey") * 9, "o_custkey": 1_000_000 + F.col("o_orderkey") % 3})
    orders.unionAll(far).write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["topology_notes", "topology_report", "island_members"])
def test_shared_bus_ids(spark, shared_ids, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("part", "supplier", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{shared_ids}/{t}.parquet/*.parquet')")
    relation = con.sql(ORACLE_SQL[name])
    want = sorted(tuple(map(str, r)) for r in relation.fetchall())
    got = sorted(tuple(map(str, r)) for r in QUERIES[name](spark, shared_ids).select(*relation.columns).collect())
    assert got == want and any("#100" in str(r) for r in want)


def test_long_islands_are_listed_whole(spark):
    n = 120
    buses = spark.createDataFrame([(i, f"N{i:03d}", "500kV") for i in range(2 * n + 1)], "bus_id long, bus_name string, bus_type string")
    ends = [(i, i + 1) for i in range(2 * n) if i != n]
    lines = spark.createDataFrame([(f"L{i}", i, j) for i, j in ends], "line_key string, bus_i long, bus_j long")
    lines = lines.selectExpr("*", "0.1D r_pu", "0.1D x_pu", "9.0D ratea_mva", "'line' element_type", "true in_service")
    trafos = spark.createDataFrame([], "trafo_key string, bus_i long, bus_j long")
    got = [tuple(r) for r in C.topology_report(buses, lines, trafos).collect()]
    assert got == [("isla_desconectada", "isla_1", ", ".join(f"N{i:03d}" for i in range(n + 1, 2 * n + 1)))]


@pytest.mark.parametrize("most", [3, 512])
def test_pairs_of_copies_are_not_shuffled(spark, most):
    words = [["A", "B"], ["B", "A", "A"], ["A"], ["A", "C", None], None, [], ["B", "C", "A"]]
    ends = [("A", "B"), ("B", "A"), ("A", "A"), ("C", "B"), ("A", None), (None, None), ("Z", "A")]
    features = [(i, words[i % len(words)]) for i in range(210)]
    lines = [(f"L{i}", *ends[i % len(ends)]) for i in range(140)]
    f, l = spark.createDataFrame(features, "feature_id long, tokens array<string>"), spark.createDataFrame(lines, "line_key string, token_i string, token_j string")
    out = L.token_pairs(l, f, **({} if most == 512 else {"most": most}))
    want = sorted((k, i) for k, a, b in lines for i, t in features if a and b and t and a in t and b in t)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 5000
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert above.count("Generate") == 2 and "Aggregate" not in above and "Join" not in above


def test_case_files_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(catalog_sources, "CASE_RECORDS", 200, raising=False)
    path = catalog_sources.rendered_cases(spark, SF).removeprefix("file:")
    files = glob(f"{path}/file=*/part-*")
    rows = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("part", "lineitem", "orders"))
    assert len(files) == -(-rows // 200) > 8
    lines = [Counter(x.strip() for x in open(f, encoding="latin-1") if "DATA" in x) for f in files]
    assert all(sum(c.values()) == 4 and len(c) == 4 for c in lines)
    assert catalog_sources.case_sections(spark, SF).count() == rows


def test_more_edges_make_more_tasks(spark, monkeypatch):
    """Both graph searches deal their edges out by their number, and find what they find in a few tasks."""
    edges = [(i, (i * 7 + 3) % 400) for i in range(400)] + [(i, i + 1) for i in range(500, 520)]
    graph = G.build_graph(spark.createDataFrame(edges, "i long, j long"))
    targets = spark.createDataFrame([(5, 132.0), (9, 500.0), (90, 500.0), (510, None)], "node long, kv double")
    few = sorted(map(tuple, G.reached(graph, targets).collect())), sorted(map(tuple, G.connected_components(graph).collect()))
    seen, cut = [], G.cut
    for name, value in {"TASK_EDGES": 40, "ONE_TASK_EDGES": 0, "BROADCAST_ROWS": 0}.items():
        monkeypatch.setattr(G, name, value, raising=False)
    monkeypatch.setattr(G, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    got = G.reached(graph, targets)
    assert max(df.rdd.getNumPartitions() for df in seen) == -(-graph.count() // 40)
    assert sorted(map(tuple, got.collect())) == few[0]
    way = G.nearest_target(graph, targets, paths=False)
    assert sorted(map(tuple, way.select("node", "dest", "kv", "hops").collect())) == few[0]
    seen.clear()
    assert sorted(map(tuple, G.connected_components(graph).collect())) == few[1]
    assert 2 * seen[0].count() == graph.count()  # an edge is carried once


def test_what_pairs_send_grows_as_the_tables(spark, monkeypatch):
    """Four times the lines and features make sixteen times the pairs, and are sent about four times as often as one."""
    seen, dealt = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *a: seen.append(df) or dealt(df, *a))
    monkeypatch.setattr(L, "BLOCK_PAIRS", 64, raising=False)
    monkeypatch.setattr(L, "RUN_LINES", 2, raising=False)
    for n in (150, 600):
        words, ends = [["A", "B"], ["C", "B", "A"], ["A"], ["A", None, "C"]], [("A", "B"), ("B", "A"), ("C", "A"), (None, "A")]
        features, lines = [(i, words[i % 4]) for i in range(n)], [(f"L{i:04d}", *ends[i % 4]) for i in range(n)]
        f = spark.createDataFrame(features, "feature_id long, tokens array<string>")
        out = L.token_pairs(spark.createDataFrame(lines, "line_key string, token_i string, token_j string"), f, most=4)
        want = sorted((k, i) for k, a, b in lines for i, t in features if a in t and b in t and a)
        assert sorted(map(tuple, out.collect())) == want
    small, large = (df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] for df in seen)
    assert large < 6 * small
