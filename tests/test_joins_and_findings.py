"""Containment joins on skewed tokens, candidates merged before the join, and rules over one scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import checks as C
from gridlake.operators import graph as G
from gridlake.operators import linkage as L


@pytest.mark.parametrize("most", [3, 4096])
def test_containment_on_skewed_tokens(spark, most):
    rng = random.Random(2)
    words = ["HOT"] * 30 + ["WARM"] * 8 + [f"T{i}" for i in range(25)]
    features = [(i, [rng.choice(words) for _ in range(rng.randrange(5))] if i % 40 else None) for i in range(600)]
    pairs = [("HOT", "WARM"), ("HOT", "HOT"), ("T1", "HOT"), ("WARM", "T2"), ("T3", "T4"), ("T3", "T3"), ("GONE", "HOT"), (None, "HOT"), ("T5", None), ("", "T1")]
    lines = [(f"L{i}", *pairs[i % len(pairs)]) for i in range(60)]
    f = spark.createDataFrame(features, "feature_id long, tokens array<string>")
    got = L.pair_features(spark.createDataFrame(lines, "line_key string, token_i string, token_j string"), f, most).collect()
    want = {(a, b, i) for a, b in pairs for i, t in features if a is not None and b is not None and t and a in t and b in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 100


def test_join_is_bounded_by_the_rarer_token(spark):
    """A token that every feature holds is never joined when the other is rare."""
    f = spark.range(20_000).select(F.col("id").alias("feature_id"), F.array(F.lit("ALL"), F.concat(F.lit("T"), (F.col("id") % 5000).cast("string"))).alias("tokens"))
    lines = spark.range(3000).select(F.col("id").alias("line_key"), F.lit("ALL").alias("token_i"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("token_j"))
    out = L.pair_features(lines, f)
    assert out.count() == 3000 * 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan


def test_candidates_are_one_row_a_prefix(spark):
    plants = [(f"ABCD{i:05d}", "TV") for i in range(2000)] + [("ABCDX", "HI"), ("EFGH1", "TV"), ("IJKL1", "HI"), ("IJKL2", "HI"), (None, "HI"), ("MNOP1", None)]
    p = spark.createDataFrame(plants, "plant_code string, plant_type string")
    got = {r._prefix: sorted(((k.plant_type or "", k.n, k.code) for k in r._kinds)) for r in L.candidates(p).filter("_prefix IS NOT NULL").collect()}
    assert got == {
        "ABCD": [("HI", 1, "ABCDX"), ("TV", 2, "ABCD00000")], "EFGH": [("TV", 1, "EFGH1")], "IJKL": [("HI", 2, "IJKL1")], "MNOP": [("", 1, "MNOP1")]
    }
    units = [("a", "abcd 1", "hydro"), ("b", "ABCD 2", "steam"), ("c", "EFGH", "hydro"), ("d", "IJKL", "hydro"), ("e", "ZZZZ", "hydro"), ("f", "MNOP", None), ("g", None, "hydro")]
    out = L.plant_matches(spark.createDataFrame(units, "gen_key string, bus_name string, carrier string"), p).collect()
    assert {r.gen_key: (r.plant_code, r.geo_match) for r in out} == {
        "a": ("ABCDX", "exacto"), "b": (None, "a_revisar"), "c": ("EFGH1", "exacto"), "d": (None, "a_revisar"), "e": (None, "sin_match"), "f": ("MNOP1", "exacto"), "g": (None, "sin_match")
    }


def test_case_quality(spark):
    buses = spark.createDataFrame([(1, "A", 1.0, 2.0), (2, "B", None, 2.0), (3, None, 1.0, float("nan"))], "bus_id long, bus_name string, lat double, lon double")
    trafos = spark.createDataFrame([(1, 2), (1, 2), (1, 10), (1, 11), (1, None)], "bus_i long, bus_j long")
    every = spark.createDataFrame([(i,) for i in (1, 2, 3, 10)], "bus_id long")
    loads = spark.createDataFrame([(0.2, 1.0), (-0.1, -1.0), (None, None)], "ip double, yp double")
    got = sorted(tuple(r) for r in C.case_quality(buses, trafos, every, loads).collect())
    assert got == [
        ("autotrafo", "B", "bus_j del nivel superior"),
        ("carga_no_constante", "ip", "0.1 MW"),
        ("secundario_ausente", "11", "bus_j no esta en el caso"),
        ("sin_coordenadas", "3", "lat o lon ausente"),
        ("sin_coordenadas", "B", "lat o lon ausente"),
    ]
    none = C.case_quality(buses.limit(0), trafos.limit(0), every, loads.limit(0))
    assert none.collect() == []


def test_each_table_is_scanned_once(spark, tmp_path):
    schema = {"buses": "bus_id long, bus_name string, lat double, lon double", "trafos": "bus_i long, bus_j long", "every": "bus_id long", "loads": "ip double, yp double"}
    tables = []
    for name, columns in schema.items():
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    plan = C.case_quality(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bus_i#") <= 1 and plan.count("Relation") <= 5  # the buses' names are looked up for the ends too


def test_long_islands_are_listed_in_part(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(i, 300) for i in range(300, 420)] + [(500, 500), (501, 500)], "node long, comp long")
    names = spark.createDataFrame([(i, f"N{i:03d}") for i in range(400)] + [(500, "B"), (501, "A")], "bus_id long, bus_name string")
    ranked = G.islands(labels)
    got = {r.elemento: r.detalle for r in C.island_findings(labels, ranked, names, 3).collect()}
    assert got == {"isla_1": "400, 401, 402, ... (120)", "isla_2": "A, B"}
    members = C.island_members(labels, ranked, names).collect()
    assert sorted(r.node for r in members if r.isla == "isla_1" and r.size == 120) == list(range(300, 420)) and len(members) == 122
