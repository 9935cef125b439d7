from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from gridlake.config import Study
from gridlake.functions import geometry as Y
from gridlake.functions import scalar as S
from gridlake.functions.text import normalize_name, resolve_tokens
from gridlake.operators import checks as C
from gridlake.operators import graph as G
from gridlake.operators import linkage as L
from gridlake.operators import static as O
from gridlake.plans.static_network import network
from gridlake.sinks.gpkg import write_layer
from gridlake.sinks.tables import write_network, write_report
from gridlake.sources import case as R
from gridlake.sources.tables import read_line_features

CASE = """0, 100.0
CASE OF TESTS
SUMMER PEAK
0 / BEGIN BUS DATA
@ I,'NAME',BASKV,IDE,AREA,ZONE,OWNER,VM,VA
1,'NORTH, A    ',500.0,1,1,1,1,1.01,0.5
2,'SOUTH B     ',500.0,3,1,1,1,1.00,0.0

3,'FAR C       ',500.0,1,20,1,1,1.00,0.0
4,'OFF D       ',500.0,4,1,1,1,1.00,0.0
5,'WEST E      ',500.0,2,1,1,1,1.02,1.0
x,'BROKEN',500.0,1,1,1,1,1,0
10,'LOW 1       ',13.2,2,1,1,1,1.0,0.0
11,'LOW 2       ',13.2,2,1,1,1,1.0,0.0
12,'MID         ',132.0,1,1,1,1,1.0,0.0
13,'TERT        ',15.75,1,1,1,1,1.0,0.0
0 / END OF BUS DATA, BEGIN BRANCH DATA
1,2,'A ',0.001,0.01,0.5,'L1',100.0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1,1,12.5
1,2,'B ',0.001,-0.01,0.5,'L2',0.0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1,0.0
2,3,'1 ',0.001,0.01,0.5,'L3',100.0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1,1,9.0
0 / END OF BRANCH DATA, BEGIN TRANSFORMER DATA
1,10,0,'1 ',1,1,1,0,0,2,'T1',1,1,1
0.001,0.1,200
1,0,0
1,0
1,11,0,'1 ',1,1,1,0,0,2,'T2',1,1,1
0.002,0.2,100
1,0,0
1,0
12,2,13,'1 ',1,1,1,0,0,2,'T3',0,1,1
0.1,1.1,111,0.2,2.2,222,0.3,3.3,333
1,0,0
1,0,0
1,0,0
12,13,0,'1 ',1,1,1,0,0,2,'T4',1,1,1
0.2,0.2,1
1,0
1,0
0 / END OF TRANSFORMER DATA, BEGIN GENERATOR DATA
10,'1 ',50.0,0,0,0,0,0,0,0,0,0,0,0,1,0,60.0,0,6
0 / END OF GENERATOR DATA, BEGIN LOAD DATA
12,'1 ',1,1,1,30.5,0,0,0,0,0,1,1,0
0 / END OF LOAD DATA, BEGIN OWNER DATA
6,'HYDRO'
0 / END OF OWNER DATA, BEGIN AREA DATA
1,1,0,10,'HOME'
0 / END OF AREA DATA
"""


@pytest.fixture(scope="module")
def case(tmp_path_factory):
    path = tmp_path_factory.mktemp("case") / "mini.raw"
    path.write_bytes(CASE.encode("latin-1"))
    return str(path)


def test_sections(spark, case):
    buses = R.read_case(spark, case, "BUS").orderBy("rec_no").collect()
    assert [b.bus_id for b in buses] == [1, 2, 3, 4, 5, 10, 11, 12, 13]
    assert buses[0].bus_name == "NORTH, A" and buses[0].vm_pu == 1.01
    assert [r.line for r in R.corrupt_records(spark, case, "BUS").collect()] == ["x,'BROKEN',500.0,1,1,1,1,1,0"]
    assert R.read_header(spark, case).first().title == "SUMMER PEAK"
    gen = R.read_case(spark, case, "GENERATOR").first()
    assert (gen.bus_id, gen.pg_mw, gen.stat, gen.pt_mw, gen.owner) == (10, 50.0, 1, 60.0, 6)
    load = R.read_case(spark, case, "LOAD").first()
    assert (load.bus_id, load.stat, load.pl_mw) == (12, 1, 30.5)
    assert R.read_case(spark, case, "OWNER").first().owner_name == "HYDRO"
    assert R.read_case(spark, case, "AREA").first().area_name == "HOME"
    assert R.read_case(spark, case, "TRANSFORMER").count() == 4


def test_network(spark, case):
    n = network(spark, case, Study())
    assert {r.bus_id for r in n["buses"].collect()} == {1, 2, 5}
    lines = {r.line_key: r for r in n["lines"].collect()}
    assert set(lines) == {"NORTH, A-SOUTH B-1", "NORTH, A-SOUTH B-2"}
    comp = lines["NORTH, A-SOUTH B-2"]
    assert comp.element_type == "series_compensator" and comp.ratea_mva is None and comp.in_service and not comp.rating_defined
    assert sorted(r.line_id for r in lines.values()) == [1, 2]
    trafos = [(r.bus_i, r.bus_j, r.origin, r.r_pu) for r in n["trafos"].orderBy("trafo_id").collect()]
    assert trafos[:2] == [(1, 10, "2W", 0.001), (1, 11, "2W", 0.002)]
    assert set(trafos[2:]) == {(2, 12, "3W_decomp", 0.1), (2, 13, "3W_decomp", 0.2)}
    names = {r.bus_id: r.bus_name for r in n["secondary"].collect()}
    assert names == {10: "NORTH, A_13.2kV_1", 11: "NORTH, A_13.2kV_2", 12: "SOUTH B_132kV", 13: "SOUTH B_15.8kV"}
    assert network(spark, case, Study(keep_out_of_service=False))["lines"].count() == 1


def test_units(spark, case):
    from gridlake.plans import units as U

    n = network(spark, case)
    model = n["buses"].select("bus_id")
    gens = U.generators(spark, case, model).collect()
    assert [(g.gen_key, g.carrier, g.match_type, g.dest, g.hops, g.camino) for g in gens] == [("10-1", "hydro", "bfs", 1, 1, "LOW 1 -> NORTH, A")]
    rows = U.loads(spark, case, model)
    assert [(r.load_key, r.dest, r.hops) for r in rows.collect()] == [("12-1", 2, 1)]
    assert U.load_check(rows).first().loads == 1
    plants = spark.createDataFrame([("LOW 1", "Plant", "HI", -30.0, -60.0)], "plant_code string, plant_name string, plant_type string, lat double, lon double")
    ready = U.with_plants(U.generators(spark, case, model), plants)
    r = ready.first()
    assert r.ready and r.plant_name == "Plant" and r.falta is None
    assert U.point_layer(ready).first().geometry == "POINT (-60.000000 -30.000000)"
    balance = {b.bus_id: b.balance_mw for b in U.nodal_balance(model, U.generators(spark, case, model), rows).collect()}
    assert balance == {1: 50.0, 2: -30.5, 5: 0.0}
    assert U.capacity_by_carrier(ready).first().mw == 60.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "POINT (1.5 -2)"), ("b", 2, "LINESTRING (0 0, 1 1)"), ("c", 3, "")], "name string, n int, geometry string")
    path = str(tmp_path / "x.gpkg")
    assert write_layer(df, path, "things", fresh=True) == 2
    assert write_layer(df.limit(1), path, "points") == 1
    db = sqlite3.connect(path)
    assert db.execute("SELECT count(*) FROM gpkg_contents").fetchone()[0] == 2
    blob = db.execute("SELECT geom FROM points").fetchone()[0]
    assert blob[:2] == b"GP" and blob[8:] == Y.to_wkb("POINT (1.5 -2)")
    write_network(str(tmp_path / "net"), df, df, df)
    assert spark.read.parquet(str(tmp_path / "net/snapshots")).count() == 1
    empty = spark.createDataFrame([], "tipo string, elemento string, detalle string")
    write_report(empty, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 0


def test_geojson(spark, tmp_path):
    text = """{"features": [
      {"geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.5]]}, "properties": {"id": 1, "Nombre": "A - B 500 1", "Tension": 500}},
      {"geometry": {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6]]]}, "properties": {"id": 2, "Nombre": "C", "Tension": 500}},
      {"geometry": {"type": "LineString", "coordinates": [[1, 2]]}, "properties": {"id": 3, "Nombre": "D", "Tension": 132}},
      {"geometry": null, "properties": {"id": 4, "Nombre": "E", "Tension": 500}}]}"""
    path = tmp_path / "lines.json"
    path.write_text(text)
    rows = read_line_features(spark, str(path)).withColumn("wkt", Y.line_wkt(Y.flat_parts(F.col("parts")))).orderBy("feature_id").collect()
    assert [r.feature_id for r in rows] == [1, 2]
    assert rows[0].wkt == "LINESTRING (1.0 2.0, 3.0 4.5)"
    assert rows[1].wkt == "LINESTRING (1 2, 3 4, 5 6)"


def brute_nearest(edges, targets, start):
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    if start in targets:
        return start, 0
    seen, level, hops = {start}, {start}, 0
    while level:
        hops += 1
        level = {y for x in level if x not in targets or x == start for y in near.get(x, ())} - seen
        seen |= level
        hits = level & targets.keys()
        if hits:
            return min(hits, key=lambda t: (-(targets[t] or 0), t)), hops
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_target(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)]
    edges = [e for e in edges if e[0] != e[1]]
    nodes = {x for e in edges for x in e}
    targets = {t: rnd.choice([None, 132.0, 500.0]) for t in rnd.sample(sorted(nodes), 4)}
    graph = G.build_graph(spark.createDataFrame(edges, "i long, j long"))
    table = spark.createDataFrame(list(targets.items()), "node long, kv double")
    rows = {r.node: r for r in G.nearest_target(graph, table).collect()}
    pairs = {frozenset(e) for e in edges}
    for n in nodes:
        want = brute_nearest(edges, targets, n)
        assert (want is None) == (n not in rows)
        if want:
            assert (rows[n].dest, rows[n].hops) == want
            path = rows[n].path
            assert len(path) == rows[n].hops + 1 and path[0] == n and path[-1] == rows[n].dest
            assert all(frozenset(p) in pairs for p in zip(path, path[1:], strict=False))
    text = G.nearest_target(graph, table).select(G.rendered_path(F.col("path")).alias("p")).first().p
    assert all(x.isdigit() for x in text.split(" -> "))


def test_checks(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, comp long")
    names = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "bus_id long, bus_name string")
    found = C.island_findings(labels, G.islands(labels), names).collect()
    assert [(r.tipo, r.elemento, r.detalle) for r in found] == [("isla_desconectada", "isla_1", "C")]
    kinds = spark.createDataFrame([(3, "bus_aislado"), (1, "compensador")], "bus_id long, kind string")
    assert [r.elemento for r in C.isolated_findings(kinds, names).collect()] == ["C"]
    flags = spark.createDataFrame([(True,), (False,)], "in_service boolean")
    assert C.out_of_service(flags).count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([(None, None, None), ("nan", "Ñandú (A)_b°", 0.25), (" 7 ", "ß é", 15.75)], "a string, b string, c double")
    rows = df.select(
        S.is_missing(F.col("a")).alias("m"), S.safe_double(F.col("a"), 1.5).alias("d"), normalize_name(F.col("b")).alias("n"),
        S.voltage_class(F.col("c")).alias("v"), S.defined_rating(F.lit(0.0)).alias("r"),
    ).collect()
    assert [r.m for r in rows] == [True, True, False]
    assert [r.d for r in rows] == [1.5, 1.5, 7.0]
    assert [r.n for r in rows] == ["", "NANDU A B", "SS E"]
    assert [r.v for r in rows] == ["unknown", "<35 kV", "<35 kV"]
    assert all(r.r is None for r in rows)
    km = spark.range(1).select(S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("k")).first().k
    assert abs(km - 111.19) < 0.01


def test_tokens():
    aliases = {"A B": "AB", "ABC": "X", "B": None, "D E F": "DEF"}
    assert resolve_tokens("A B C".split(), aliases) == ["X"]
    assert resolve_tokens("A B Q".split(), aliases) == ["AB", "Q"]
    assert resolve_tokens("B D E F".split(), aliases) == ["DEF"]
    assert resolve_tokens([], aliases) == []


def test_preferred_plant(spark):
    units = spark.createDataFrame([("1", "ABCDX", "wind"), ("2", "ABCDY", "steam"), ("3", "ZZ", "wind")], "gen_key string, bus_name string, carrier string")
    plants = spark.createDataFrame([("ABCD1", "TV"), ("ABCD2", "TV"), ("ABCD3", "EO"), ("PREF", "HI")], "plant_code string, plant_type string")
    preferred = spark.createDataFrame([("abcdy", "pref"), ("ZZ", "gone")], "bus_name string, plant_code string")
    got = {r.gen_key: (r.plant_code, r.geo_match) for r in L.plant_matches(units, plants, preferred).collect()}
    assert got == {"1": ("ABCD3", "exacto"), "2": ("PREF", "exacto"), "3": (None, "sin_match")}


def test_numbered_and_suffix(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k long, o long")
    rows = O.numbered(df, "id", "k", "o").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 101))
    assert [(r.k, r.o) for r in rows] == sorted((r.k, r.o) for r in rows)
    names = {r.unique_key for r in O.unique_keys(df.select(F.col("k").cast("string").alias("k"), "o"), "k", "o").collect()}
    assert "0_A" in names and len(names) == 100


def test_entry():
    import __spark_entry__ as e

    assert "node_balance" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components_and_starts(spark, monkeypatch, one_task):
    monkeypatch.setattr(G, "ONE_TASK_EDGES", one_task)
    rnd = random.Random(9)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    graph = G.build_graph(spark.createDataFrame(edges, "i long, j long"))
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.comp for r in G.connected_components(graph).collect()}
    assert got == {x: find(x) for x in root}
    text = G.connected_components(graph.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))
    assert len({r.comp for r in text.collect()}) == len(set(got.values()))
    starts = [130, 999, edges[0][0]]
    found = {r.node: r.comp for r in G.components_of(spark.createDataFrame([(s,) for s in starts], "node long"), graph).collect()}
    assert found == {x: find(x) for x in root if find(x) in {find(130), find(edges[0][0])}} | {999: 999}
    assert G.connected_components(graph.limit(0)).count() == 0


def test_nearest_target_without_paths_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    graph = G.build_graph(spark.createDataFrame([(i, i + 1) for i in range(9)], "i long, j long"))
    targets = spark.createDataFrame([(0, 500.0)], "node long, kv double")
    rows = {r.node: r for r in G.nearest_target(graph, targets, paths=False).collect()}
    assert {n: (r.hops, r.parent) for n, r in rows.items()} == {0: (0, None)} | {i: (i, i - 1) for i in range(1, 10)}
    near = {r.node: r.path for r in G.nearest_target(graph, targets, most_hops=4).collect()}
    assert near == {i: list(range(i, -1, -1)) for i in range(5)}
    assert G.nearest_target(graph, targets.limit(0)).count() == 0


def test_topology_report(spark):
    buses = spark.createDataFrame(
        [(i, f"N{i}", "500kV") for i in range(1, 10)] + [(20, "S20", "secundario")], "bus_id long, bus_name string, bus_type string"
    )
    lines = [("a", 1, 2), ("b", 2, 3), ("c", 4, 5), ("gone", 1, 77), ("z", 8, 9)]
    lines = [(k, i, j, 0.0 if k == "z" else 0.1, 0.0 if k == "z" else 0.1, None if k == "b" else 9.0, "line", k != "a") for k, i, j in lines]
    lines.append(("s", 3, 6, 0.1, -0.1, 5.0, "series_compensator", True))
    lines = spark.createDataFrame(lines, "line_key string, bus_i long, bus_j long, r_pu double, x_pu double, ratea_mva double, element_type string, in_service boolean")
    trafos = spark.createDataFrame([("t", 7, 20), ("u", 78, 79)], "trafo_key string, bus_i long, bus_j long")
    spare = buses.unionByName(spark.createDataFrame([(10, "N10", "500kV")], buses.schema))
    got = sorted(tuple(r) for r in C.topology_report(spare, lines, trafos).collect())
    assert got == [
        ("bus_aislado", "N10", "sin lineas, compensadores ni transformadores"),
        ("impedancia_cero", "z", "r_pu=0 y x_pu=0"),
        ("isla_desconectada", "isla_1", "N4, N5"),
        ("isla_desconectada", "isla_2", "N8, N9"),
        ("isla_desconectada", "isla_3", "N10"),
        ("linea_huerfana", "gone", "buses ausentes: bus_j=77"),
        ("sin_rating", "b", "ratea_mva = NaN"),
        ("trafo_huerfano", "u", "buses ausentes: bus_i=78, bus_j=79"),
    ]
    notes = sorted(tuple(r) for r in C.topology_notes(spare, lines, trafos).collect())
    assert notes == [("compensador", "N6", "esperado"), ("fuera_de_servicio", "a", "in_service=False"), ("solo_trafo", "N7", "esperado")]


def test_model_to_the_end(spark, case, tmp_path):
    from gridlake.plans import model as P
    from gridlake.plans import units as U
    from gridlake.sources.tables import read_aliases

    net = network(spark, case)
    manual = spark.createDataFrame([(1, "North", -31.0, -60.0), (2, "South B", -32.5, -61.0)], "bus_id long, name_geo string, lat double, lon double")
    buses = P.final_buses(net, manual)
    rows = {r.bus_id: r for r in buses.collect()}
    assert [r.bus_id for r in buses.collect()] == [1, 2, 5, 10, 11, 12, 13]
    assert (rows[10].lat, rows[10].bus_type, rows[10].parent_bus_id) == (-31.0, "secundario", 1) and rows[5].lat is None
    (tmp_path / "aliases.csv").write_text("alias,canonical\nSOUTHB,SOUTH B\nSOUTH B,SOUTH B\nLINK,\n")
    aliases = read_aliases(spark, str(tmp_path / "aliases.csv"))
    assert aliases == {"SOUTHB": "SOUTH B", "SOUTH B": "SOUTH B", "LINK": None}
    (tmp_path / "lines.json").write_text(
        '{"features": [{"geometry": {"type": "LineString", "coordinates": [[-60, -31], [-61, -32.5]]},'
        ' "properties": {"id": 7, "Nombre": "Link North - South B 500 1", "Tension": 500}}]}'
    )
    found = P.features(read_line_features(spark, str(tmp_path / "lines.json")), aliases)
    assert found.first().tokens == ["NORTH", "SOUTH B"]
    by_hand = spark.createDataFrame([], "line_key string, feature_id long")
    lines = P.drawn(net["lines"], buses, found, by_hand)
    status = {r.line_key: (r.match_status, r.geometry) for r in lines.collect()}
    assert status == {"NORTH, A-SOUTH B-1": ("directo", "LINESTRING (-60 -31, -61 -32.5)"), "NORTH, A-SOUTH B-2": ("compensador", "")}
    model = P.network_object(buses, lines, net["trafos"])
    one = {r.name: r for r in model["lines"].collect()}["NORTH, A-SOUTH B-1"]
    assert (one.bus0, one.bus1, round(one.r, 6), round(one.x, 6), one.s_nom) == ("NORTH, A", "SOUTH B", 2.5, 25.0, 100.0)
    trafos = {r.bus1: r.s_nom for r in model["transformers"].collect()}
    assert trafos == {"NORTH, A_13.2kV_1": 200.0, "NORTH, A_13.2kV_2": 100.0, "SOUTH B_132kV": 111.0, "SOUTH B_15.8kV": 222.0}
    P.write_model(str(tmp_path / "model"), model)
    assert spark.read.parquet(str(tmp_path / "model/transformers")).count() == 4
    findings = {tuple(r)[:2] for r in C.topology_report(buses, net["lines"], net["trafos"]).collect()}
    assert findings == {("bus_aislado", "WEST E"), ("isla_desconectada", "isla_1"), ("sin_rating", "NORTH, A-SOUTH B-2")}
    layers = P.model_layers(buses, lines, net["trafos"])
    path = str(tmp_path / "model.gpkg")
    assert P.write_layers(layers, path) == {"buses_500kv": 2, "buses_sec": 4, "lines_500kv": 1, "trafos_500kv": 4}
    units = U.generators(spark, case, net["buses"].select("bus_id"))
    balance = U.nodal_balance(buses, units, U.loads(spark, case, net["buses"].select("bus_id")))
    assert P.write_layers({"balance": P.balance_layer(balance, buses)}, path, fresh=False) == {"balance": 6}
    plants = spark.createDataFrame([("LOW 1", "Plant", "HI", -30.0, -60.0)], "plant_code string, plant_name string, plant_type string, lat double, lon double")
    assert P.unit_layer(U.with_plants(units, plants)).first().geometry == "POINT (-60.000000 -30.000000)"
    assert P.bus_summary(buses).filter("kv = '500kV'").first().unlocated == 1
    named = [df.withColumnsRenamed({"bus_i": "bus0", "bus_j": "bus1"}) for df in (lines.drop("kv_i"), net["trafos"])]
    at = spark.createDataFrame([("l1", 12), ("l2", 5), ("l3", 999)], "name string, bus long")
    five = P.component_layers(buses, *named, at, at)
    assert {n: df.count() for n, df in five.items()} == {"buses": 6, "lines": 2, "transformers": 4, "loads": 1, "generators": 1}
    assert five["loads"].first().v_class == "132 kV" and five["transformers"].filter("v_class = '500 kV'").count() == 4


def test_table_files(spark, tmp_path):
    from gridlake.sinks.tables import write_csv, write_matched
    from gridlake.sources.tables import read_csv, read_text_csv, require

    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "n int, geometry string, x double").withColumn("match_status", F.lit("directo"))
    df = df.withColumn("geo_nombre", F.lit("g"))
    write_csv(df, str(tmp_path / "t"), ["x", "n"])
    assert sorted(read_csv(spark, str(tmp_path / "t"), "x double, n int").collect(), key=lambda r: r.n) == [(None, 1), (2.5, 2)]
    write_matched(df, str(tmp_path / "m"))
    text = read_text_csv(spark, str(tmp_path / "m"))
    assert text.columns == ["n", "x", "geo_nombre", "match_status", "geometry"]
    assert sorted(tuple(r) for r in text.collect()) == [("1", "", "g", "directo", "a"), ("2", "2.5", "g", "directo", "")]
    with pytest.raises(FileNotFoundError, match="absent_1.*absent_2"):
        require(spark, str(tmp_path / "absent_1"), str(tmp_path / "t"), str(tmp_path / "absent_2"))
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none.csv"), "a int")


def test_exact_median(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([None, float(rnd.randrange(50))])) for k in (1, 2, 3) for _ in range(k * 17)] + [(4, 7.5)]
    got = {r.k: (r.n, r["median"]) for r in C.exact_median(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()}
    for k in (1, 2, 3, 4):
        values = sorted(v for key, v in rows if key == k and v is not None)
        middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        assert got[k] == (len(values), middle)


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from gridlake import session

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isDefined():
            return False

    class Frame:
        class sparkSession:
            sparkContext = Context

            class conf:
                @staticmethod
                def get(key, default):
                    return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.cut(Frame)
