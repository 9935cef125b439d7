"""Queries over the model's last stages on stand-in tables: coordinates, network object, layers, summaries.

Stand-ins: a part is a bus named by its key, placed for four keys out of five; an order is a line or a
transformer between parts; a line item is a unit or load at its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators import layers as M
from gridlake.operators import linkage as L
from gridlake.operators import static as O
from gridlake.plans import model as P
from gridlake.plans.registry import query, table
from gridlake.session import scratch
from gridlake.sinks.gpkg import read_layer, write_layer
from gridlake.sinks.netcdf import read_netcdf
from gridlake.sinks.tables import unit_metrics, write_stage

BUSES_SQL = """nodes AS (SELECT p_partkey AS bus_id, 'B' || p_partkey AS bus_name, CASE WHEN p_size > 9 THEN '500kV' ELSE 'secundario' END AS bus_type,
  CAST(p_size * 12 AS DOUBLE) AS baskv_kv FROM part),
placed AS (SELECT nodes.*, CASE WHEN bus_id % 5 != 0 THEN CAST(bus_id % 60 AS DOUBLE) - 30 END AS lat,
  CASE WHEN bus_id % 5 != 0 THEN CAST(bus_id % 90 AS DOUBLE) / 2 END AS lon FROM nodes)"""
POINT_SQL = "'POINT (' || printf('%.6f', lon) || ' ' || printf('%.6f', lat) || ')'"
LINES_SQL = """lines AS (SELECT 'L' || o_orderkey AS line_key, o_custkey AS bus_i, CAST(floor(o_totalprice) AS BIGINT) % 3000 AS bus_j, o_totalprice / 1000 AS r_pu,
  CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS x_pu, CASE WHEN o_orderkey % 5 != 0 THEN 0.25::DOUBLE END AS b_pu,
  CASE WHEN o_orderkey % 4 != 0 THEN CAST(o_orderkey % 500 AS DOUBLE) END AS ratea_mva,
  CASE o_orderstatus WHEN 'P' THEN 'pendiente_bus' WHEN 'F' THEN 'directo' END AS match_status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'LINESTRING (0 1, 2.5 -3)' WHEN o_orderkey % 3 = 1 THEN 'LINESTRING (broken' END AS geometry FROM orders)"""


def nodes(spark, d) -> DataFrame:
    kind = F.when(F.col("p_size") > 9, "500kV").otherwise("secundario")
    name = F.concat(F.lit("B"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("bus_id"), name.alias("bus_name"), kind.alias("bus_type"), (F.col("p_size") * 12).cast("double").alias("baskv_kv")
    )


def placed(spark, d) -> DataFrame:
    """The buses with the coordinates of the manual table."""
    key = F.col("p_partkey")
    manual = table(spark, d, "part").filter(key % 5 != 0).select(
        key.alias("bus_id"), F.col("p_name").alias("name_geo"), ((key % 60).cast("double") - 30).alias("lat"), ((key % 90).cast("double") / 2).alias("lon")
    )
    return O.with_coordinates(nodes(spark, d), manual)


def lines(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "pendiente_bus").when(F.col("o_orderstatus") == "F", "directo")
    return table(spark, d, "orders").select(
        F.concat(F.lit("L"), key.cast("string")).alias("line_key"), F.col("o_custkey").alias("bus_i"),
        (F.floor("o_totalprice").cast("long") % 3000).alias("bus_j"), (F.col("o_totalprice") / 1000).alias("r_pu"),
        F.when(key % 7 == 0, "x").otherwise((key % 100).cast("string")).alias("x_pu"), F.when(key % 5 != 0, 0.25).alias("b_pu"),
        F.when(key % 4 != 0, (key % 500).cast("double")).alias("ratea_mva"), status.alias("match_status"),
        F.when(key % 3 == 0, "LINESTRING (0 1, 2.5 -3)").when(key % 3 == 1, "LINESTRING (broken").alias("geometry"),
        F.lit("line").alias("element_type"),
    )


@query(f"WITH {BUSES_SQL} SELECT placed.*, CASE WHEN lat IS NOT NULL THEN p_name END AS name_geo FROM placed JOIN part ON p_partkey = bus_id")
def bus_coordinates(spark, d):
    return placed(spark, d)


@query(f"WITH {BUSES_SQL} SELECT bus_id, lat IS NOT NULL AS present FROM placed")
def coordinate_split(spark, d):
    buses = placed(spark, d)
    some, none = M.located(buses), M.unlocated(buses)
    return some.select("bus_id", F.lit(True).alias("present")).unionByName(none.select("bus_id", F.lit(False).alias("present")))


@query(
    f"""WITH {BUSES_SQL}, {LINES_SQL} SELECT line_key AS name, a.bus_name AS bus0, b.bus_name AS bus1, round(r_pu * a.baskv_kv * a.baskv_kv / 100, 4) AS r,
    round(coalesce(TRY_CAST(x_pu AS DOUBLE), 0) * a.baskv_kv * a.baskv_kv / 100, 4) AS x, coalesce(b_pu, 0) / (a.baskv_kv * a.baskv_kv / 100) AS b,
    coalesce(ratea_mva, 0.0) AS s_nom FROM lines JOIN nodes a ON a.bus_id = bus_i JOIN nodes b ON b.bus_id = bus_j
    WHERE match_status IS NULL OR match_status != 'pendiente_bus'"""
)
def network_lines(spark, d):
    out = O.network_lines(lines(spark, d), nodes(spark, d)).drop("element_type")
    return out.withColumns({"r": F.round("r", 4), "x": F.round("x", 4)})


@query(
    f"""WITH {BUSES_SQL}, {LINES_SQL} SELECT 'buses' AS component, bus_name AS name, CAST(NULL AS VARCHAR) AS bus0, baskv_kv AS v, lon AS x FROM placed
    UNION ALL SELECT 'lines', line_key, a.bus_name, coalesce(ratea_mva, 0.0), round(coalesce(TRY_CAST(x_pu AS DOUBLE), 0) * a.baskv_kv * a.baskv_kv / 100, 4)
    FROM lines JOIN nodes a ON a.bus_id = bus_i JOIN nodes b ON b.bus_id = bus_j WHERE match_status IS NULL OR match_status != 'pendiente_bus'"""
)
def network_file(spark, d):
    """Buses and lines of the network object, written to a netCDF file by tasks and read back in slices."""
    at = placed(spark, d)
    model = P.network_object(at, lines(spark, d), table(spark, d, "orders").limit(0).selectExpr(
        "o_orderkey AS trafo_id", "o_orderkey AS bus_i", "o_orderkey AS bus_j", "'T' AS trafo_key", "'0' AS r_pu", "'0' AS x_pu", "1.0D AS sbase_mva"))
    path = f"{scratch(spark, 'network')}.nc"
    P.write_model_file(path, model)
    buses, edges = (read_netcdf(spark, path, c) for c in ("buses", "lines"))
    own = buses.select(F.lit("buses").alias("component"), "name", F.lit(None).cast("string").alias("bus0"), F.col("v_nom").alias("v"), "x")
    return own.unionByName(edges.select(F.lit("lines").alias("component"), "name", "bus0", F.col("s_nom").alias("v"), F.round("x", 4).alias("x")))


@query(
    f"""WITH {BUSES_SQL}, t AS (SELECT o_orderkey AS id, o_custkey AS i, CAST(floor(o_totalprice) AS BIGINT) % 3000 AS j, 'T' || o_custkey AS k,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c,
      CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 400 AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN 'NaN'::DOUBLE END AS s FROM orders)
    SELECT CASE WHEN c > 1 THEN k || '_' || CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) ELSE CAST(n AS VARCHAR) END ELSE k END AS name,
    a.bus_name AS bus0, b.bus_name AS bus1, 0.5::DOUBLE AS r, 0.0::DOUBLE AS x, CASE WHEN s IS NULL OR isnan(s) THEN 100.0 ELSE s END AS s_nom
    FROM t JOIN nodes a ON a.bus_id = i JOIN nodes b ON b.bus_id = j"""
)
def network_transformers(spark, d):
    key = F.col("o_orderkey")
    size = F.when(key % 3 == 0, (key % 400).cast("double")).when(key % 3 == 1, float("nan"))
    trafos = table(spark, d, "orders").select(
        key.alias("trafo_id"), F.col("o_custkey").alias("bus_i"), (F.floor("o_totalprice").cast("long") % 3000).alias("bus_j"),
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("trafo_key"), F.lit(0.5).alias("r_pu"), F.lit("?").alias("x_pu"), size.alias("sbase_mva"),
    )
    return O.network_trafos(trafos, nodes(spark, d))


@query(
    f"""WITH {BUSES_SQL}, {LINES_SQL} SELECT line_key, CASE WHEN geometry IS NULL THEN 'sin geometria' WHEN geometry = 'LINESTRING (broken' THEN 'no parseable'
    ELSE 'dibujada' END AS reason FROM lines"""
)
def drawn_and_undrawn_lines(spark, d):
    rows = lines(spark, d)
    good = M.drawn_lines(rows).select("line_key", F.lit("dibujada").alias("reason"))
    return good.unionByName(M.undrawn_lines(rows).select("line_key", "reason"))


_STRAIGHT_SQL = """'LINESTRING (' || printf('%.6f', a.lon) || ' ' || printf('%.6f', a.lat) || ', ' || printf('%.6f', b.lon) || ' ' || printf('%.6f', b.lat) || ')'"""
_CLASS_SQL = """CASE WHEN v_kv IS NULL THEN 'unknown' WHEN v_kv >= 500 THEN '500 kV' WHEN v_kv >= 345 THEN '345 kV' WHEN v_kv >= 330 THEN '330 kV'
    WHEN v_kv >= 220 THEN '220 kV' WHEN v_kv >= 132 THEN '132 kV' WHEN v_kv >= 110 THEN '110 kV' WHEN v_kv >= 66 THEN '66 kV' WHEN v_kv >= 35 THEN '35 kV'
    ELSE '<35 kV' END"""


@query(
    f"""WITH {BUSES_SQL}, {LINES_SQL}, x AS (SELECT line_key, CASE WHEN geometry LIKE '%)' THEN geometry ELSE {_STRAIGHT_SQL} END AS geometry,
      greatest(a.baskv_kv, b.baskv_kv) AS v_kv FROM lines LEFT JOIN placed a ON a.bus_id = bus_i LEFT JOIN placed b ON b.bus_id = bus_j)
    SELECT line_key, geometry, v_kv, {_CLASS_SQL} AS v_class FROM x WHERE geometry IS NOT NULL"""
)
def line_layer(spark, d):
    """Own geometries, straight lines between both ends' coordinates where there is none, nothing where an end has no place."""
    out = M.line_layer(lines(spark, d), placed(spark, d), "bus_i", "bus_j")
    return out.select("line_key", "geometry", "v_kv", "v_class")


@query(
    f"""WITH {BUSES_SQL}, x AS (SELECT l_orderkey, l_linenumber, baskv_kv AS v_kv, lat, lon FROM lineitem LEFT JOIN placed ON bus_id = l_partkey + 7)
    SELECT l_orderkey, l_linenumber, v_kv, {_CLASS_SQL} AS v_class, {POINT_SQL} AS geometry FROM x WHERE lat IS NOT NULL"""
)
def attached_layer(spark, d):
    """All line items as units at a bus, with its voltage and place; those at an unknown or unplaced bus stay out."""
    units = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 7).alias("bus"))
    return M.attached_layer(units, placed(spark, d)).select("l_orderkey", "l_linenumber", "v_kv", "v_class", "geometry")


@query(
    f"""WITH {BUSES_SQL} SELECT 'buses_500kv' AS layer, 'B' || bus_id AS name, {POINT_SQL} AS geometry FROM placed WHERE lat IS NOT NULL AND bus_type = '500kV'
    UNION ALL SELECT 'buses_sec', 'B' || bus_id, {POINT_SQL} FROM placed WHERE lat IS NOT NULL AND bus_type = 'secundario'
    UNION ALL SELECT 'lines_500kv', 'L' || o_orderkey, 'LINESTRING (0 1, 2.5 -3)' FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'trafos_500kv', 'T' || o_orderkey, {POINT_SQL} FROM orders JOIN placed ON bus_id = o_custkey WHERE lat IS NOT NULL AND bus_type = '500kV'"""
)
def model_layers(spark, d):
    key = F.concat(F.lit("T"), F.col("o_orderkey").cast("string"))
    trafos = table(spark, d, "orders").select(key.alias("trafo_key"), F.col("o_custkey").alias("bus_i"))
    found = P.model_layers(placed(spark, d), lines(spark, d), trafos)
    names = {"buses_500kv": "bus_name", "buses_sec": "bus_name", "lines_500kv": "line_key", "trafos_500kv": "trafo_key"}
    out = None
    for layer, name in names.items():
        rows = found[layer].select(F.lit(layer).alias("layer"), F.col(name).alias("name"), "geometry")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""WITH {BUSES_SQL} SELECT bus_type, CASE WHEN baskv_kv = floor(baskv_kv) THEN CAST(CAST(baskv_kv AS BIGINT) AS VARCHAR) || 'kV' END AS kv, count(*) AS n,
    count(lat) AS located, count(*) - count(lat) AS unlocated FROM placed GROUP BY 1, 2"""
)
def bus_summary(spark, d):
    return P.bus_summary(placed(spark, d))


def placed_units(spark, d) -> DataFrame:
    number = F.col("l_linenumber")
    kind = F.when(number % 3 == 0, "directo").when(number % 3 == 1, "bfs").otherwise("sin_conexion")
    carrier = F.when(number % 2 == 0, "hydro").otherwise("solar")
    return table(spark, d, "lineitem").select(
        kind.alias("match_type"), carrier.alias("carrier"), (F.round(F.col("l_extendedprice") / 8) - 500).alias("pt_mw"), (number % 4).alias("hops"),
        F.col("l_suppkey").alias("dest"),
    )


UNITS_SQL = """u AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'directo' WHEN 1 THEN 'bfs' ELSE 'sin_conexion' END AS match_type,
  CASE WHEN l_linenumber % 2 = 0 THEN 'hydro' ELSE 'solar' END AS carrier, round(l_extendedprice / 8) - 500 AS pt_mw, l_linenumber % 4 AS hops, l_suppkey AS dest FROM lineitem)"""


@query(
    f"""WITH {UNITS_SQL} SELECT match_type, count(*) AS n, coalesce(sum(abs(pt_mw)) FILTER (pt_mw < 9990), 0.0) AS mw,
    round(100.0 * count(*) / (SELECT count(*) FROM u), 2) AS pct FROM u GROUP BY 1"""
)
def match_summary(spark, d):
    return P.match_summary(placed_units(spark, d))


@query(
    f"""WITH {UNITS_SQL}, k AS (SELECT match_type, count(*) AS n, coalesce(sum(abs(pt_mw)) FILTER (pt_mw < 9990), 0.0) AS mw FROM u GROUP BY 1)
    SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM u UNION ALL SELECT match_type, n FROM k UNION ALL SELECT 'mw_' || match_type, mw FROM k"""
)
def stage_counts(spark, d):
    """What a stage prints of its units, counted in the pass that writes them."""
    seen = write_stage(placed_units(spark, d), scratch(spark, "units"), unit_metrics())
    return spark.createDataFrame([(k, float(v)) for k, v in seen.items()], "metric string, value double")


@query(
    f"""WITH {BUSES_SQL} SELECT bus_id, bus_name, lon, lat FROM placed WHERE lon BETWEEN 10 AND 20 AND lat BETWEEN -10 AND 5"""
)
def map_window(spark, d):
    """Buses in a window of the map, looked up by the spatial index of the file they were written to."""
    path = f"{scratch(spark, 'map')}.gpkg"
    at = placed(spark, d)
    write_layer(M.points(at).select("bus_id", "bus_name", "lon", "lat", "geometry"), path, "buses", fresh=True)
    return read_layer(spark, path, "buses", (10, 20, -10, 5)).select("bus_id", "bus_name", "lon", "lat")


@query(f"WITH {UNITS_SQL} SELECT hops, count(*) AS n FROM u WHERE match_type = 'bfs' GROUP BY 1")
def hop_summary(spark, d):
    return P.hop_summary(placed_units(spark, d))


@query(
    f"""WITH {UNITS_SQL} SELECT carrier, count(*) AS n, sum(pt_mw) AS mw, CASE WHEN carrier = 'hydro' THEN 'PV' ELSE 'PQ' END AS control
    FROM u WHERE pt_mw < 9990 GROUP BY 1"""
)
def carrier_summary(spark, d):
    return P.carrier_summary(placed_units(spark, d))


@query(
    f"""WITH {UNITS_SQL} SELECT dest AS bus_id, count(*) AS n_gen, sum(CASE WHEN abs(pt_mw) < 9990 THEN abs(pt_mw) ELSE 0 END) AS mw FROM u
    WHERE match_type != 'sin_conexion' GROUP BY 1 ORDER BY mw DESC, bus_id LIMIT 10"""
)
def received_power(spark, d):
    return P.received(placed_units(spark, d))


@query(
    """WITH s AS (SELECT p_name AS plant_name, sum(p_size / 4.0::DOUBLE) AS energy_gwh FROM part WHERE p_name NOT LIKE 'red%' GROUP BY 1)
    SELECT c_custkey, plant_name, energy_gwh FROM (SELECT c_custkey, p_name AS plant_name FROM customer LEFT JOIN part ON p_partkey = c_custkey) LEFT JOIN s USING (plant_name)"""
)
def yearly_production(spark, d):
    part = table(spark, d, "part")
    units = table(spark, d, "customer").join(part, F.col("p_partkey") == F.col("c_custkey"), "left").select("c_custkey", F.col("p_name").alias("plant_name"))
    production = part.filter("p_name NOT LIKE 'red%'").select(F.col("p_name").alias("plant_name"), (F.col("p_size") / 4).alias("energy_gwh"))
    return L.with_production(units, production)
