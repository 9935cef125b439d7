"""Units and loads of a case: carriers, nearest model node, plants, final table, nodal balance and map layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake import config
from gridlake.functions import geometry as Y
from gridlake.functions import scalar as S
from gridlake.operators import checks as C
from gridlake.operators import graph as G
from gridlake.operators import linkage as L
from gridlake.sources.case import read_sections


def case_graph(case: dict[str, DataFrame]) -> DataFrame:
    """Every branch and transformer winding of a case, whatever its status."""
    branch = case["BRANCH"].select(F.col("bus_i").alias("i"), F.col("bus_j").alias("j"))
    return G.build_graph(branch, case["TRANSFORMER"].select("i", "j", "k"))


def _nearest(case: dict[str, DataFrame], model: DataFrame) -> DataFrame:
    kv = case["BUS"].select(F.col("bus_id").alias("node"), F.col("baskv_kv").alias("kv"))
    targets = model.select(F.col("bus_id").alias("node")).distinct().join(kv, "node", "left")
    return G.nearest_target(case_graph(case), targets)


def _placed(units: DataFrame, nearest: DataFrame, every: DataFrame) -> DataFrame:
    """Units with their node, hops and the path by names, put together for nodes that carry a unit."""
    name = every.select("bus_id", "bus_name")
    used = nearest.join(units.select(F.col("bus_id").alias("node")), "node", "left_semi")
    steps = used.select(F.col("node").alias("bus_id"), F.posexplode("path").alias("n", "step"))
    steps = steps.join(name.select(F.col("bus_id").alias("step"), F.col("bus_name").alias("step_name")), "step", "left")
    text = F.coalesce("step_name", F.col("step").cast("string"))
    ways = steps.groupBy("bus_id").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("w"))
    ways = ways.select("bus_id", F.array_join(F.transform("w", lambda x: x["t"]), " -> ").alias("camino"))
    out = G.classify(units.withColumnRenamed("bus_id", "node"), nearest).withColumnRenamed("node", "bus_id")
    out = out.join(ways, "bus_id", "left").join(name, "bus_id", "left")
    dest = name.select(F.col("bus_id").alias("dest"), F.col("bus_name").alias("dest_name"))
    out = out.join(dest, "dest", "left")
    return out.withColumn("camino", F.when(F.col("match_type") == "bfs", F.col("camino")))


def generators(spark: SparkSession, path: str, model: DataFrame) -> DataFrame:
    """Home units with a carrier, each with its nearest model node.  ``model``: bus_id."""
    case = read_sections(spark, path, "BUS", "OWNER", "GENERATOR", "BRANCH", "TRANSFORMER")
    every = case["BUS"]
    owner = case["OWNER"].select("owner", "owner_name")
    units = L.home_units(case["GENERATOR"], every).join(owner, "owner", "left")
    known = S.lookup(config.OWNER_CARRIERS, F.col("owner"))
    carrier = F.coalesce(known, F.col("owner_name"), F.lit("unknown"))
    units = units.join(every.select("bus_id", F.col("bus_name").alias("_name")), "bus_id", "left")
    units = units.withColumn("carrier", S.resolved_carrier(carrier, F.col("_name"))).filter("carrier IS NOT NULL")
    units = units.withColumn("gen_key", F.concat_ws("-", F.col("bus_id").cast("string"), "unit_id"))
    units = units.select("gen_key", "bus_id", "carrier", "pg_mw", "pt_mw", "stat")
    return _placed(units, _nearest(case, model), every)


def loads(spark: SparkSession, path: str, model: DataFrame) -> DataFrame:
    """Home loads with their nearest model node."""
    case = read_sections(spark, path, "BUS", "LOAD", "BRANCH", "TRANSFORMER")
    every = case["BUS"]
    rows = L.home_units(case["LOAD"], every)
    rows = rows.withColumn("load_key", F.concat_ws("-", F.col("bus_id").cast("string"), "unit_id"))
    rows = rows.select("load_key", "bus_id", "stat", "pl_mw", "ip", "yp")
    return _placed(rows, _nearest(case, model), every)


def load_check(rows: DataFrame) -> DataFrame:
    """Sums of the constant-current and constant-admittance parts, which should be near 0."""
    return rows.agg(F.sum("ip").alias("ip_mw"), F.sum("yp").alias("yp_mw"), F.count(F.lit(1)).alias("loads"))


def with_plants(units: DataFrame, plants: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """Units with plant, coordinates, reviewed carrier, and whether they are ready or what they lack.

    ``plants``: plant_code, plant_name, plant_type, lat, lon.
    """
    found = L.plant_matches(units.select("gen_key", "bus_name", "carrier"), plants, preferred)
    one = L.first_of(plants, "plant_code", "plant_name")
    out = units.join(found, "gen_key", "left").join(one, "plant_code", "left")
    out = out.withColumn("carrier", S.reviewed_carrier(F.col("carrier"), F.col("plant_type")))
    return L.ready_split(out.withColumn("bus_conexion", F.col("dest")))


def nodal_balance(buses: DataFrame, units: DataFrame, loads_: DataFrame, fictitious_mw: float = config.Study.fictitious_mw) -> DataFrame:
    """Balance of the model's nodes from active, connected units and loads."""
    on = C.active_units(units, fictitious_mw).filter("match_type != 'sin_conexion'").withColumn("_at", F.col("dest"))
    off = loads_.filter("stat = 1 AND match_type != 'sin_conexion'").withColumn("_at", F.col("dest"))
    gen = on.select(F.col("_at").alias("bus_id"), "pg_mw")
    load = off.select(F.col("_at").alias("bus_id"), "pl_mw")
    return C.node_balance(buses, gen, load)


def point_layer(rows: DataFrame) -> DataFrame:
    """Rows with coordinates as points; rows without stay out."""
    return rows.withColumn("geometry", Y.point_wkt(F.col("lon"), F.col("lat"))).filter("geometry IS NOT NULL")


def capacity_by_carrier(units: DataFrame, fictitious_mw: float = config.Study.fictitious_total_mw) -> DataFrame:
    """Units and MW of each carrier, fictitious units left out of the MW."""
    real = F.when(F.col("pt_mw") < fictitious_mw, F.col("pt_mw"))
    return units.groupBy("carrier").agg(F.count(F.lit(1)).alias("units"), F.sum(real).alias("mw")).orderBy(F.col("mw").desc(), "carrier")
