"""From the static network to the model: coordinates, drawn lines, checks, the network object, map layers, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.config import Study
from gridlake.functions import geometry as Y
from gridlake.functions import scalar as S
from gridlake.functions import text as X
from gridlake.operators import checks as C
from gridlake.operators import layers as M
from gridlake.operators import linkage as L
from gridlake.operators import static as O
from gridlake.sinks.gpkg import write_layer
from gridlake.sinks.netcdf import write_netcdf
from gridlake.sinks.tables import write_network


def final_buses(net: dict[str, DataFrame], manual: DataFrame) -> DataFrame:
    """Top-level buses with the manual coordinates, and secondary ones with their parent's.

    ``manual``: bus_id, name_geo, lat, lon.
    """
    top = O.with_coordinates(net["buses"], manual)
    places = O.with_parent_coordinates(top, net["secondary"]).select("bus_id", "bus_type", "parent_bus_id", "lat", "lon")
    nothing = F.lit(None).cast("string")
    facts = ["bus_id", "bus_name", "baskv_kv", "ide", "vm_pu", "va_deg"]
    own = top.select(*facts, nothing.alias("bus_name_raw"), "name_geo")
    low = net["secondary"].select(*facts, "bus_name_raw", nothing.alias("name_geo"))
    out = own.unionByName(low).withColumn("ide_desc", S.bus_type(F.col("ide")))
    return out.join(places.distinct(), "bus_id", "left").orderBy("bus_type", "bus_id")


def features(raw: DataFrame, aliases: dict[str, str | None]) -> DataFrame:
    """(feature_id, name, tokens, circuit, wkt) of line features (feature_id, name, parts)."""
    names = raw.select("name").distinct()
    names = names.withColumns({"tokens": X.alias_tokens(F.col("name"), aliases), "circuit": X.circuit_number(F.col("name"))})
    out = raw.join(names.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name")))
    return out.select("feature_id", "name", "tokens", "circuit", Y.line_wkt(Y.flat_parts(F.col("parts"))).alias("wkt"))


def drawn(lines: DataFrame, buses: DataFrame, found: DataFrame, manual: DataFrame) -> DataFrame:
    """Lines with geo_nombre, match_status and geometry of the features that hold both ends' names."""
    named = buses.select("bus_id", F.nullif(X.normalize_name(F.col("name_geo")), F.lit("")).alias("token"))
    return L.line_matches(O.attached(lines, named, "token"), found, manual).drop("token_i", "token_j")


def network_object(buses: DataFrame, lines: DataFrame, trafos: DataFrame, study: Study = Study()) -> dict[str, DataFrame]:
    """Component tables buses, lines, transformers."""
    nodes = buses.select(F.col("bus_name").alias("name"), F.col("baskv_kv").alias("v_nom"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit("AC").alias("carrier"))
    return {"buses": nodes, "lines": O.network_lines(lines, buses), "transformers": O.network_trafos(trafos, buses, study.default_s_nom)}


def model_layers(buses: DataFrame, lines: DataFrame, trafos: DataFrame) -> dict[str, DataFrame]:
    """Layers of the static model; transformers stand at their top-level bus."""
    top = buses.filter("bus_type = '500kV'")
    return {
        "buses_500kv": M.points(top),
        "buses_sec": M.points(buses.filter("bus_type = 'secundario'")),
        "lines_500kv": M.drawn_lines(lines),
        "trafos_500kv": M.points(M.at_bus(trafos, top, "bus_i")),
    }


def balance_layer(balance: DataFrame, buses: DataFrame) -> DataFrame:
    facts = buses.select("bus_id", "bus_type", "baskv_kv", "lat", "lon")
    rows = M.points(balance.drop("bus_type", "baskv_kv", "lat", "lon").join(facts, "bus_id", "left"))
    return rows.select("bus_id", "bus_name", "bus_type", "baskv_kv", "pg_mw", "pl_mw", "balance_mw", "n_gen", "n_load", "geometry")


def unit_layer(units: DataFrame, study: Study = Study()) -> DataFrame:
    """Units with coordinates, fictitious ones left out."""
    return M.points(units.filter(F.col("pt_mw") < study.fictitious_total_mw))


def component_layers(buses: DataFrame, lines: DataFrame, trafos: DataFrame, loads: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
    """Five layers of a network given by component tables.

    ``buses``: bus_id, baskv_kv, lat, lon.  ``lines``, ``trafos``: bus0, bus1; ``loads``, ``units``: bus.
    """
    kv = F.col("baskv_kv").try_cast("double")
    nodes = buses.withColumn("baskv_kv", kv)
    ends = M.between_buses(trafos.drop("v_kv", "v_class"), nodes).drop("straight")
    return {
        "buses": M.points(nodes.withColumns({"v_kv": kv, "v_class": S.voltage_class(kv)})),
        "lines": M.line_layer(lines, nodes),
        "transformers": M.points(M.at_bus(ends, nodes, "bus0")),
        "loads": M.attached_layer(loads, nodes),
        "generators": M.attached_layer(units, nodes),
    }


def write_layers(layers: dict[str, DataFrame], path: str, fresh: bool = True) -> dict[str, int]:
    """Writes the layers into one file, the first into a fresh one, and returns their numbers of rows."""
    return {name: write_layer(df, path, name, fresh=fresh and n == 0) for n, (name, df) in enumerate(layers.items())}


def write_model(path: str, model: dict[str, DataFrame]) -> dict[str, int]:
    """The network object as a Parquet folder; the rows of each component."""
    return write_network(path, model["buses"], model["lines"], model["transformers"])


def write_model_file(path: str, model: dict[str, DataFrame], title: str = "") -> None:
    """The network object as one netCDF file."""
    write_netcdf(path, {c: model[c] for c in ("buses", "lines", "transformers")}, title)


# ---- summaries of the stages


def bus_summary(buses: DataFrame) -> DataFrame:
    """Buses of each kind and voltage, with and without coordinates."""
    have = F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    out = buses.groupBy("bus_type", S.kv_label(F.col("baskv_kv")).alias("kv"))
    return out.agg(F.count(F.lit(1)).alias("n"), have.alias("located")).withColumn("unlocated", F.col("n") - F.col("located"))


def match_summary(units: DataFrame, study: Study = Study()) -> DataFrame:
    """Units, their share and MW of each kind of match; fictitious units count, without MW."""
    mw = F.sum(F.when(F.col("pt_mw") < study.fictitious_mw, F.abs("pt_mw")))
    kinds = units.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(mw, F.lit(0.0)).alias("mw"))
    total = kinds.agg(F.sum("n").alias("_all"))
    return kinds.crossJoin(F.broadcast(total)).withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.col("_all"), 2)).drop("_all")


def hop_summary(units: DataFrame) -> DataFrame:
    return units.filter("match_type = 'bfs'").groupBy("hops").agg(F.count(F.lit(1)).alias("n"))


def carrier_summary(units: DataFrame, study: Study = Study()) -> DataFrame:
    """Real units and MW of each carrier, with its control mode."""
    out = units.filter(F.col("pt_mw") < study.fictitious_mw).groupBy("carrier")
    out = out.agg(F.count(F.lit(1)).alias("n"), F.sum("pt_mw").alias("mw"))
    return out.withColumn("control", S.control_mode(F.col("carrier")))


def received(units: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` nodes that receive the most MW."""
    sums = units.filter("match_type != 'sin_conexion'").groupBy(F.col("dest").alias("bus_id"))
    sums = sums.agg(F.count(F.lit(1)).alias("n_gen"), F.sum(S.clipped_capacity(F.col("pt_mw"))).alias("mw"))
    return C.extreme(sums, "mw", n)
