"""Map layers: tables with a geometry as well-known text; rows without one stay out and are listed apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import geometry as Y
from gridlake.functions import scalar as S


def _known(lat: str = "lat", lon: str = "lon") -> Column:
    return F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)


def located(rows: DataFrame) -> DataFrame:
    """Rows with both coordinates."""
    return rows.filter(_known())


def unlocated(rows: DataFrame) -> DataFrame:
    """The other rows: a coordinate is null or NaN."""
    return rows.filter(~F.coalesce(_known(), F.lit(False)))


def points(rows: DataFrame) -> DataFrame:
    return located(rows).withColumn("geometry", Y.point_wkt(F.col("lon"), F.col("lat")))


def drawn_lines(lines: DataFrame) -> DataFrame:
    """Lines whose geometry is a line's text."""
    return lines.withColumn("geometry", Y.valid_line(F.col("geometry"))).filter("geometry IS NOT NULL")


def undrawn_lines(lines: DataFrame) -> DataFrame:
    """(line_key, match_status, reason) of the other lines: they have no geometry, or text that is no line."""
    none = F.coalesce(F.col("geometry"), F.lit("")) == ""
    out = lines.filter(none | Y.valid_line(F.col("geometry")).isNull())
    return out.select("line_key", "match_status", F.when(none, "sin geometria").otherwise("no parseable").alias("reason"))


def at_bus(rows: DataFrame, buses: DataFrame, bus: str = "bus", key: str = "bus_id") -> DataFrame:
    """Rows with lat, lon of the bus they are attached to; null where it is unknown."""
    place = buses.select(F.col(key).alias(bus), "lat", "lon")
    return rows.drop("lat", "lon").join(place, bus, "left")


def with_voltage(rows: DataFrame, buses: DataFrame, bus: str = "bus", key: str = "bus_id", kv: str = "baskv_kv") -> DataFrame:
    """Rows with v_kv and v_class of the bus they are attached to."""
    known = buses.select(F.col(key).alias(bus), F.col(kv).try_cast("double").alias("v_kv"))
    out = rows.join(known, bus, "left")
    return out.withColumn("v_class", S.voltage_class(F.col("v_kv")))


def between_buses(edges: DataFrame, buses: DataFrame, a: str = "bus0", b: str = "bus1", key: str = "bus_id") -> DataFrame:
    """Edges with v_kv, the higher voltage of their ends, its class, and straight, the line between them or null."""
    for end, n in ((a, "0"), (b, "1")):
        side = buses.select(F.col(key).alias(end), *[F.col(c).alias(f"_{c}{n}") for c in ("lat", "lon")], F.col("baskv_kv").alias(f"_kv{n}"))
        edges = edges.join(side, end, "left")
    straight = Y.segment_wkt(*[F.col(f"_{c}{n}") for n in "01" for c in ("lon", "lat")])
    out = edges.withColumns({"straight": straight, "v_kv": F.greatest("_kv0", "_kv1")})
    return out.withColumn("v_class", S.voltage_class(F.col("v_kv"))).drop(*[f"_{c}{n}" for n in "01" for c in ("lat", "lon", "kv")])


def line_layer(lines: DataFrame, buses: DataFrame, a: str = "bus0", b: str = "bus1", key: str = "bus_id") -> DataFrame:
    """Lines with their own geometry where it can be read, else straight ones; lines with neither stay out."""
    out = between_buses(lines.drop("v_kv", "v_class"), buses, a, b, key)
    own = Y.valid_line(F.col("geometry")) if "geometry" in lines.columns else F.lit(None).cast("string")
    return out.withColumn("geometry", F.coalesce(own, "straight")).drop("straight").filter("geometry IS NOT NULL")


def attached_layer(rows: DataFrame, buses: DataFrame, bus: str = "bus", key: str = "bus_id") -> DataFrame:
    """Loads or units as points at their bus, with its voltage."""
    return points(at_bus(with_voltage(rows, buses, bus, key), buses, bus, key))
