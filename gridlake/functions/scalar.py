"""Column expressions; all are evaluated by the JVM and stay inside code generation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake import config


def lookup(table: dict, key: Column) -> Column:
    """Value of a fixed table, null where the key is missing."""
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


def bus_type(ide: Column) -> Column:
    return F.coalesce(lookup(config.BUS_TYPES, ide.cast("int")), F.lit("unknown"))


def country(area: Column) -> Column:
    return lookup(config.FOREIGN_AREAS, area.cast("int"))


def circuit(ckt: Column) -> Column:
    return F.coalesce(lookup(config.CIRCUIT_LETTERS, F.upper(ckt)), ckt)


def element_key(name_i: Column, id_i: Column, name_j: Column, id_j: Column, ckt: Column) -> Column:
    return F.concat_ws("-", F.coalesce(name_i, id_i.cast("string")), F.coalesce(name_j, id_j.cast("string")), ckt)


def element_type(x_pu: Column) -> Column:
    return F.when(x_pu < 0, "series_compensator").otherwise("line")


def defined_rating(rate: Column) -> Column:
    """The rating, null where the case says 0."""
    return F.nullif(rate, F.lit(0.0))


def in_service(status: Column, forced: bool) -> Column:
    return F.lit(True) if forced else F.coalesce(status == 1, F.lit(False))


def base_impedance(kv: Column) -> Column:
    return kv * kv / F.lit(config.SYSTEM_MVA)


def safe_double(x: Column, default: float = 0.0) -> Column:
    """The value as a double; the default for null, NaN or unreadable text."""
    return F.coalesce(F.nanvl(x.cast("string").try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def kv_label(kv: Column) -> Column:
    whole = F.concat(kv.cast("long").cast("string"), F.lit("kV"))
    return F.when(kv == F.floor(kv), whole).otherwise(F.format_string("%.1fkV", kv))


def voltage_class(kv: Column) -> Column:
    out = F.when(kv.isNull(), "unknown")
    for step in config.VOLTAGE_CLASSES:
        out = out.when(kv >= step, f"{step} kV")
    return out.otherwise(f"<{config.VOLTAGE_CLASSES[-1]} kV")


def is_missing(x: Column) -> Column:
    text = F.trim(x.cast("string"))
    return x.isNull() | (text == "") | (F.lower(text) == "nan")


def carrier_from_name(name: Column) -> Column:
    clean = F.upper(F.trim(name))
    long_code = (F.length(clean) >= 8) & (F.substring(clean, 5, 4) == config.NUCLEAR_CODE)
    short = F.when(F.length(clean) >= 6, lookup(config.NAME_CARRIERS, F.substring(clean, 5, 2)))
    return F.when(long_code, "nuclear").otherwise(short)


def resolved_carrier(carrier: Column, name: Column) -> Column:
    """The carrier if it generates, else the one in the name, else null."""
    known = list(config.OWNER_CARRIERS.values())
    return F.coalesce(F.when(carrier.isin(known), carrier), carrier_from_name(name))


def control_mode(carrier: Column) -> Column:
    return F.when(carrier.isin(config.VOLTAGE_CARRIERS), "PV").otherwise("PQ")


def clipped_capacity(mw: Column, most: float = 9990.0) -> Column:
    return F.when(F.abs(mw) < most, F.abs(mw)).otherwise(0.0)


def missing_reason(no_bus: Column, no_geo: Column) -> Column:
    return F.when(no_bus & no_geo, "ambos").when(no_geo, "geo").otherwise("bus")


def reviewed_carrier(carrier: Column, plant_type: Column) -> Column:
    mixed = (plant_type == "VG") & ~F.coalesce(carrier.isin("ocgt", "steam", "ccgt"), F.lit(False))
    return F.when(plant_type == "HB", "pumped_hydro").when(mixed, "VG_revisar").otherwise(carrier)


def prefix4(name: Column, trimmed: bool = True) -> Column:
    return F.substring(F.upper(F.trim(name) if trimmed else name), 1, 4)


def missing_ends(i: Column, known_i: Column, j: Column, known_j: Column) -> Column:
    """``bus_i=..., bus_j=...`` for the absent ends only."""
    return F.concat_ws(
        ", ",
        F.when(~known_i, F.concat(F.lit("bus_i="), i.cast("string"))),
        F.when(~known_j, F.concat(F.lit("bus_j="), j.cast("string"))),
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))
