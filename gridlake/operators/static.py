"""Operators of the static network: branches, transformers, secondary buses, unique keys, per-unit conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlake import config
from gridlake.functions import scalar as S
from gridlake.session import cut


def study_buses(buses: DataFrame, study: config.Study, excluded: DataFrame | None = None) -> DataFrame:
    """Buses of the study's voltage range that are not isolated, with type text, country and the foreign flag.

    ``excluded``: a table of more bus names to leave out.
    """
    out = buses.filter(F.col("baskv_kv").between(study.kv_low, study.kv_high) & (F.col("ide") != 4))
    out = out.withColumns({"ide_desc": S.bus_type(F.col("ide")), "country": S.country(F.col("area"))})
    out = out.withColumn("is_international", F.col("country").isNotNull())
    if study.drop_foreign:
        out = out.filter(~F.col("is_international"))
    if study.excluded_buses:
        out = out.filter(~F.col("bus_name").isin(*study.excluded_buses))
    if excluded is not None:
        out = out.join(excluded.select("bus_name"), "bus_name", "left_anti")
    return out


def with_both_ends(edges: DataFrame, nodes: DataFrame, node: str = "bus_id", i: str = "bus_i", j: str = "bus_j") -> DataFrame:
    """Edges whose ends are both among ``nodes``."""
    for end in (i, j):
        edges = edges.join(nodes.select(F.col(node).alias(end)), end, "left_semi")
    return edges


def with_end_names(edges: DataFrame, nodes: DataFrame, node: str = "bus_id", name: str = "bus_name") -> DataFrame:
    """Edges with name_i and name_j, null where an end is unknown."""
    for end, out in (("bus_i", "name_i"), ("bus_j", "name_j")):
        edges = edges.join(nodes.select(F.col(node).alias(end), F.col(name).alias(out)), end, "left")
    return edges


def keyed(edges: DataFrame, key: str = "line_key") -> DataFrame:
    ends = [F.col(c) for c in ("name_i", "bus_i", "name_j", "bus_j")]
    return edges.withColumn(key, S.element_key(*ends, S.circuit(F.col("ckt"))))


def numbered(df: DataFrame, out: str, *order: str | Column) -> DataFrame:
    """Consecutive numbers from 1 in a global order, without sorting all rows in one task.

    Rows are range-partitioned by the order; each part's size is counted, and a row's number is its
    place in its part plus the sizes of the parts before.  Only the sizes reach one task.
    """
    ranged = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn(
        "_part", F.spark_partition_id()
    )
    ranged = cut(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(out, (place + F.col("_before")).cast("long")).drop("_part", "_before")


def decomposed(trafos: DataFrame, valid: DataFrame) -> DataFrame:
    """Two-winding rows of transformers that touch a valid bus.

    Two windings pass through; of three, the first of I, J, K that is valid is the reference side and
    two rows lead from it to the others.  Columns in: i, j, k (null or 0 for two windings), ckt and
    r/x/sbase of the windings 12, 23, 31.
    """
    ids = valid.select(F.col("bus_id").alias("_id")).distinct().withColumn("_in", F.lit(True))
    for w in "ijk":
        side = ids.select(F.col("_id").alias(f"_{w}"), F.col("_in").alias(f"in_{w}"))
        trafos = trafos.join(side, F.col(w) == F.col(f"_{w}"), "left").drop(f"_{w}")
    two = F.coalesce(F.col("k"), F.lit(0)) == 0

    def row(a: str, b: str, pair: str, origin: str) -> Column:
        values = [F.col(f"{v}{pair}").alias(n) for v, n in (("r", "r_pu"), ("x", "x_pu"), ("s", "sbase_mva"))]
        return F.struct(F.col(a).alias("bus_i"), F.col(b).alias("bus_j"), F.lit(origin).alias("origin"), *values)

    three = "3W_decomp"
    rows = (
        F.when(two, F.array(row("i", "j", "12", "2W")))
        .when(F.col("in_i"), F.array(row("i", "j", "12", three), row("i", "k", "31", three)))
        .when(F.col("in_j"), F.array(row("j", "i", "12", three), row("j", "k", "23", three)))
        .otherwise(F.array(row("k", "i", "31", three), row("k", "j", "23", three)))
    )
    touched = F.coalesce("in_i", "in_j", F.when(~two, F.col("in_k")))
    keep = [c for c in trafos.columns if c not in ("i", "j", "k") and c[0:3] != "in_" and c[1:] not in ("12", "23", "31")]
    return trafos.filter(touched).select(*keep, F.inline(rows))


def first_parent(trafos: DataFrame, order: str = "trafo_id") -> DataFrame:
    """(bus_j, parent): the first bus_i of each bus_j in the given order."""
    return trafos.groupBy("bus_j").agg(F.min_by("bus_i", order).alias("parent_bus_id"))


def secondary_names(rows: DataFrame) -> DataFrame:
    """Names ``parent_kV``, with a number where a parent has several buses of one voltage.

    Columns in: bus_id, parent_bus_id, parent_name, baskv_kv.
    """
    group = Window.partitionBy("parent_bus_id", "baskv_kv")
    number = F.row_number().over(group.orderBy("bus_id"))
    size = F.count(F.lit(1)).over(group)
    stem = F.concat_ws("_", "parent_name", S.kv_label(F.col("baskv_kv")))
    return rows.withColumn("bus_name", F.when(size > 1, F.concat_ws("_", stem, number.cast("string"))).otherwise(stem))


def unique_keys(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``key`` with _A, _B, ... in order where it occurs more than once (after Z: a number)."""
    group = Window.partitionBy(key)
    number = F.row_number().over(group.orderBy(*order))
    letter = F.when(number <= 26, F.char(F.lit(64) + number)).otherwise(number.cast("string"))
    suffixed = F.concat_ws("_", key, letter)
    return rows.withColumn("unique_key", F.when(F.count(F.lit(1)).over(group) > 1, suffixed).otherwise(F.col(key)))


def with_parent_coordinates(own: DataFrame, children: DataFrame) -> DataFrame:
    """Primary buses with their coordinates and secondary ones with their parent's."""
    parents = own.select(F.col("bus_id").alias("parent_bus_id"), "lat", "lon")
    child = children.select("bus_id", "parent_bus_id").join(parents, "parent_bus_id", "left")
    top = own.select("bus_id", F.lit("500kV").alias("bus_type"), F.lit(None).cast("long").alias("parent_bus_id"), "lat", "lon")
    low = child.select("bus_id", F.lit("secundario").alias("bus_type"), "parent_bus_id", "lat", "lon")
    return top.unionByName(low)


def with_coordinates(buses: DataFrame, manual: DataFrame) -> DataFrame:
    """Buses with lat, lon and name_geo of the manual table, null where it has none.

    ``manual``: bus_id, name_geo, lat, lon.  A bus that stands in it twice comes twice.
    """
    return buses.join(manual.select("bus_id", "name_geo", "lat", "lon"), "bus_id", "left")


def physical(lines: DataFrame, kv: str = "kv_i") -> DataFrame:
    """r, x in ohm and b in siemens of per-unit lines on the system base; unreadable values are 0."""
    z = S.base_impedance(F.col(kv))
    r, x, b = (S.safe_double(F.col(f"{c}_pu")) for c in "rxb")
    return lines.withColumns({"r": r * z, "x": x * z, "b": b / z, "s_nom": S.safe_double(F.col("ratea_mva"))})


def attached(edges: DataFrame, buses: DataFrame, *columns: str, a: str = "bus_i", b: str = "bus_j") -> DataFrame:
    """Edges with the named bus columns of both ends, as ``<column>_i`` and ``<column>_j``; null where an end is unknown."""
    for end, mark in ((a, "i"), (b, "j")):
        side = buses.select(F.col("bus_id").alias(end), *[F.col(c).alias(f"{c}_{mark}") for c in columns])
        edges = edges.join(side, end, "left")
    return edges


def network_lines(lines: DataFrame, buses: DataFrame) -> DataFrame:
    """Line components (name, bus0, bus1, r, x, b, s_nom): both ends known, and no line whose ends still lack a name."""
    known = with_both_ends(lines, buses).filter(~F.col("match_status").eqNullSafe("pendiente_bus"))
    out = physical(attached(known, buses, "bus_name", "baskv_kv"), "baskv_kv_i")
    ends = [F.col("bus_name_i").alias("bus0"), F.col("bus_name_j").alias("bus1")]
    return out.select(F.col("line_key").alias("name"), *ends, "r", "x", "b", "s_nom", "element_type")


def network_trafos(trafos: DataFrame, buses: DataFrame, default_s_nom: float = 100.0) -> DataFrame:
    """Transformer components (name, bus0, bus1, r, x in per unit, s_nom) under unique names, in the order of trafo_id.

    Names are made unique over all transformers, before those with an unknown end are left out.
    """
    named = with_both_ends(unique_keys(trafos, "trafo_key", "trafo_id"), buses)
    out = attached(named, buses, "bus_name")
    ends = [F.col("bus_name_i").alias("bus0"), F.col("bus_name_j").alias("bus1")]
    values = [S.safe_double(F.col(c)).alias(n) for c, n in (("r_pu", "r"), ("x_pu", "x"))]
    return out.select(F.col("unique_key").alias("name"), *ends, *values, S.safe_double(F.col("sbase_mva"), default_s_nom).alias("s_nom"))


def parallel_pairs(lines: DataFrame) -> DataFrame:
    """Directed pairs with more than one circuit, most circuits first."""
    pairs = lines.groupBy("bus_i", "bus_j").agg(F.count(F.lit(1)).alias("circuits")).filter("circuits > 1")
    return pairs.orderBy(F.col("circuits").desc(), "bus_i", "bus_j")
