"""Topology checks (tipo, elemento, detalle) and nodal balances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlake.functions import scalar as S
from gridlake.operators.graph import build_graph, components_of, islands, isolated
from gridlake.operators.static import numbered
from gridlake.session import cut


def rule(tipo: str, elemento: Column, detalle: Column, when: Column) -> Column:
    """A finding where the condition holds (null counts as not), else null."""
    return F.when(when, F.struct(F.lit(tipo).alias("tipo"), elemento.alias("elemento"), detalle.alias("detalle")))


def findings(rows: DataFrame, *rules: Column) -> DataFrame:
    """All rules over one scan: a row's findings are made as an array and exploded."""
    return rows.select(F.explode(F.array_compact(F.array(*rules))).alias("f")).select("f.*")


def with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("bus_id").distinct()
    for end in ("i", "j"):
        side = ids.select(F.col("bus_id").alias(f"_{end}"))
        edges = edges.join(side, F.col(f"bus_{end}") == F.col(f"_{end}"), "left")
        edges = edges.withColumn(f"known_{end}", F.col(f"_{end}").isNotNull()).drop(f"_{end}")
    return edges


def orphan(tipo: str, key: str) -> Column:
    absent = S.missing_ends(F.col("bus_i"), F.col("known_i"), F.col("bus_j"), F.col("known_j"))
    return rule(tipo, F.col(key), F.concat(F.lit("buses ausentes: "), absent), ~(F.col("known_i") & F.col("known_j")))


def _zero(also: Column) -> Column:
    none = (F.col("r_pu") == 0) & (F.col("x_pu") == 0) & (F.col("element_type") != "series_compensator")
    return rule("impedancia_cero", F.col("line_key"), F.lit("r_pu=0 y x_pu=0"), none & also)


def _unrated(also: Column) -> Column:
    return rule("sin_rating", F.col("line_key"), F.lit("ratea_mva = NaN"), F.col("ratea_mva").isNull() & also)


def _off(also: Column) -> Column:
    return rule("fuera_de_servicio", F.col("line_key"), F.lit("in_service=False"), ~F.col("in_service") & also)


def orphans(edges: DataFrame, nodes: DataFrame, tipo: str, key: str) -> DataFrame:
    return findings(with_known_ends(edges, nodes), orphan(tipo, key))


def zero_impedance(lines: DataFrame) -> DataFrame:
    return findings(lines, _zero(F.lit(True)))


def no_rating(lines: DataFrame) -> DataFrame:
    return findings(lines, _unrated(F.lit(True)))


def out_of_service(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("in_service"))


def isolated_findings(kinds: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``kinds``: bus_id, kind and, without ``names``, bus_name: the name of the row itself, as buses of another type may share its id."""
    if names is not None:
        kinds = kinds.join(names.select("bus_id", "bus_name"), "bus_id", "left")
    label = F.coalesce("bus_name", F.col("bus_id").cast("string"))
    return findings(kinds.filter("kind = 'bus_aislado'"), rule("bus_aislado", label, F.lit("sin lineas, compensadores ni transformadores"), F.lit(True)))


def island_members(labels: DataFrame, ranked: DataFrame, names: DataFrame) -> DataFrame:
    """(isla, size, node, name) of every node outside the main component; a node whose id has several names is a row, and counts, for each."""
    rows = labels.join(ranked.filter("rank > 1").select("comp", "isla"), "comp")
    rows = rows.join(names.select(F.col("bus_id").alias("node"), "bus_name"), "node", "left")
    rows = rows.join(rows.groupBy("isla").agg(F.count(F.lit(1)).alias("size")), "isla")
    return rows.select("isla", "size", "node", F.coalesce("bus_name", F.col("node").cast("string")).alias("name"))


def island_findings(labels: DataFrame, ranked: DataFrame, names: DataFrame, listed: int | None = None) -> DataFrame:
    """One finding an island: all its names in their order; with ``listed``, of a larger one the first so many and the number of its nodes."""
    rows, more = island_members(labels, ranked, names), F.lit("")
    if listed is not None:
        place = F.row_number().over(Window.partitionBy("isla").orderBy("name", "node"))
        rows = rows.withColumn("_place", place).filter(F.col("_place") <= listed)
        more = F.when(F.col("size") > listed, F.concat(F.lit(", ... ("), F.col("size").cast("string"), F.lit(")"))).otherwise("")
    names = F.array_sort(F.collect_list(F.struct("name", "node")))
    rows = rows.groupBy("isla", "size").agg(F.array_join(F.transform(names, lambda x: x["name"]), ", ").alias("names"))
    return findings(rows, rule("isla_desconectada", F.col("isla"), F.concat("names", more), F.lit(True)))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def line_graph(lines: DataFrame) -> DataFrame:
    return build_graph(lines, i="bus_i", j="bus_j")


def marked(buses: DataFrame, lines: DataFrame, trafos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines and transformers with known_i, known_j, each scanned and joined with the buses once, and the kinds of the top-level buses without a line."""
    columns = ["line_key", "bus_i", "bus_j", "r_pu", "x_pu", "ratea_mva", "element_type", "in_service"]
    lines = cut(with_known_ends(lines.select([c for c in columns if c in lines.columns]), buses))
    trafos = cut(with_known_ends(trafos.select("trafo_key", "bus_i", "bus_j"), buses))
    valid, comp = F.col("known_i") & F.col("known_j"), F.col("element_type") == "series_compensator"
    top = buses.filter("bus_type = '500kV'").select("bus_id", "bus_name")
    return lines, trafos, isolated(top, lines.filter(valid & ~comp), lines.filter(valid & comp), trafos)


def topology_report(buses: DataFrame, lines: DataFrame, trafos: DataFrame) -> DataFrame:
    """All findings: lines and transformers without a bus, isolated buses, islands, zero impedances, missing ratings.

    ``buses``: bus_id, bus_name, bus_type.  Islands are the components, over valid lines and
    compensators, of the top-level buses that are neither a compensator's bar nor at transformers only;
    such buses are passed through and counted.
    """
    lines, trafos, kinds = marked(buses, lines, trafos)
    kinds = cut(kinds)
    valid = F.col("known_i") & F.col("known_j")
    starts = buses.filter("bus_type = '500kV'").select("bus_id").join(kinds.filter("kind != 'bus_aislado'"), "bus_id", "left_anti")
    labels = cut(components_of(starts.withColumnRenamed("bus_id", "node"), line_graph(lines.filter(valid))))
    return report(
        findings(lines, orphan("linea_huerfana", "line_key"), _zero(valid), _unrated(valid)),
        findings(trafos, orphan("trafo_huerfano", "trafo_key")),
        isolated_findings(kinds),
        island_findings(labels, islands(labels), buses),
    )


def topology_notes(buses: DataFrame, lines: DataFrame, trafos: DataFrame) -> DataFrame:
    """What the report only mentions: lines out of service, bars of compensators, buses at transformers only."""
    lines, _, kinds = marked(buses, lines, trafos)
    off = findings(lines, _off(F.col("known_i") & F.col("known_j")))
    expected = kinds.filter("kind != 'bus_aislado'")
    name = F.coalesce("bus_name", F.col("bus_id").cast("string"))
    return off.unionByName(expected.select(F.col("kind").alias("tipo"), name.alias("elemento"), F.lit("esperado").alias("detalle")))


def case_quality(buses: DataFrame, trafos: DataFrame, every: DataFrame, loads: DataFrame, most_mw: float = 0.05) -> DataFrame:
    """What the stages say about their input, as findings; each table is scanned once.

    Secondary ends of transformers that are top-level buses themselves (autotransformers) or are not in the case;
    top-level buses without coordinates; constant-current and constant-admittance loads that do not sum to 0.
    ``buses``: the top-level ones, bus_id, bus_name, lat, lon.  ``trafos``: bus_i, bus_j with bus_i at the top level.
    ``every``: bus_id of all buses of the case.  ``loads``: ip, yp.
    """
    top = buses.select(F.col("bus_id").alias("bus_j"), "bus_name", F.lit(True).alias("top"))
    known = every.select(F.col("bus_id").alias("bus_j")).distinct().withColumn("known", F.lit(True))
    ends = trafos.select("bus_j").filter("bus_j IS NOT NULL").distinct().join(top, "bus_j", "left").join(known, "bus_j", "left")
    label = F.coalesce("bus_name", F.col("bus_j").cast("string"))
    unplaced = F.isnan(F.coalesce("lat", F.lit(float("nan")))) | F.isnan(F.coalesce("lon", F.lit(float("nan"))))
    sums = loads.agg(F.coalesce(F.sum("ip"), F.lit(0.0)).alias("ip"), F.coalesce(F.sum("yp"), F.lit(0.0)).alias("yp"))
    total = lambda c: F.concat(F.format_string("%.1f", c), F.lit(" MW"))
    return report(
        findings(
            ends,
            rule("autotrafo", label, F.lit("bus_j del nivel superior"), F.col("top")),
            rule("secundario_ausente", label, F.lit("bus_j no esta en el caso"), F.col("top").isNull() & F.col("known").isNull()),
        ),
        findings(buses, rule("sin_coordenadas", F.coalesce("bus_name", F.col("bus_id").cast("string")), F.lit("lat o lon ausente"), unplaced)),
        findings(sums, *[rule("carga_no_constante", F.lit(c), total(F.col(c)), F.abs(c) >= most_mw) for c in ("ip", "yp")]),
    )


def exact_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median) of the values that are not null, from their places in a range-partitioned order."""
    placed = cut(numbered(rows.filter(F.col(value).isNotNull()).select(key, value), "_place", key, value))
    sums = placed.groupBy(key).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("n"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    wanted = sums.select("n", F.col(key).alias("_key"), F.explode(middle).alias("_at"), "_first")
    wanted = wanted.select("n", "_key", (F.col("_first") + F.col("_at")).alias("_place"))
    return placed.join(wanted, "_place").groupBy(key).agg(F.max("n").alias("n"), F.avg(value).alias("median"))


def node_balance(buses: DataFrame, units: DataFrame, loads: DataFrame) -> DataFrame:
    """Buses with generation, demand, their counts and the balance; buses without any have 0."""
    gen = units.groupBy("bus_id").agg(F.sum("pg_mw").alias("pg_mw"), F.count(F.lit(1)).alias("n_gen"))
    load = loads.groupBy("bus_id").agg(F.sum("pl_mw").alias("pl_mw"), F.count(F.lit(1)).alias("n_load"))
    out = buses.join(gen, "bus_id", "left").join(load, "bus_id", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("pg_mw", "pl_mw")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_gen", "n_load")}
    return out.withColumns(zero).withColumn("balance_mw", F.col("pg_mw") - F.col("pl_mw"))


def active_units(units: DataFrame, fictitious_mw: float = 9990.0) -> DataFrame:
    return units.filter((F.col("stat") == 1) & (F.col("pt_mw") < fictitious_mw))


def presence(balance: DataFrame) -> DataFrame:
    gen, load = F.col("n_gen") > 0, F.col("n_load") > 0
    return balance.agg(
        F.count_if(gen & ~load).alias("gen_only"),
        F.count_if(~gen & load).alias("load_only"),
        F.count_if(gen & load).alias("both"),
        F.count_if(~gen & ~load).alias("none"),
    )


def extreme(balance: DataFrame, by: str, n: int = 10, largest: bool = True) -> DataFrame:
    order = F.col(by).desc() if largest else F.col(by).asc()
    return balance.orderBy(order, "bus_id").limit(n)


def coverage(official: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Counts and lengths of two sources by a key, and the model's share of the official ones in per cent."""
    a = official.groupBy(key).agg(F.count(F.lit(1)).alias("n_official"), F.sum("km").alias("km_official"))
    b = model.groupBy(key).agg(F.count(F.lit(1)).alias("n_model"), F.sum("km").alias("km_model"))
    out = a.join(b, key, "full").fillna(0)
    share = lambda m, o: F.when(F.col(o) != 0, F.round(F.lit(100.0) * F.col(m) / F.col(o), 2))
    return out.withColumns({"n_pct": share("n_model", "n_official"), "km_pct": share("km_model", "km_official")})
