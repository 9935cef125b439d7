"""From a case file to the static network: buses, lines, transformers, secondary buses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.config import Study
from gridlake.functions import scalar as S
from gridlake.operators import static as O
from gridlake.sources.case import read_sections


def network(spark: SparkSession, path: str, study: Study = Study()) -> dict[str, DataFrame]:
    """Tables buses, lines, trafos and secondary of a case."""
    case = read_sections(spark, path, "BUS", "BRANCH", "TRANSFORMER")
    every = case["BUS"]
    buses = O.study_buses(every, study)
    branch = O.with_end_names(O.with_both_ends(case["BRANCH"], buses), buses)
    if not study.keep_out_of_service:
        branch = branch.filter(F.col("st") == 1)
    lines = O.keyed(branch).withColumns(
        {
            "element_type": S.element_type(F.col("x_pu")),
            "rating_defined": F.coalesce(F.col("ratea_mva") != 0, F.lit(False)),
            "ratea_mva": S.defined_rating(F.col("ratea_mva")),
            "in_service": S.in_service(F.col("st"), study.force_in_service),
        }
    )
    text = [F.col(c).cast("string") for c in ("bus_i", "bus_j", "ckt")]
    lines = O.numbered(lines, "line_id", *text)
    trafos = O.decomposed(case["TRANSFORMER"], buses)
    if study.normalize_2w:
        known = buses.select(F.col("bus_id").alias("bus_j"), F.lit(True).alias("_valid_j"))
        other = buses.select(F.col("bus_id").alias("bus_i"), F.lit(True).alias("_valid_i"))
        trafos = trafos.join(known, "bus_j", "left").join(other, "bus_i", "left")
        turn = F.col("_valid_j").isNotNull() & F.col("_valid_i").isNull()
        ends = {"bus_i": F.when(turn, F.col("bus_j")).otherwise(F.col("bus_i")), "bus_j": F.when(turn, F.col("bus_i")).otherwise(F.col("bus_j"))}
        trafos = trafos.withColumns(ends).drop("_valid_i", "_valid_j")
    named = O.with_end_names(trafos, buses)
    named = named.withColumn(
        "trafo_key", S.element_key(*[F.col(c) for c in ("name_i", "bus_i", "name_j", "bus_j")], F.col("ckt"))
    ).withColumn("in_service", S.in_service(F.col("stat"), study.force_in_service))
    trafos = O.numbered(named, "trafo_id", "rec_no", "bus_i", "bus_j")
    parents = O.first_parent(trafos).join(buses.select(F.col("bus_id").alias("bus_j")), "bus_j", "left_anti")
    secondary = parents.withColumnRenamed("bus_j", "bus_id").join(every.select("bus_id", F.col("bus_name").alias("bus_name_raw"), "baskv_kv", "ide", "vm_pu", "va_deg"), "bus_id")
    names = buses.select(F.col("bus_id").alias("parent_bus_id"), F.col("bus_name").alias("parent_name"))
    secondary = O.secondary_names(secondary.join(names, "parent_bus_id"))
    return {"buses": buses, "lines": lines, "trafos": trafos, "secondary": secondary}
