"""Queries over the file sources and sinks on stand-in tables, which Spark writes as files of the format first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.plans.registry import query, table
from gridlake.session import scratch
from gridlake.sources import case_source as S
from gridlake.sources.xlsx import read_xlsx, write_xlsx

CASE_FILES = 8
#: Records of a case file; a file is written by one task, so more records make more files.
CASE_RECORDS = 100_000


def rendered_cases(spark: SparkSession, d: str) -> str:
    """Parts, line items and orders as the buses, branches and transformers of eight case files, or more of about ``CASE_RECORDS`` records."""
    part, item, orders = (table(spark, d, t) for t in ("part", "lineitem", "orders"))
    count = max(CASE_FILES, -(-sum(df.count() for df in (part, item, orders)) // CASE_RECORDS))
    text = lambda c: F.col(c).cast("string")
    bus = F.concat_ws(",", text("p_partkey"), F.concat(F.lit("'"), F.col("p_name"), F.lit("'")), text("p_retailprice"), text("p_size"), F.lit("1,1,1,1.0,0.5"))
    branch = F.concat_ws(
        ",", text("l_orderkey"), text("l_partkey"), F.concat(F.lit("'"), text("l_linenumber"), F.lit(" '")), text("l_tax"), text("l_quantity"),
        F.concat(F.lit("0,'L, "), text("l_suppkey"), F.lit("'")), text("l_discount"), F.lit("0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1,1,2.5"),
    )
    three = F.col("o_orderkey") % 3 == 0
    head = F.concat_ws(",", text("o_orderkey"), text("o_custkey"), F.when(three, F.col("o_orderkey") + 1).otherwise(0).cast("string"), F.lit("'1 ',1,1,1,0,0,2,'T, A',1"))
    second = F.concat_ws(",", text("o_totalprice"), F.lit("1,2"), F.when(three, F.lit("3,4,5,6,7,8")))
    trafo = F.concat_ws("\n", head, second, F.lit("1,0,0"), F.lit("1,0"), F.when(three, F.lit("1,0")))

    def lines(df: DataFrame, section: int, key: str, value) -> DataFrame:
        return df.select((F.col(key) % count).alias("file"), F.lit(section).alias("section"), F.col(key).alias("at"), value.alias("value"))

    marks = ["x\ny\nTITLE\n0 / BEGIN BUS DATA", "0 / END OF BUS DATA, BEGIN BRANCH DATA", "0 / END OF BRANCH DATA, BEGIN TRANSFORMER DATA\n@ i, j, k", "0 / END OF TRANSFORMER DATA"]
    files = spark.range(count).select(F.col("id").alias("file"), F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.lit(m).alias("value")) for n, m in enumerate(marks)])).alias("m"))
    rows = files.select("file", "m.section", F.lit(-1).cast("long").alias("at"), "m.value")
    rows = rows.unionAll(lines(part, 0, "p_partkey", bus)).unionAll(lines(item, 1, "l_orderkey", branch)).unionAll(lines(orders, 2, "o_orderkey", trafo))
    path = scratch(spark, "cases")
    rows.repartition(count, "file").sortWithinPartitions("file", "section", "at").select("file", "value").write.partitionBy("file").text(path)
    return path


@query(
    """SELECT 'BUS' AS section, p_partkey AS a, CAST(NULL AS BIGINT) AS b, p_name AS name, p_retailprice AS value FROM part
    UNION ALL SELECT 'BRANCH', l_orderkey, l_partkey, 'L, ' || l_suppkey, l_quantity FROM lineitem
    UNION ALL SELECT 'TRANSFORMER', o_orderkey, o_custkey, 'T, A', CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 7 ELSE o_totalprice END FROM orders"""
)
def case_sections(spark, d):
    """All sections of case files in one scan of the splittable source."""
    df = S.scan(spark, S.arrow_path(spark, rendered_cases(spark, d)), ["BUS", "BRANCH", "TRANSFORMER"], 1 << 20)
    bus, branch, trafo = (F.col(s) for s in ("bus", "branch", "transformer"))
    value = F.coalesce(bus["baskv_kv"], branch["x_pu"], trafo["r12"] + F.coalesce(trafo["x31"], F.lit(0.0)))
    return df.select(
        "section", F.coalesce(bus["bus_id"], branch["bus_i"], trafo["i"]).alias("a"), F.coalesce(branch["bus_j"], trafo["j"]).alias("b"),
        F.coalesce(bus["bus_name"], branch["name"], trafo["name"]).alias("name"), value.alias("value"),
    )


@query(
    """SELECT p_partkey AS bus_id, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' <&> é' ELSE '' END AS name_geo, CASE WHEN p_partkey % 5 != 0 THEN p_retailprice / 100 END AS lat,
    CASE WHEN p_partkey % 7 != 0 THEN CAST(-p_size AS DOUBLE) END AS lon FROM part"""
)
def spreadsheet_coordinates(spark, d):
    """The coordinate table as workbooks, read by column name, a sheet a partition."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.concat("p_name", F.when(key % 2 == 0, " <&> é").otherwise("")).alias("name_geo"), F.when(key % 5 != 0, F.col("p_retailprice") / 100).alias("lat"),
        F.lit("note").alias("note"), F.when(key % 7 != 0, -F.col("p_size")).alias("lon"), key.alias("bus_id"),
    )
    path = scratch(spark, "coordinates")
    write_xlsx(rows.repartition(4, "bus_id"), path)
    return read_xlsx(spark, path, "bus_id long, name_geo string, lat double, lon double")
