"""Scans of stage tables, map layers and override tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(spark: SparkSession, *paths: str) -> None:
    """Raises FileNotFoundError with all the paths that match nothing, before any job runs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    absent = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(conf).globStatus(where)
        if not found:
            absent.append(path)
    if absent:
        raise FileNotFoundError(", ".join(absent))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV with a header; a missing path raises before anything runs."""
    require(spark, path)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column as text and empty text for missing values."""
    require(spark, path)
    return spark.read.csv(path, header=True, inferSchema=False).na.fill("")


def read_aliases(spark: SparkSession, path: str, most: int = 100_000) -> dict[str, str | None]:
    """The alias table (alias, canonical; no canonical name discards) as a dictionary of at most ``most`` entries."""
    require(spark, path)
    rows = spark.read.schema("alias string, canonical string").csv(path, header=True).filter("alias IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} aliases")
    return {r["alias"].strip().upper(): (r["canonical"] or "").strip().upper() or None for r in rows}


def without_index(df: DataFrame) -> DataFrame:
    return df.drop("Unnamed: 0", "_c0")


def read_line_features(spark: SparkSession, path: str, tension: int = 500) -> DataFrame:
    """(feature_id, name, parts) of GeoJSON line features of one voltage; parts is a list of coordinate lists."""
    geometry = "type string, coordinates string"
    properties = "id bigint, Nombre string, Tension double"
    schema = f"features array<struct<geometry:struct<{geometry.replace(' ', ':')}>, properties:struct<{properties.replace(' ', ':')}>>>"
    schema = schema.replace(",:", ", ")
    docs = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    docs = docs.filter(F.col("f.geometry").isNotNull() & (F.col("f.properties.Tension") == tension))
    raw = F.col("f.geometry.coordinates")
    many = F.from_json(raw, "array<array<array<string>>>")
    one = F.array(F.from_json(raw, "array<array<string>>"))
    parts = F.when(F.col("f.geometry.type") == "MultiLineString", many).otherwise(one)
    return docs.select(F.col("f.properties.id").alias("feature_id"), F.col("f.properties.Nombre").alias("name"), parts.alias("parts"))


def coordinate_columns(df: DataFrame) -> tuple[str, str]:
    """x, y if both exist without nulls, else lon, lat; one aggregate over two columns."""
    if {"x", "y"} <= set(df.columns):
        nulls = df.agg(F.count_if(F.col("x").isNull() | F.col("y").isNull())).first()[0]
        if nulls == 0:
            return "x", "y"
    return "lon", "lat"
