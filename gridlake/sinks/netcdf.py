"""A network object as one netCDF file."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.session import ship
from gridlake.sources.netcdf import BYTE, CHAR, DOUBLE, NetcdfSource

_KINDS = {"string": CHAR, "boolean": BYTE}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _layout(df: DataFrame) -> list:
    """[rows, [[column, type, width of text]]] of a component, by one aggregate; whole numbers become doubles."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    widths = [F.coalesce(F.max(F.octet_length(c)), F.lit(0)).alias(c) for c in text]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *widths).first()
    kinds = [(f.name, _KINDS.get(f.dataType.simpleString(), DOUBLE)) for f in df.schema.fields]
    return [row["_rows"], [[c, k, max(1, row[c]) if k == CHAR else 0] for c, k in kinds]]


def write_netcdf(path: str, components: dict[str, DataFrame], title: str = "") -> None:
    """Writes the components (each with a unique ``name``), in the order of their names, into one file.

    The file is replaced as a whole when all tasks have written.
    """
    spark = next(iter(components.values())).sparkSession
    ship(spark)
    spark.dataSource.register(NetcdfSource)
    layout = {c: _layout(df) for c, df in components.items()}
    parts = []
    for component, df in components.items():
        own = F.struct(*[F.col(f"`{f.name}`") for f in df.schema.fields]).alias(f"row_{component}")
        others = [F.lit(None).cast(F"struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in o.schema.fields)}>").alias(f"row_{n}") for n, o in components.items() if n != component]
        parts.append(df.select(F.lit(component).alias("component"), F.col("name").cast("string").alias("name"), own, *others))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    rows = rows.repartitionByRange("component", "name").sortWithinPartitions("component", "name")
    options = {"layout": json.dumps(layout), "attributes": json.dumps({"network_name": title, "Conventions": "CF-1.8"})}
    rows.write.format("netcdf").mode("overwrite").options(**options).save(qualified(spark, path))


def read_netcdf(spark: SparkSession, path: str, component: str) -> DataFrame:
    """One component of a file, in slices."""
    ship(spark)
    spark.dataSource.register(NetcdfSource)
    return spark.read.format("netcdf").option("component", component).load(qualified(spark, path))
