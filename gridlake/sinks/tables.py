"""Stage tables, the network object and reports as files.

Every writer returns what it counted in the pass that wrote: the number of rows and the metrics asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, metrics: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """``df`` and what it will have counted once an action has run: ``rows`` and the aggregates ``metrics``."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (metrics or {}).items()]), seen


def write_stage(df: DataFrame, path: str, metrics: dict[str, Column] | None = None) -> dict:
    """A stage's table as Parquet; the counts come from the same pass."""
    rows, seen = counted(df, metrics)
    rows.write.mode("overwrite").parquet(path)
    return seen.get


def write_csv(df: DataFrame, path: str, columns: list[str], metrics: dict[str, Column] | None = None) -> dict:
    """One CSV file in a fixed column order, for tables of a study's size."""
    rows, seen = counted(df, metrics)
    rows.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)
    return seen.get


def write_matched(df: DataFrame, path: str) -> dict:
    last = ["geo_nombre", "match_status", "geometry"]
    return write_csv(df, path, [*[c for c in df.columns if c not in last], *last], by_value("match_status", "directo", "paralela", "manual_geo", "sin_match", "pendiente_bus", "compensador"))


def by_value(column: str, *values: str) -> dict[str, Column]:
    """Rows of each value of a column."""
    return {v: F.count_if(F.col(column) == v) for v in values}


def unit_metrics(fictitious_mw: float = 9990.0) -> dict[str, Column]:
    """Units and MW of each kind of match; fictitious units count, without MW."""
    kinds = ("directo", "bfs", "sin_conexion")
    real = F.when(F.col("pt_mw") < fictitious_mw, F.abs("pt_mw"))
    sums = {f"mw_{k}": F.coalesce(F.sum(F.when(F.col("match_type") == k, real)), F.lit(0.0)) for k in kinds}
    return by_value("match_type", *kinds) | sums


def place_metrics() -> dict[str, Column]:
    """Rows with and without coordinates."""
    have = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return {"located": F.count_if(have), "unlocated": F.count_if(~have)}


def write_network(path: str, buses: DataFrame, lines: DataFrame, transformers: DataFrame) -> dict[str, int]:
    """The component tables and the one snapshot of a network as a Parquet folder; the rows of each."""
    rows = {name: write_stage(df, f"{path}/{name}")["rows"] for name, df in (("buses", buses), ("lines", lines), ("transformers", transformers))}
    snapshot = buses.sparkSession.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS snapshot")
    snapshot.write.mode("overwrite").parquet(f"{path}/snapshots")
    return rows


def write_report(df: DataFrame, path: str) -> dict:
    """The report, also when it is empty, so that no old one survives."""
    return write_csv(df, path, ["tipo", "elemento", "detalle"])
