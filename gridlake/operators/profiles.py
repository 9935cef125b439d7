"""Hourly profiles of a year from irregular readings: 8,760 hours, the last reading before each, scaled.

Readings are first reduced to the last one before each full hour, so that a node has at most one for
each hour however often it was read.  A reading then stands for the hours up to the next one, and these
runs are exploded: there is no join with a calendar, and yearly sums are taken over runs, not hours.
29 February is left out, so every year has the same hours; readings of that day count for what follows.

Defined results: hours before a node's first reading take the first one; readings after the year, or without node, time
or value, are left out; of readings at one time the one with the largest ``seq`` counts; a node with energy
but without readings, or with readings that sum to 0, has a flat profile; a node without energy has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOURS = 8760
LEAP = 59 * 24  # hours before 29 February


def leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def hour_of(ts: Column, year: int) -> Column:
    """The first hour of the year that begins at or after ``ts``; times before the year have hour 0."""
    start = F.lit(f"{year}-01-01").cast("timestamp")
    us = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(start)
    hour = F.greatest(F.ceil(us / 3.6e9), F.lit(0).cast("long"))
    if leap(year):
        hour = F.when(hour <= LEAP, hour).otherwise(F.greatest(hour - 24, F.lit(LEAP).cast("long")))
    return hour


def time_of(hour: Column, year: int) -> Column:
    """The time at which an hour of the year begins."""
    real = F.when(hour >= LEAP, hour + 24).otherwise(hour) if leap(year) else hour
    start = F.unix_micros(F.lit(f"{year}-01-01").cast("timestamp"))
    return F.timestamp_micros(start + real * 3_600_000_000)


def runs(readings: DataFrame, year: int) -> DataFrame:
    """(node, first, past, value): each value with the hours [first, past) that it stands for.

    ``readings``: node, ts, value, seq.
    """
    hour = hour_of(F.col("ts"), year)
    rows = readings.filter("node IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").withColumn("hour", hour)
    last = rows.filter(F.col("hour") < HOURS).groupBy("node", "hour").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    by = W.partitionBy("node").orderBy("hour")  # at most 8,760 rows
    first = F.when(F.lag("hour").over(by).isNull(), F.lit(0).cast("long")).otherwise(F.col("hour"))
    past = F.coalesce(F.lead("hour").over(by), F.lit(HOURS).cast("long"))
    return last.select("node", first.alias("first"), past.alias("past"), F.col("value").cast("double").alias("value"))


def _hours(rows: DataFrame, year: int, mw: Column, name: str) -> DataFrame:
    out = rows.withColumn("hour", F.explode(F.sequence(F.col("first"), F.col("past") - 1)))
    return out.select("node", F.col("hour").cast("int").alias("hour"), time_of(F.col("hour"), year).alias("ts"), mw.alias(name))


def demand_profile(readings: DataFrame, energy: DataFrame, year: int) -> DataFrame:
    """(node, hour, ts, mw): the shape of the readings scaled so that a node's hours sum to its yearly ``mwh``.

    ``energy``: node, mwh, one row a node.
    """
    shape = runs(readings, year)
    total = shape.groupBy("node").agg(F.sum(F.col("value") * (F.col("past") - F.col("first"))).alias("total"))
    known = energy.filter("node IS NOT NULL AND mwh IS NOT NULL").join(total, "node", "left")
    shaped = shape.join(known.filter("total != 0"), "node")
    flat = known.filter("total IS NULL OR total = 0").select(
        "node", F.lit(0).cast("long").alias("first"), F.lit(HOURS).cast("long").alias("past"), F.lit(1.0).alias("value"), "mwh", F.lit(float(HOURS)).alias("total")
    )
    rows = shaped.select("node", "first", "past", "value", "mwh", "total").unionAll(flat)
    return _hours(rows, year, F.col("value") * F.col("mwh") / F.col("total"), "mw")


def availability_profile(readings: DataFrame, year: int) -> DataFrame:
    """(node, hour, ts, p_max_pu): readings as a share of the node's largest, between 0 and 1; all 0 if it has none above 0."""
    shape = runs(readings, year).withColumn("value", F.greatest("value", F.lit(0.0)))
    most = shape.groupBy("node").agg(F.max("value").alias("most"))
    share = F.when(F.col("most") > 0, F.col("value") / F.col("most")).otherwise(0.0)
    return _hours(shape.join(most, "node"), year, share, "p_max_pu")
