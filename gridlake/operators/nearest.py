"""Nearest station on the globe, by cells that widen until no closer point is possible and split where they are full.

Points become unit vectors, so there is no seam at the date line or the poles, and straight distances
rank as those on the globe.  A cell of level n is a cube with side 2 / 2^n; every cell that holds a
station has their number and one of them.  The station of the deepest cell around a point bounds its
distance; the at most eight cells of the level that fits the bound hold all closer stations.  Of these,
cells that cannot hold a closer one are dropped, cells of more than ``leaf`` stations are split into
their eight parts, whose stations may lower the bound, and the stations of the others are compared.
Equal positions count once, on both sides, so no cell is hot by copies.

Defined results: a point or station without coordinates has no partner; of equally near stations (to a
millimetre) the smallest id wins; without stations all points get null.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlake.functions import scalar as S
from gridlake.session import cut

DEEP = 20
SIDE = 1 << DEEP
SLACK = 1e-8  # of the unit sphere: 6 cm
WIDE_LEVELS = 4  # levels of at most 8^4 cells are broadcast


def placed(df: DataFrame) -> DataFrame:
    """With the unit vector (x, y, z) of lon, lat and its cell's place on each axis at the deepest level."""
    lon, lat = F.radians("lon"), F.radians("lat")
    df = df.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})
    return df.withColumns({f"i{a}": step(F.col(a)) for a in "xyz"})


def step(x: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor((x + 1) * (SIDE / 2)), F.lit(SIDE - 1).cast("long")))


def cell_of(ix: str = "ix", iy: str = "iy", iz: str = "iz") -> Column:
    """The cell of ``level`` from places at the deepest level."""
    at = [f"shiftright({i}, {DEEP} - level)" for i in (ix, iy, iz)]
    return F.expr(f"shiftleft({at[0]}, {2 * DEEP}) | shiftleft({at[1]}, {DEEP}) | {at[2]}")


def straight(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def _levels(df: DataFrame, deep: int) -> DataFrame:
    return df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deep)))).withColumn("cell", cell_of())


def _bounded(points: DataFrame, cells: DataFrame, deep: int) -> DataFrame:
    """Points with ``bound``, the distance to the station of the deepest cell around them."""
    chain = _levels(points.select("q", "x", "y", "z", "ix", "iy", "iz"), deep).select("q", "x", "y", "z", "level", "cell")
    wide, small = F.col("level") <= WIDE_LEVELS, cells.select("level", "cell", "one")
    met = chain.filter(wide).join(F.broadcast(small.filter(wide)), ["level", "cell"])
    met = met.unionByName(chain.filter(~wide).join(small.filter(~wide), ["level", "cell"]))
    deepest = met.groupBy("q", "x", "y", "z").agg(F.max_by("one", "level").alias("one"))
    return deepest.withColumn("bound", straight(_at(), _at("one."))).drop("one")


def _at(prefix: str = "") -> list[Column]:
    return [F.col(prefix + a) for a in "xyz"]


def _ball(points: DataFrame, deep: int) -> DataFrame:
    """(q, x, y, z, bound, level, cell): the cells around each point that its bound reaches."""
    fit = F.when(F.col("bound") > 0, F.floor(-F.log2(F.col("bound") + SLACK))).otherwise(deep)
    out = points.withColumn("level", F.greatest(F.lit(0), F.least(fit, F.lit(deep))).cast("int"))
    for a in "xyz":
        ends = [step(F.col(a) - F.col("bound") - SLACK), step(F.col(a) + F.col("bound") + SLACK)]
        out = out.withColumns({"lo": ends[0], "hi": ends[1]})
        run = F.expr(f"sequence(shiftright(lo, {DEEP} - level), shiftright(hi, {DEEP} - level))")
        out = out.withColumn(f"i{a}", F.explode(run)).drop("lo", "hi")
    return out.withColumn("cell", F.expr(f"shiftleft(ix, {2 * DEEP}) | shiftleft(iy, {DEEP}) | iz")).drop("ix", "iy", "iz")


def _away() -> Column:
    """Distance of (x, y, z) to the box of (level, cell)."""
    side = F.lit(2.0) / F.pow(F.lit(2.0), F.col("level"))
    parts = []
    for n, a in enumerate("xyz"):
        low = F.expr(f"shiftright(cell, {DEEP * (2 - n)}) & {SIDE - 1}") * side - 1
        parts.append(F.greatest(low - F.col(a), F.col(a) - low - side, F.lit(0.0)))
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def _children() -> Column:
    parts = [(dx, dy, dz) for dx in (0, 1) for dy in (0, 1) for dz in (0, 1)]
    twice = [F.expr(f"(shiftright(cell, {DEEP * (2 - n)}) & {SIDE - 1}) * 2") for n in range(3)]
    return F.array(*[F.shiftleft(twice[0] + dx, 2 * DEEP).bitwiseOR(F.shiftleft(twice[1] + dy, DEEP)).bitwiseOR(twice[2] + dz) for dx, dy, dz in parts])


def reached(points: DataFrame, cells: DataFrame, deep: int, leaf: int) -> DataFrame:
    """(q, level, cell): the cells whose stations have to be compared with each point."""
    frontier, ready = _ball(_bounded(points, cells, deep), deep), []
    while True:
        met = frontier.join(cells, ["level", "cell"]).withColumn("away", _away())
        seen = F.min(straight(_at(), _at("one."))).over(W.partitionBy("q"))
        met = met.withColumn("bound", F.least("bound", seen)).filter(F.col("away") <= F.col("bound") + SLACK)
        met = cut(met.select("q", "x", "y", "z", "bound", "level", "cell", ((F.col("n") > leaf) & (F.col("level") < deep)).alias("full")))
        ready.append(met.filter("NOT full").select("q", "level", "cell"))
        if met.filter("full").isEmpty():
            return reduce(DataFrame.unionAll, ready)
        frontier = met.filter("full").withColumn("cell", F.explode(_children())).withColumn("level", F.col("level") + 1).drop("full")


def nearest_station(ends: DataFrame, stations: DataFrame, leaf: int = 32) -> DataFrame:
    """``ends`` (with lon, lat) and station_id and km of the nearest of ``stations``: station_id, lon, lat."""
    known = stations.filter("lon IS NOT NULL AND lat IS NOT NULL").groupBy("lon", "lat").agg(F.min("station_id").alias("station_id"))
    known = cut(placed(known))
    n = known.count()
    kind = stations.schema["station_id"].dataType
    if not n:
        return ends.withColumns({"station_id": F.lit(None).cast(kind), "km": F.lit(None).cast("double")})
    deep = min(DEEP, math.ceil(math.log2(n) / 2) + 8)
    points = ends.filter("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat").distinct()
    points = cut(placed(points).withColumn("q", F.monotonically_increasing_id()))
    at = _levels(known, deep)
    cells = cut(at.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x", "y", "z"), "station_id").alias("one")))
    there = at.select("level", "cell", "station_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    pairs = reached(points, cells, deep, leaf).join(there, ["level", "cell"]).join(points.select("q", "lon", "lat"), "q")
    km = F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")), 6)
    best = pairs.groupBy("q").agg(F.min(F.struct(km.alias("km"), "station_id")).alias("best"))
    found = points.join(best, "q").select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "best")
    out = ends.join(found, (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat")), "left")
    return out.select(*[F.col(c) for c in ends.columns], F.col("best.station_id").alias("station_id"), F.col("best.km").alias("km"))
