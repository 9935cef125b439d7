"""Map files opened by sqlite, and counts that a writing pass takes."""

from __future__ import annotations

import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from gridlake.functions import geometry as Y
from gridlake.sinks import gpkg as G
from gridlake.sinks.tables import by_value, counted, place_metrics, unit_metrics, write_csv, write_network, write_stage


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        x, y = round(rng.uniform(-70, -50), 6), round(rng.uniform(-50, -20), 6)
        text = f"POINT ({x} {y})" if i % 3 else f"LINESTRING ({x} {y}, {x + rng.random():.6f} {y - rng.random():.6f})"
        rows.append((i, text if i % 50 else rng.choice([None, ""]), f"n'{i}" if i % 7 else None, i / 3, i % 2 == 0))
    return spark.createDataFrame(rows, 'id long, geometry string, "name ""x" string, v double, flag boolean'.replace('"name ""x"', "`name \"x`")).repartition(6), rows


def test_index_equals_scan(spark, features, tmp_path):
    df, rows = features
    path = str(tmp_path / "m.gpkg")
    known = [r for r in rows if r[1]]
    assert G.write_layer(df, path, "every thing", fresh=True) == len(known)
    assert G.write_layer(df.filter("id % 3 = 1"), path, "points") == sum(r[0] % 3 == 1 for r in known)
    assert G.write_layer(df.limit(0), path, "none") == 0
    assert os.listdir(tmp_path) == ["m.gpkg"]
    db = sqlite3.connect(path)
    contents = {r[0]: r[1:] for r in db.execute("SELECT table_name, min_x, min_y, max_x, max_y FROM gpkg_contents")}
    ends = [G.bounds(r[1]) for r in known]
    assert contents["every thing"] == (min(e[0] for e in ends), min(e[2] for e in ends), max(e[1] for e in ends), max(e[3] for e in ends))
    assert contents["none"] == (None,) * 4
    assert dict(db.execute("SELECT table_name, geometry_type_name FROM gpkg_geometry_columns")) == {"every thing": "GEOMETRY", "points": "POINT", "none": "GEOMETRY"}
    assert db.execute("SELECT count(*) FROM gpkg_extensions WHERE extension_name = 'gpkg_rtree_index'").fetchone()[0] == 3
    stored = {r[0]: (Y.from_gpkg(r[1]), *r[2:]) for r in db.execute('SELECT id, geom, "name ""x", v, flag FROM "every thing"')}
    assert stored == {r[0]: (Y.from_gpkg(Y.to_gpkg(r[1])), r[2], r[3], int(r[4])) for r in known}
    assert db.execute('SELECT count(*) FROM "rtree_every thing_geom"').fetchone()[0] == len(known)
    plan = " ".join(r[-1] for r in db.execute('EXPLAIN QUERY PLAN SELECT id FROM "rtree_every thing_geom" WHERE minx <= 1 AND maxx >= 0'))
    assert "VIRTUAL TABLE INDEX" in plan
    for window in [(-60, -59, -40, -30), (-70, -50, -50, -20), (0, 1, 0, 1), (-55.5, -55.4, -30.2, -30.1)]:
        x0, x1, y0, y1 = window
        want = {r[0] for r, (a, b, c, d) in zip(known, ends, strict=True) if a <= x1 and b >= x0 and c <= y1 and d >= y0}
        assert {r.id for r in G.read_layer(spark, path, "every thing", window).collect()} == want
    back = G.read_layer(spark, path, "every thing")
    assert {r.id: (r.geometry, r.v, r.flag) for r in back.collect()} == {r[0]: (stored[r[0]][0], r[3], r[4]) for r in known}
    with pytest.raises(Exception, match="no layer"):
        G.read_layer(spark, path, "gone").collect()


def test_failed_layer_leaves_the_file(spark, features, tmp_path):
    df, _ = features
    path = str(tmp_path / "m.gpkg")
    G.write_layer(df.limit(10), path, "a", fresh=True)
    before = open(path, "rb").read()
    broken = df.withColumn("geometry", F.when(F.col("id") == 1000, "POINT (x y)").otherwise(F.col("geometry")))
    with pytest.raises(Exception, match="Python"):
        G.write_layer(broken, path, "b")
    with pytest.raises(Exception, match="already exists"):
        G.write_layer(df.limit(10), path, "a")
    assert os.listdir(tmp_path) == ["m.gpkg"] and open(path, "rb").read() == before


def test_counts_of_the_writing_pass(spark, tmp_path):
    units = spark.range(1000).select(
        F.when(F.col("id") % 5 == 0, "directo").when(F.col("id") % 5 < 4, "bfs").otherwise("sin_conexion").alias("match_type"),
        F.when(F.col("id") % 9 == 0, 9995.0).otherwise(-F.col("id") / 4).alias("pt_mw"), F.when(F.col("id") % 2 == 0, 1.0).alias("lat"), F.lit(2.0).alias("lon"),
    )
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counts", "")
    seen = write_stage(units, str(tmp_path / "u"), unit_metrics() | place_metrics())
    written = len(jobs.getJobIdsForGroup("counts"))
    spark.sparkContext.setJobGroup("plain", "")
    units.write.parquet(str(tmp_path / "p"))
    assert written == len(jobs.getJobIdsForGroup("plain"))
    spark.sparkContext.setJobGroup("", "")
    back = spark.read.parquet(str(tmp_path / "u"))
    want = back.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (unit_metrics() | place_metrics()).items()]).first().asDict()
    assert seen == want and seen["rows"] == 1000 and seen["mw_sin_conexion"] > 0
    assert write_csv(units, str(tmp_path / "c"), ["lat", "lon"], by_value("match_type", "bfs", "x")) == {"rows": 1000, "bfs": 600, "x": 0}
    assert write_network(str(tmp_path / "n"), units, units.limit(3), units.limit(0)) == {"buses": 1000, "lines": 3, "transformers": 0}
    rows, observation = counted(units.limit(0))
    rows.collect()
    assert observation.get == {"rows": 0}
