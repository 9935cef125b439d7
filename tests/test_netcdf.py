"""Network files read back by a parser of the test's own."""

from __future__ import annotations

import math
import os
import struct

import pytest
from pyspark.sql import functions as F

from gridlake.sinks.netcdf import read_netcdf, write_netcdf


def parse(path):
    """dimensions, attributes, variables of a classic file, straight from the format's grammar."""
    data = open(path, "rb").read()
    assert data[:4] == b"CDF\x02"
    at = 8

    def take(form):
        nonlocal at
        out = struct.unpack_from(">" + form, data, at)
        at += struct.calcsize(">" + form)
        return out[0]

    def text():
        nonlocal at
        n = take("i")
        out = data[at : at + n].decode()
        at += (n + 3) // 4 * 4
        return out

    def attributes():
        take("i")
        out = {}
        for _ in range(take("i")):
            name = text()
            assert take("i") == 2
            out[name] = text()
        return out

    assert take("i") in (0, 10)
    dims = [(text(), take("i")) for _ in range(take("i"))]
    top = attributes()
    assert take("i") == 11
    variables = {}
    for _ in range(take("i")):
        name = text()
        shape = [dims[take("i")][1] for _ in range(take("i"))]
        own = attributes()
        kind, size, begin = take("i"), take("I"), take("q")
        n = math.prod(shape)
        assert size % 4 == 0 and begin % 4 == 0 and begin >= at
        if kind == 2:
            w = shape[-1]
            values = [data[begin + i * w : begin + (i + 1) * w].rstrip(b"\0").decode() for i in range(shape[0])]
        else:
            values = list(struct.unpack_from(f">{n}{'d' if kind == 6 else 'b'}", data, begin))
        assert begin + size <= len(data)
        variables[name] = (values, own)
    return dict(dims), top, variables


@pytest.fixture(scope="module")
def network(spark):
    buses = spark.range(250).select(
        F.concat(F.lit("Bus é"), F.col("id")).alias("name"), (F.col("id") * 2.5).alias("v_nom"), F.when(F.col("id") % 3 > 0, F.col("id") / 7.0).alias("x"),
        F.when(F.col("id") % 5 > 0, F.lit("AC")).alias("carrier"), (F.col("id") % 2 == 0).alias("on"),
    ).repartition(5)
    lines = spark.range(90).select(F.concat(F.lit("L"), F.col("id")).alias("name"), F.lit("a").alias("bus0"), F.col("id").cast("int").alias("n")).repartition(3)
    none = spark.createDataFrame([], "name string, r double")
    return {"buses": buses, "lines": lines, "transformers": none}


def test_file(spark, network, tmp_path):
    path = str(tmp_path / "net.nc")
    write_netcdf(path, network, "test")
    dims, top, variables = parse(path)
    assert top["network_name"] == "test" and dims["buses_i"] == 250 and dims["lines_i"] == 90 and dims["transformers_i"] == 0
    rows = sorted(network["buses"].collect(), key=lambda r: r.name.encode())
    assert variables["buses_i"][0] == [r.name for r in rows]
    assert variables["buses_v_nom"][0] == [r.v_nom for r in rows]
    assert [None if math.isnan(v) else v for v in variables["buses_x"][0]] == [r.x for r in rows]
    assert variables["buses_carrier"][0] == [r.carrier or "" for r in rows] and variables["buses_on"][0] == [int(r.on) for r in rows]
    assert sorted(variables["lines_n"][0]) == list(map(float, range(90))) and variables["transformers_r"][0] == []
    assert variables["snapshots"] == ([0.0], {"units": "hours since 2024-01-01 00:00:00", "calendar": "proleptic_gregorian"})
    assert os.listdir(tmp_path) == ["net.nc"]


def test_read_back(spark, network, tmp_path):
    path = str(tmp_path / "net.nc")
    write_netcdf(path, network)
    back = read_netcdf(spark, path, "buses")
    want = network["buses"].withColumn("carrier", F.coalesce("carrier", F.lit("")))
    by_name = lambda df: sorted((tuple(r) for r in df.select(want.columns).collect()), key=lambda r: r[0])
    assert by_name(back) == by_name(want)
    assert back.select("v_nom").agg(F.sum("v_nom")).first()[0] == want.agg(F.sum("v_nom")).first()[0]
    assert read_netcdf(spark, path, "transformers").count() == 0
    with pytest.raises(Exception, match="no component"):
        read_netcdf(spark, path, "loads").collect()
    (tmp_path / "bad.nc").write_bytes(b"HDF")
    with pytest.raises(Exception, match="no netCDF"):
        read_netcdf(spark, str(tmp_path / "bad.nc"), "buses").collect()


def test_failed_task_leaves_no_file(spark, network, tmp_path):
    path = str(tmp_path / "net.nc")
    fails = network["buses"].withColumn("v_nom", F.when(F.col("name") == "Bus é77", F.raise_error(F.lit("broken"))).otherwise(F.col("v_nom")))
    count = fails.drop("v_nom").withColumn("v_nom", F.lit(1.0))  # counting does not touch the broken row
    assert count.count() == 250
    with pytest.raises(Exception, match="broken"):
        write_netcdf(path, {"buses": fails})
    assert os.listdir(tmp_path) == []
    write_netcdf(path, network, "kept")
    before = open(path, "rb").read()
    with pytest.raises(Exception, match="broken"):
        write_netcdf(path, {"buses": fails})
    assert os.listdir(tmp_path) == ["net.nc"] and open(path, "rb").read() == before
