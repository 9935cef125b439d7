"""Nearest stations and hourly profiles against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from gridlake.operators import nearest as N
from gridlake.operators import profiles as H


def km(a, b):
    (x0, y0), (x1, y1) = ([math.radians(v) for v in p] for p in (a, b))
    h = math.sin((y1 - y0) / 2) ** 2 + math.cos(y0) * math.cos(y1) * math.sin((x1 - x0) / 2) ** 2
    return round(12742.0 * math.asin(math.sqrt(h)), 6)


def check(spark, ends, stations, leaf):
    got = N.nearest_station(
        spark.createDataFrame(ends, "end long, lon double, lat double, level string"), spark.createDataFrame(stations, "station_id long, lon double, lat double"), leaf
    ).collect()
    known = [(i, (x, y)) for i, x, y in stations if x is not None and y is not None]
    assert sorted(r.end for r in got) == sorted(e[0] for e in ends)
    for r in got:
        if r.lon is None or r.lat is None or not known:
            assert r.station_id is None and r.km is None
            continue
        want = min((km((r.lon, r.lat), p), i) for i, p in known)
        assert abs(r.km - want[0]) <= 2e-6
        assert r.station_id == want[1] or abs(km((r.lon, r.lat), dict(known)[r.station_id]) - want[0]) <= 2e-6


@pytest.mark.parametrize("leaf", [1, 32])
def test_nearest_station(spark, leaf):
    rng = random.Random(4)
    sphere = lambda: (rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1))))
    town = lambda: (-60 + rng.gauss(0, 0.01), -35 + rng.gauss(0, 0.01))
    ends = [(i, *(sphere() if i % 3 else town()), "e") for i in range(200)]
    ends += [(900, None, 1.0, "e"), (901, 1.0, None, "e"), (902, 180.0, 0.0, "e"), (903, 0.0, 90.0, "e"), (904, 0.0, -90.0, "e")]
    stations = [(i, *(town() if i % 4 else sphere())) for i in range(300)]  # most in one town, far from most ends
    stations += [(1000 + i, *stations[7][1:]) for i in range(100)] + [(1200, -180.0, 0.0), (1201, None, None), (1202, 50.0, 90.0)]
    check(spark, ends, stations, leaf)


def test_nearest_station_few(spark):
    ends = [(1, 0.0, 0.0, "e"), (2, 179.9, 10.0, "e")]
    check(spark, ends, [], 32)
    check(spark, ends, [(5, -179.9, 10.0)], 32)
    check(spark, ends, [(5, 0.0, 1.0), (4, 0.0, -1.0), (6, 1.0, 0.0)], 1)


def plain_runs(readings, year):
    """Value of each hour by node, by looking at every reading for every hour."""
    start, out = dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc), {}
    leap = year % 4 == 0
    times = [start + dt.timedelta(hours=h + 24 * (leap and h >= 59 * 24)) for h in range(8760)]
    for node in {r[0] for r in readings}:
        mine = sorted((ts, seq, v) for n, ts, v, seq in readings if n == node and v is not None and ts <= times[-1])
        if mine:
            at, values = 0, []
            for t in times:
                while at < len(mine) and mine[at][0] <= t:
                    at += 1
                values.append(mine[max(at - 1, 0)][2] if at else None)
            first = next((v for v in values if v is not None), None)
            out[node] = [first if v is None else v for v in values]
    return times, out


@pytest.mark.parametrize("year", [2023, 2024])
def test_profiles(spark, year):
    rng = random.Random(year)
    start = dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda h: start + dt.timedelta(hours=h)
    readings = [("a", at(rng.uniform(-50, 8900)), rng.uniform(-1, 9), i) for i in range(300)]
    readings += [("a", at(10), 5.0, 1000), ("a", at(10), 7.0, 999), ("a", at(59 * 24 + 5), 3.0, 1001), ("b", at(4000.25), 2.0, 0), ("b", at(99), None, 1)]
    readings += [("zero", at(5), 0.0, 0), ("late", at(8790), 1.0, 0), ("d", at(59 * 24), 1.5, 0), ("d", at(60 * 24), 2.5, 0)]
    df = spark.createDataFrame(readings, "node string, ts timestamp, value double, seq long")
    energy = [("a", 1000.0), ("b", 8760.0), ("zero", 876.0), ("none", 87.6), ("d", 10.0), ("gone", None)]
    got = H.demand_profile(df, spark.createDataFrame(energy, "node string, mwh double"), year).collect()
    times, values = plain_runs(readings, year)
    want = {}
    for node, mwh in energy:
        if mwh is not None:
            v = values.get(node)
            total = sum(v) if v else 0
            want[node] = [x * mwh / total for x in v] if total else [mwh / 8760] * 8760
    assert len(got) == 8760 * len(want)
    for r in got:
        assert math.isclose(r.mw, want[r.node][r.hour], rel_tol=1e-9)
        assert r.ts.timestamp() == times[r.hour].timestamp()
    share = H.availability_profile(df, year).collect()
    assert {r.node for r in share} == set(values)
    raised = {node: [max(x, 0) for x in v] for node, v in values.items()}
    most = {node: max(v) for node, v in raised.items()}
    for r in share:
        v = raised[r.node]
        assert math.isclose(r.p_max_pu, v[r.hour] / most[r.node] if most[r.node] else 0.0)
