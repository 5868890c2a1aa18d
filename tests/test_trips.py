from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from skytide.operators.trips import changepoints, stops_and_trips

T0 = 1_741_000_000
H = 3600


def journey(seed=0):
    """Parked 40 minutes, flown 50, parked 30 with a hole of two hours inside, flown 30."""
    r = random.Random(seed)
    out = []

    def park(a, z, lat, lon):
        out.extend((t, lat + r.gauss(0, 1e-4), lon + r.gauss(0, 1e-4)) for t in range(a, z, 15))

    def fly(a, z, lat, lon, lat2, lon2):
        out.extend((t, lat + (lat2 - lat) * (t - a) / (z - a), lon + (lon2 - lon) * (t - a) / (z - a)) for t in range(a, z, 15))

    park(0, 2400, 50, 8)
    fly(2400, 5400, 50, 8, 53, 10)
    park(5400, 6300, 53, 10)
    park(6300 + 2 * H, 7200 + 2 * H, 53, 10)
    fly(7200 + 2 * H, 9000 + 2 * H, 53, 10, 54, 12)
    return out


def run(spark, pings, device="d", **kw):
    df = spark.createDataFrame([(device, round((T0 + t) * 1_000_000), a, b, 3) for t, a, b in pings], "device STRING, us BIGINT, lat DOUBLE, lon DOUBLE, chunk INT")
    rows = stops_and_trips(df, F.col("device"), F.col("us"), F.col("lat"), F.col("lon"), **kw).orderBy("start_us").collect()
    return [(r.kind, round(r.start_us / 1e6 - T0), round(r.end_us / 1e6 - T0), round(r.metres / 1000)) for r in rows]


def check(got):
    assert [g[0] for g in got] == ["stop", "trip", "stop", "trip"]
    for (_, a, z, _), (x, y) in zip(got, [(0, 2400), (2400, 5400), (5400, 7200 + 2 * H), (7200 + 2 * H, 9000 + 2 * H)]):
        assert abs(a - x) <= 120 and abs(z - y) <= 120
    assert 340 < got[1][3] < 380 and got[0][3] == 0


def test_journey(spark):
    check(run(spark, journey()))


def test_strays_copies_and_chunks(spark):
    pings = journey(1)
    for k in (20, 60, 61, 300):
        pings[k] = (pings[k][0], pings[k][1] + 1.5, pings[k][2] - 2)
    pings += [(t + 0.1, a, b) for t, a, b in pings[::7]]
    check(run(spark, pings))
    check(run(spark, pings, chunk_s=1800))


def test_hole_of_more_than_three_hours_parts_stops(spark):
    r = random.Random(3)
    park = lambda a, z: [(t, 50 + r.gauss(0, 1e-4), 8.0) for t in range(a, z, 30)]
    assert [g[0] for g in run(spark, park(0, 1200) + park(1200 + 4 * H, 2400 + 4 * H))] == ["stop", "stop"]
    assert [g[0] for g in run(spark, park(0, 1200) + park(1200 + 2 * H, 2400 + 2 * H))] == ["stop"]
    assert [g[0] for g in run(spark, park(0, 500))] == ["trip"]


def test_bad_rows_and_empty(spark):
    rows = [("a", None, 1.0, 1.0), (None, T0 * 10**6, 1.0, 1.0), ("a", 5, 1.0, 1.0), ("a", T0 * 10**6, 95.0, 1.0), ("a", T0 * 10**6, None, 1.0), ("a", T0 * 10**6, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "device STRING, us BIGINT, lat DOUBLE, lon DOUBLE")
    for d in (df, df.limit(0)):
        assert stops_and_trips(d, F.col("device"), F.col("us"), F.col("lat"), F.col("lon")).count() == 0


def test_changepoints():
    r = np.random.default_rng(1)
    y = np.concatenate([r.normal(0, 0.3, 50), r.normal(5, 0.3, 30), r.normal(1, 0.3, 70)])
    assert changepoints(y, 3 * 0.09 * np.log(150) * 2) == [0, 50, 80, 150]
    assert changepoints(np.zeros(5), 1.0) == [0, 5]
