from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skytide.operators.zones import MEMBERS, Slabs, decompositions, distance_m, points_in_zones


def pairs(lat, lon, z):
    d = distance_m(lat[:, None], lon[:, None], z[1][None], z[2][None])
    return {(int(p), int(z[0][k])) for p, k in zip(*np.nonzero(d <= z[3][None]))}


def zones(n, seed, longest=2e6):
    r = np.random.default_rng(seed)
    lat, lon = np.degrees(np.arcsin(r.uniform(-1, 1, n))), r.uniform(-180, 180, n)
    lat[:4], lon[:4] = [90, -90, 89, 0], [0, 10, 179, 180]
    return np.arange(n), lat, lon, r.uniform(1000, longest, n)


def test_matches_all_distances():
    r = np.random.default_rng(3)
    for seed, longest in ((0, 2e6), (1, 2e5), (2, 1.9e7)):
        z = zones(40, seed, longest)
        lat, lon = np.degrees(np.arcsin(r.uniform(-1, 1, 4000))), r.uniform(-180, 180, 4000)
        lat[:6], lon[:6] = [90, -90, 0, 0, 89.999, 0], [0, 0, 180, -180, -179.9, 179.999]
        s = Slabs(*z)
        p, m = s.locate(lat, lon)
        assert {(int(a), int(s.ids[b])) for a, b in zip(p, m)} == pairs(lat, lon, z)


def test_distributed_and_with_bad_rows(spark):
    z = zones(30, 7)
    zs = spark.createDataFrame([(int(i), float(a), float(b), float(c)) for i, a, b, c in zip(*z)] + [(99, None, 1.0, 1.0)], "zid BIGINT, lat DOUBLE, lon DOUBLE, radius_m DOUBLE")
    r = np.random.default_rng(5)
    lat, lon = r.uniform(-90, 90, 300), r.uniform(-180, 180, 300)
    rows = [(k, float(a), float(b), 1) for k, (a, b) in enumerate(zip(lat, lon))] + [(900, None, 1.0, 1), (901, 91.0, 0.0, 1), (902, float("nan"), 0.0, 1)]
    df = spark.createDataFrame(rows, "k BIGINT, lat DOUBLE, lon DOUBLE, zone INT")
    for salts in (1, 7):
        got = points_in_zones(df, F.col("k"), F.col("lat"), F.col("lon"), zs, "zid", salts)
        assert {tuple(x) for x in got.collect()} == pairs(lat, lon, z)
    assert points_in_zones(df, F.col("k"), F.col("lat"), F.col("lon"), zs.limit(0), "zid").count() == 0
    assert points_in_zones(df.limit(0), F.col("k"), F.col("lat"), F.col("lon"), zs, "zid").count() == 0


def test_thousands_of_overlapping_zones():
    r = np.random.default_rng(1)
    n = 4096
    z = np.arange(n), 48 + r.uniform(0, 0.5, n), 11 + r.uniform(0, 0.5, n), r.uniform(5e4, 9e4, n)
    lat, lon = 48 + r.uniform(0, 1, 40), 11 + r.uniform(0, 1, 40)
    got = set()
    for s in decompositions(*z, 48.0, 49.0):
        assert s.size <= MEMBERS
        p, m = s.locate(lat, lon)
        got |= {(int(a), int(s.ids[b])) for a, b in zip(p, m)}
    assert got == pairs(lat, lon, z)


def test_one_place_may_hold_most_points(spark):
    zs = spark.createDataFrame([(k, 10.0 + k, 179.99, 30_000.0) for k in range(5)], "zid BIGINT, lat DOUBLE, lon DOUBLE, radius_m DOUBLE")
    df = spark.range(3000).selectExpr("id AS k", "IF(id % 3 < 2, 12.0, 80.0) AS lat", "-180.0 AS lon")
    got = points_in_zones(df, F.col("k"), F.col("lat"), F.col("lon"), zs, "zid")
    assert got.count() == 2000 and {r.zid for r in got.select("zid").distinct().collect()} == {2}
