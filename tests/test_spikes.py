from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from skytide.operators.spikes import FIELDS, autoregression, implausible, outliers

T0 = 1_741_000_000
SCHEMA = "seq BIGINT, icao STRING, us BIGINT, altitude INT, ground_speed DOUBLE, lat DOUBLE, lon DOUBLE, vertical_rate INT, chunk INT, field STRING"


def flight(n=400, seed=1):
    """A climb, a cruise and a descent, ten seconds apart; [seq, t, altitude, speed, lat, lon, rate]."""
    r = random.Random(seed)
    rows, alt = [], 1000.0
    for k in range(n):
        rate = 1800 if k < 120 else 0 if k < 280 else -1800
        alt += rate / 6
        lon = (179.0 + k * 0.01 + 180) % 360 - 180
        rows.append([k, T0 + 10 * k, round(alt / 25) * 25, 300 + r.gauss(0, 1), 40 + k * 0.008 + r.gauss(0, 1e-4), lon + r.gauss(0, 1e-5), rate])
    return rows


def run(spark, rows, device="ab", **kw):
    df = spark.createDataFrame([(x[0], device, x[1] * 1_000_000, x[2], x[3], x[4], x[5], x[6], 7, "x") for x in rows], SCHEMA)
    return {(r.seq, r.field, r.kind) for r in implausible(df, F.col("seq"), F.col("icao"), F.col("us"), **kw).collect()}


def test_clean_flight_over_180_degrees(spark):
    assert run(spark, flight()) == set()


def test_planted(spark):
    rows = flight()
    want = set()
    rows[50][2] += 6000
    want.add((50, "altitude", "spike"))
    rows[60][2] = -4000
    want.add((60, "altitude", "limit"))
    rows[140][3] = 700.0
    want.add((140, "ground_speed", "spike"))
    rows[150][4] += 1.2
    want.add((150, "lat", "spike"))
    for k in (170, 171):  # a patch of two
        rows[k][4], rows[k][5] = 0.0, 0.0
        want |= {(k, "lat", "spike"), (k, "lon", "spike")}
    for k in range(200, 215):
        rows[k][4], rows[k][5] = rows[200][4], rows[200][5]
        if k > 200:
            want |= {(k, "lat", "stuck"), (k, "lon", "stuck")}
    for k in range(230, 250):
        rows[k][3] = rows[230][3]
        if k > 230:
            want.add((k, "ground_speed", "stuck"))
    for k in range(300, 320):
        rows[k][2] = rows[300][2]
        if k > 300:
            want.add((k, "altitude", "stuck"))
    copies = [[1000 + x[0], x[1], *x[2:]] for x in rows]  # every transmission heard twice
    more = {(s + 1000, f, k) for s, f, k in want}
    assert run(spark, rows) == want
    assert run(spark, rows + copies) == want | more
    assert run(spark, rows + copies, chunk_s=900, halo_s=600) == want | more


def test_level_shift_over_a_hole_and_parked(spark):
    rows = flight(200)
    rows = rows[:80] + [[x[0], x[1] + 4000, x[2] - 9000, x[3], x[4] + 3, x[5], x[6]] for x in rows[80:]]
    assert run(spark, rows) == set()
    r = random.Random(2)
    parked = [[k, T0 + 20 * k, 500, 0.0, 50 + round(r.gauss(0, 1e-4), 5), 9 + round(r.gauss(0, 1e-4), 5), 0] for k in range(300)]
    assert run(spark, parked) == set()


def test_nulls_times_and_empty(spark):
    bad = [(1, "a", None, -9999, None, None, None, None, 1, "x"), (2, None, T0 * 10**6, -9999, None, None, None, None, 1, "x"), (3, "a", 5, -9999, None, None, None, None, 1, "x")]
    bad += [(4, "a", T0 * 10**6, None, None, None, None, None, 1, "x"), (5, "a", T0 * 10**6, None, -5.0, None, math.inf, 9, 1, "x")]
    df = spark.createDataFrame(bad, SCHEMA)
    f = lambda d: {(r.seq, r.field) for r in implausible(d, F.col("seq"), F.col("icao"), F.col("us")).collect()}
    assert f(df) == {(5, "ground_speed"), (5, "lon")}
    assert f(df.limit(0)) == set()


def level(n, seed, planted=()):
    """A cruise at 30,000 ft, ten seconds apart, with planted readings: seconds and feet."""
    r = np.random.default_rng(seed)
    v = 30_000 + r.normal(0, 20, n)
    for k in planted:
        v[k] += 20_000
    return 10.0 * np.arange(n), v


def spikes_of(*series):
    """Of each series (seconds, feet) the readings found, all in one call."""
    seg = np.repeat(np.arange(len(series)), [len(s) for s, _ in series])
    sec, v = np.concatenate([s for s, _ in series]), np.concatenate([x for _, x in series])
    one = np.ones(len(v))
    bad = outliers(FIELDS[0], seg, sec, v, one, 60 * one)
    return [set(np.flatnonzero(bad[seg == k]).tolist()) for k in range(len(series))]


def test_a_series_is_judged_alone():
    dense = set(range(10, 130, 4))
    for planted in ({0}, {50}, {199}, {20, 21, 22}, set()):
        assert spikes_of(level(200, 1, planted), level(200, 2, dense)) == [planted, dense]
        assert spikes_of(level(200, 1, planted)) == [planted]


def test_patches_of_any_length_and_level_shifts():
    for n in (1, 2, 4, 5, 6, 8, 15, 25):
        assert spikes_of(level(200, n, set(range(80, 80 + n)))) == [set(range(80, 80 + n))]
    assert spikes_of(level(200, 9, set(range(100, 200)))) == [set()]  # it stays
    assert spikes_of(level(200, 9, set(range(60, 120)))) == [set()]  # ten minutes: no forecast reaches over it
    alternating = set(range(20, 140, 2))
    assert spikes_of(level(400, 3, alternating)) == [alternating]


def test_autoregression():
    r = np.random.default_rng(5)
    rate = np.zeros(3000)
    for k in range(1, 3000):
        rate[k] = 0.6 * rate[k - 1] + r.normal(0, 1)
    v = np.cumsum(10 * rate)
    v[::50] += 5000  # outliers hardly move it
    seg, one = np.zeros(3000, int), np.ones(3000)
    phi, size = autoregression(FIELDS[0], seg, 10.0 * np.arange(3000), v, one)
    assert 0.45 < phi[0] < 0.7 and 7 < size[0] < 14
    phi, _ = autoregression(FIELDS[0], seg, 10.0 * np.arange(3000), r.normal(0, 9, 3000), one)
    assert phi[0] == 0
