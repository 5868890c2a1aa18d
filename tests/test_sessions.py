from __future__ import annotations

import random

from pyspark.sql import functions as F

from skytide.functions.columns import aircraft
from skytide.operators.sessions import sessions


def brute(rows, gap):
    out = []
    for dev in {d for d, t in rows if d is not None}:
        ts = sorted(t for d, t in rows if d == dev and t is not None)
        if not ts:
            continue
        a = z = ts[0]
        n = 1
        for t in ts[1:]:
            if t - z <= gap:
                z, n = t, n + 1
            else:
                out.append((dev, a, z, z - a, n))
                a = z = t
                n = 1
        out.append((dev, a, z, z - a, n))
    return sorted(out)


def run(spark, rows, gap_s, chunk_s):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "device STRING, us BIGINT, chunk STRING, cell INT")
    return sorted(map(tuple, sessions(df, F.col("device"), F.col("us"), gap_s, chunk_s).collect()))


def test_matches_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, r.randrange(-50_000_000, 400_000_000)])) for _ in range(400)]
    rows += rows[:40]  # repeats and ties
    for gap_s, chunk_s in ((3.0, 20), (0.5, 1000), (1e-6, 1)):
        assert run(spark, rows, gap_s, chunk_s) == brute(rows, round(gap_s * 1e6))


def test_gap_itself_stays_together(spark):
    assert run(spark, [("a", 0), ("a", 600_000_000), ("a", 1_200_000_001)], 600, 86_400) == [("a", 0, 600_000_000, 600_000_000, 2), ("a", 1_200_000_001, 1_200_000_001, 0, 1)]


def test_empty_and_blank(spark):
    assert run(spark, [], 600, 60) == []
    df = spark.createDataFrame([(" ab1 ",), ("",), ("  ",), (None,)], "icao STRING")
    assert [r[0] for r in df.select(aircraft(F.col("icao"))).collect()] == ["AB1", None, None, None]
