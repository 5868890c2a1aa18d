"""State carried into chunks, of keys with many chunks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skytide.functions.chunked import carry_in
from skytide.operators.fold import fold
from skytide.operators.marks import drop_replays
from skytide.schemas import PAYLOAD, struct


@pytest.mark.parametrize("width", [1, 3, 256])
def test_matches_a_loop(spark, width):
    r = random.Random(width)
    rows = [(k, r.choice("ab"), seq // 4, r.choice([None, r.randrange(50)])) for k, seq in enumerate(sorted(r.randrange(300) for _ in range(250)))]
    df = spark.createDataFrame(rows, "seq BIGINT, key STRING, chunk BIGINT, v INT")
    totals = {"max": F.max("v"), "min": F.min("v"), "sum": F.sum("v"), "last": F.max_by("v", F.when(F.col("v").isNotNull(), F.col("seq"))), "set": F.collect_set("v")}
    got = {x.seq: x for x in carry_in(df, ["key"], totals, {n: n for n in totals}, width).collect()}
    assert len(got) == len(rows)
    for seq, key, chunk, _ in rows:
        before = [x for x in rows if x[1] == key and x[2] < chunk]
        v = [x[3] for x in before if x[3] is not None]
        x = got[seq]
        assert (x.c_max, x.c_min, x.c_sum, x.c_last) == ((max(v), min(v), sum(v), v[-1]) if v else (None,) * 4)
        assert sorted(x.c_set or []) == sorted(set(v))


def test_many_chunks_of_one_key(spark):
    schema = struct(seq="bigint", station_id="string", ts="timestamp", icao="string", generated="string", logged="string", **PAYLOAD)
    r = random.Random(1)
    rows = []
    for k in range(1500):
        values = dict.fromkeys(PAYLOAD) | {"altitude": r.choice([None, r.randrange(9)]), "squawk": r.choice([None, "7"])}
        rows.append((k, r.choice("st"), r.randrange(500), "A", str(r.randrange(3)), "x", *values.values()))
    df = spark.createDataFrame([(*x[:2], None, *x[3:]) for x in rows], schema).drop("ts")
    times = spark.createDataFrame([(x[0], x[2]) for x in rows], "seq BIGINT, s BIGINT").select("seq", F.timestamp_seconds("s").alias("ts"))
    df = df.join(times, "seq").select(*schema.names)
    plain = lambda x: sorted(x.drop("position_ts").collect(), key=lambda r: r.seq)
    assert plain(fold(df, 1)) == plain(fold(df, 10_000))  # 1,500 chunks, and one
    assert sorted(drop_replays(df, 1).collect()) == sorted(drop_replays(df, 10_000).collect())
