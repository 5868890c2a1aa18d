"""The live pipeline's sweeps and expiry in processing time."""

from __future__ import annotations

import time
from datetime import datetime, timezone

import pytest

from skytide.operators.archive import counts, read_archive
from skytide.session import shared_dir
from skytide.sources.topics import publish, read, subscribe
from skytide.streaming.live import DECODED, RAW, STATE_LOG, start_archiver, start_folder, start_history

T0 = int(datetime(2025, 5, 6, 7, tzinfo=timezone.utc).timestamp() * 1e6)


def message(seq, us, **fields):
    row = dict.fromkeys(DECODED.names) | {"seq": seq, "station_id": "s", "us": us, "icao": "A", "fp": str(seq)} | fields
    return tuple(row[n] for n in DECODED.names)


def kinds(spark, root):
    return [(r.kind, r.messages) for r in read(spark, f"{root}/state", STATE_LOG).collect()]


def wait(spark, root, done, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        try:
            if done(kinds(spark, root)):
                return kinds(spark, root)
        except Exception:  # nothing written yet
            pass
        time.sleep(0.5)
    raise AssertionError(kinds(spark, root))


def test_sweep_expiry_and_fresh_start(spark):
    root = shared_dir(spark, "live")
    publish(spark.createDataFrame([message(1, T0, altitude=5), message(2, T0 + 1, altitude=5)], DECODED), f"{root}/decoded", 0)
    q = start_folder(spark, root, {"processingTime": "500 milliseconds"}, sweep_ms=1000, expire_ms=4000)
    try:
        log = wait(spark, root, lambda k: ("tombstone", None) in k)
        assert sorted(log, key=str) == sorted([("changed", 1), ("sweep", 2), ("tombstone", None)], key=str)
        publish(spark.createDataFrame([message(3, T0, altitude=7)], DECODED), f"{root}/decoded", 1)
        wait(spark, root, lambda k: k.count(("changed", 1)) == 2)  # starts afresh
    finally:
        q.stop()
    assert read(spark, f"{root}/traces", STATE_LOG).count() == 2
    assert subscribe(spark, [f"{root}/decoded", f"{root}/decoded"], DECODED).isStreaming


def trace(seq, icao, us=T0, **fields):
    row = dict.fromkeys(STATE_LOG.names) | {"kind": "changed", "seq": seq, "icao": icao, "event_station_id": "s", "event_us": us, "first_us": us, "last_us": us, "stations": ["s"], "messages": 1} | fields
    return tuple(row[n] for n in STATE_LOG.names)


def test_history_of_a_live_and_a_replay_topic(spark):
    root = shared_dir(spark, "history")
    publish(spark.createDataFrame([trace(1, "A", altitude=1), trace(2, "B", altitude=2)], STATE_LOG), f"{root}/live", 0)
    publish(spark.createDataFrame([trace(9, "A", altitude=1), trace(3, "C", altitude=3)], STATE_LOG), f"{root}/replay", 0)
    go = lambda: start_history(spark, [f"{root}/live", f"{root}/replay"], f"{root}/table", f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    go()
    publish(spark.createDataFrame([trace(4, "A", altitude=1), trace(5, "D", T0 + 86_400_000_000)], STATE_LOG), f"{root}/live", 1)
    go()
    table = spark.read.parquet(f"{root}/table")
    assert sorted((r.icao, r.seq) for r in table.collect()) == [("A", 1), ("B", 2), ("C", 3), ("D", 5)]
    publish(spark.createDataFrame([trace(6, "E"), trace(7, None)], STATE_LOG), f"{root}/live", 2)
    with pytest.raises(Exception, match="lacks a required member"):
        go()
    assert spark.read.parquet(f"{root}/table").count() == 4


def test_archiver_keeps_everything(spark):
    root = shared_dir(spark, "archive")
    at = datetime(2025, 5, 6, 7, tzinfo=timezone.utc)
    rows = [(1, "s", 1, at, "x", at), (2, "s", 1, at, "x", at), (3, "s", 2, None, "\x1a", at)]
    publish(spark.createDataFrame(rows, RAW), f"{root}/raw", 0)
    start_archiver(subscribe(spark, [f"{root}/raw"], RAW), f"{root}/archive", f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    got = read_archive(spark, f"{root}/archive")
    assert got.count() == 3 and {r.dt: r.events for r in counts(got).collect()} == {"2025-05-06": 1, "unknown": 1}
