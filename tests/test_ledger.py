from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from skytide.operators.redelivery import hourly_counts, repeated_deliveries
from skytide.session import shared_dir
from skytide.streaming.ledger import Ledger, ledger

T0 = datetime(2025, 3, 3, tzinfo=timezone.utc)
SCHEMA = "seq BIGINT, station_id STRING, id BIGINT, ts TIMESTAMP, raw STRING, received_at TIMESTAMP"


def deliveries(n, seed=0):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        ts = r.choice([None, datetime(1970, 1, 1, 0, 0, 21, tzinfo=timezone.utc)] + [T0 + timedelta(minutes=37 * r.randrange(60))] * 12)
        recv = r.choice([None] + [(ts or T0) + timedelta(seconds=r.randrange(40_000))] * 9)
        rows.append((seq, r.choice(["s", "s", "t"]), r.choice([0, 1, 1, 1, 2]), ts, "x", recv))
    return rows


def kept(rows):
    best = {}
    for seq, st, i, ts, _, recv in rows:
        if i:
            rank = (recv is None, recv or T0, seq)
            best[st, i, ts] = min(best.get((st, i, ts), rank), rank)
    return {v[2] for v in best.values()} | {x[0] for x in rows if not x[2]}


def counts(rows):
    keep, out = kept(rows), {}
    for seq, st, _, ts, _, recv in rows:
        if seq in keep and ts and recv:
            hour = ts.replace(minute=0, second=0, microsecond=0)
            late = (recv - hour - timedelta(hours=1)).total_seconds()
            k = 0 if late <= 300 else 1 if late <= 21_600 else 2
            out.setdefault((st, int(hour.timestamp() * 1e6)), [0, 0, 0])[k] += 1
    return out


@pytest.mark.parametrize("files,batches,watermark_s", [(1, 1, 86_400), (1, 6, 3600), (3, 7, 0), (7, 5, 86_400)])
def test_any_batching_gives_the_same(spark, tmp_path, files, batches, watermark_s):
    rows = deliveries(600, files)
    path = str(tmp_path / "wire.parquet")
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    book = ledger(spark, path, batches, drops=True, counts=True, watermark_s=watermark_s)
    assert book.batches() == list(range(batches))
    dropped = [r.seq for r in book.dropped().collect()]
    assert sorted(dropped) == sorted({x[0] for x in rows} - kept(rows))
    got = {(r.station_id, r.period_us): [r.on_time, r.late, r.beyond] for r in book.counted().collect() if r.on_time or r.late or r.beyond}
    assert got == counts(rows)
    signed, back = {}, 0
    for r in book.corrections().collect():
        signed[r.station_id, r.period_us] = signed.get((r.station_id, r.period_us), 0) + r.delta
        back += r.delta < 0
    assert {k: v for k, v in signed.items() if v} == {k: v[0] + v[1] for k, v in counts(rows).items() if v[0] + v[1]}
    assert (back > 0) == (batches > 1)


def test_a_batch_run_again_replaces_itself_and_a_ledger_goes_on(spark):
    rows = deliveries(300, 5)
    root = shared_dir(spark, "ledger")
    parts = [spark.createDataFrame(rows[k::3], SCHEMA) for k in range(3)]
    for b in (0, 1, 1, 2, 2):
        Ledger(spark, root, counts=True, watermark_s=3600).apply(parts[b], b)  # each time another process could be it
    book = Ledger(spark, root, counts=True)
    assert sorted(r.seq for r in book.dropped().collect()) == sorted({x[0] for x in rows} - kept(rows))
    last = {(r.station_id, r.period_us): r.on_time + r.late for r in book.counted().collect()}
    assert {k: v for k, v in last.items() if v} == {k: v[0] + v[1] for k, v in counts(rows).items() if v[0] + v[1]}


def test_a_stream_of_deliveries(spark, tmp_path):
    rows = deliveries(200, 8)
    path = str(tmp_path / "wire.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    book = Ledger(spark, shared_dir(spark, "ledger")).follow(stream, {"availableNow": True})
    assert sorted(r.seq for r in book.dropped().collect()) == sorted({x[0] for x in rows} - kept(rows))


def test_only_the_days_of_a_batch_are_read(spark):
    day = lambda n: T0 + timedelta(days=n)
    book = Ledger(spark, shared_dir(spark, "ledger"), watermark_s=3600)
    for b in range(4):
        book.apply(spark.createDataFrame([(10 * b + k, "s", k, day(b), "x", day(b)) for k in (1, 2)], SCHEMA), b)
    late = spark.createDataFrame([(90, "s", 1, day(0), "x", day(5)), (91, "s", 2, day(3), "x", day(5))], SCHEMA)
    read = []
    inner = book._read
    book._read = lambda s, kind, schema, at: read.append((kind, at)) or inner(s, kind, schema, at)
    book.apply(late, 4)
    first = int(T0.timestamp()) // 86_400
    assert ("state", [(3, first + 3)]) in read and ("state", [(0, first)]) in read
    assert not any(d == first + 1 for _, at in read for _, d in at)
    assert sorted(r.seq for r in book.dropped().collect()) == [90, 91]


def test_one_message_may_hold_most_rows(spark, tmp_path):
    rows = [(s, "s", 1, T0, "x", T0 + timedelta(seconds=5)) for s in range(500)] + [(1000, None, None, T0, "x", None)]
    path = str(tmp_path / "wire.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    assert sorted(r.seq for r in repeated_deliveries(spark, path).collect()) == list(range(1, 500))


def test_empty_log(spark, tmp_path):
    path = str(tmp_path / "wire.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert repeated_deliveries(spark, path).count() == 0
    assert hourly_counts(spark, path).count() == 0
