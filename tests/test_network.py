"""Decoding, marks, the fold, archive, history, registry, ingress, queue and map on small cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytide.operators import archive, history, ingress, livemap, queue, registry
from skytide.operators.decode import decode, from_json_log, rejects, to_json_log
from skytide.operators.fold import FIELDS, current_sky, fold, traces, view
from skytide.operators.marks import drop_replays
from skytide.schemas import PAYLOAD
from skytide.session import shared_dir
from skytide.streaming.live import apply

T0 = datetime(2025, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
WIRE = "seq BIGINT, station_id STRING, id BIGINT, ts TIMESTAMP, raw STRING, received_at TIMESTAMP"
HEAD = "MSG,{},1,1,{},1,2026/01/02,03:04:05.678,2026/01/02,03:04:05.700,"


def line(kind, icao, rest):
    return HEAD.format(kind, icao) + rest


GOOD = [
    line(1, "ABC123", "XYZ12  ,,,,,,,,,,,0"), line(2, "ABC123", ",0,12.5,270.1,40.25,-83.5,,,,,,-1"), line(3, "ABC123", ",+8275,,,40.25,-83.5,,,0,,0,0"), line(4, "ABC123", ",,431,87.5,,,-64,,,,,0"),
    line(6, "ABC123", ",5000,,,,,,0421,-1,-1,-1,0"), line(8, "", ",,,,,,,,,,,0"), line(5, "ABC123", ",000000000050,,,,,,,0,,0,0"), line(4, "ABC123", ", ,1e2,.5,,,5,,,,,0").replace(", ,1e2", ",,1e2"),
]
BAD = {
    "hello": "fields", "": "fields", None: "fields", line(1, "A", ",,,"): "fields", line(3, "A", ",high,,,,,,,,,,0"): "altitude", line(3, "A", ", 5,,,,,,,,,,0"): "altitude",
    line(3, "A", ",99999999999,,,,,,,,,,0"): "altitude", line(3, "A", ",1.0,,,,,,,,,,0"): "altitude", line("x", "A", ",,,,,,,,,,,0"): "transmission_type", line(4, "A", ",,nan,,,,,,,,,0"): "ground_speed",
    line(4, "A", ",,1d,,,,,,,,,0"): "ground_speed", line(8, "A", ",,,,,,,,,,,T"): "on_ground", line(8, "A", ",,,,,,,,1,,,0"): "alert", line(3, "A", ",,,,,,,,,,,0\n"): "on_ground",
}


def wire(spark, lines):
    return spark.createDataFrame([(k, "st", k, T0, r, T0) for k, r in enumerate(lines)], WIRE)


def test_good_lines(spark):
    rows = decode(wire(spark, GOOD)).orderBy("seq").collect()
    assert len(rows) == len(GOOD)
    assert (rows[0].callsign, rows[0].on_ground, rows[0].generated) == ("XYZ12", False, "2026/01/02 03:04:05.678")
    assert (rows[1].altitude, rows[1].ground_speed, rows[1].lat, rows[1].on_ground) == (0, 12.5, 40.25, True)
    assert (rows[2].altitude, rows[3].vertical_rate, rows[4].squawk, rows[4].emergency) == (8275, -64, "0421", True)
    assert rows[5].icao is None and rows[6].altitude == 50 and rows[7].ground_speed == 100 and rows[7].track == 0.5
    assert rejects(wire(spark, GOOD)).count() == 0


def test_bad_lines_are_rejected_whole(spark):
    w = wire(spark, list(BAD)).unionAll(spark.createDataFrame([(90, None, 1, T0, GOOD[0], T0), (91, "st", 1, None, GOOD[0], T0)], WIRE))
    assert decode(w).count() == 0
    assert [r.reason for r in rejects(w).orderBy("seq").collect()] == [*BAD.values(), "station_id", "ts"]


def test_json_logs(spark):
    log = spark.createDataFrame([(1, '{"station_id":"s","ts":"2025-05-06T07:08:09.000001Z","raw":"' + GOOD[0] + '","more":1}'), (2, "no json")], "seq BIGINT, value STRING")
    rows = from_json_log(log)
    assert decode(rows).count() == 1 and rejects(rows).count() == 1
    out = to_json_log(decode(rows)).first()
    assert out.key == "ABC123" and '"ts":"2025-05-06T07:08:09.000001Z"' in out.value and "altitude" not in out.value


def messages(n, seed):
    r = random.Random(seed)
    some = lambda x: r.choice([None, x])
    out = []
    for seq in range(n):
        ts = r.choice([T0, T0, datetime(1969, 12, 31, 23, 59, 59, 999500, tzinfo=timezone.utc)]) + timedelta(microseconds=r.randrange(6000))
        lat = some(r.choice([1.0, 2.0]))
        row = {"callsign": some(r.choice("AB")), "altitude": some(r.randrange(3)), "ground_speed": some(1.5), "track": some(0.0), "lat": lat, "lon": some(lat), "vertical_rate": some(0)}
        row |= {"squawk": some("0001"), "alert": some(True), "emergency": some(r.random() < 0.5), "spi": some(False), "on_ground": some(True)}
        out.append((seq, r.choice("st"), ts, T0, "MSG", 3, r.choice(["X", "Y", None]), r.choice(["g", None]), "l", *row.values()))
    return out


COLUMNS = "seq BIGINT, station_id STRING, ts TIMESTAMP, received_at TIMESTAMP, message_type STRING, transmission_type INT, icao STRING, generated STRING, logged STRING, " + ", ".join(f"{n} {t}" for n, t in PAYLOAD.items())


@pytest.mark.parametrize("chunk", [3, 40, 1000])
def test_marks_match_a_sequential_model(spark, chunk):
    rows = messages(200, chunk)
    mark, want = {}, []
    for r in rows:
        fp = (r[7] or "null", r[8], r[6] or "null")
        m = mark.get(r[1])
        if m is None or r[2] > m[0] or (r[2] == m[0] and fp != m[1]):
            mark[r[1]] = (r[2], fp)
            want.append(r[0])
    assert sorted(x.seq for x in drop_replays(spark.createDataFrame(rows, COLUMNS), chunk).collect()) == want


def one_by_one(s: dict, m: dict) -> bool:
    """Fold a message into a picture by plain steps; whether a field changed."""
    us = m["us"]
    values = {f: m[f] for f in PAYLOAD} | {"position_us": us if m["lat"] is not None and m["lon"] is not None else None}
    changed = False
    for f, v in values.items():
        if v is not None and us // 1000 >= s["set"].get(f, 0):
            changed |= s[f] != v
            s[f], s["set"][f] = v, us // 1000
    s["messages"] += 1
    s["stations"] = sorted({*s["stations"], m["station_id"]})
    s["first_us"], s["last_us"] = min(us, s["first_us"] or us), max(us, s["last_us"] or us)
    return changed


@pytest.mark.parametrize("chunk", [3, 40, 1000])
def test_fold_matches_a_sequential_model(spark, chunk):
    rows = messages(200, chunk + 1)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    members = [*PAYLOAD, "position_us", "first_us", "last_us", "stations", "messages"]
    state, want, mine = {}, {}, {}
    for r in rows:
        m = dict(zip(names, r))
        if m["icao"] is None:
            continue
        m["us"] = round((m["ts"] - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
        s = state.setdefault(m["icao"], dict.fromkeys(members) | {"stations": [], "messages": 0, "set": {}})
        changed = one_by_one(s, m)
        want[m["seq"]] = (*[s[f] for f in members], changed)
        mine.setdefault(m["icao"], []).append(m)
    df = fold(spark.createDataFrame(rows, COLUMNS), chunk)
    us = lambda c: F.unix_micros(c)
    got = df.select("seq", *PAYLOAD, us("position_ts"), us("first_seen"), us("last_seen"), "stations", "messages", "changed").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want
    assert traces(df).count() == sum(w[-1] for w in want.values())
    assert current_sky(df).count() == 2 and len(FIELDS) == 13
    # the live pipeline's fold, in micro-batches
    for all_ in mine.values():
        s = dict.fromkeys(members) | {"stations": [], "messages": 0, "set_ms": [0] * 13}
        for k in range(0, len(all_), 7 * chunk):
            part = all_[k : k + 7 * chunk]
            pictures, changed = apply(s, pd.DataFrame(part))
            for i, m in enumerate(part):
                assert (*[pictures[f][i] for f in members], bool(changed[i])) == want[m["seq"]]


def test_view_of_a_state_log(spark):
    log = spark.createDataFrame([(1, "a", "changed", 1), (2, "a", "sweep", 2), (3, "b", "changed", 1), (4, "b", "tombstone", None), (5, "", "changed", 9)], "seq BIGINT, icao STRING, op STRING, altitude INT")
    assert [(r.icao, r.altitude) for r in view(log).collect()] == [("a", 2)]


def test_archive(spark):
    rows = [(1, "s", 1, T0, "b", T0), (2, "s", 1, T0, "a", T0), (3, "s", 2, T0 + timedelta(days=1), "c", T0), (4, "s", 3, None, "\x1a", T0), (5, None, 3, T0, "z", None)]
    w, root = spark.createDataFrame(rows, WIRE), shared_dir(spark, "archive")
    for batch in (0, 1, 1):
        archive.write_archive(w, root, batch)
    a = archive.read_archive(spark, root)
    assert a.count() == 10
    assert [r.dt for r in archive.days(a).collect()] == ["2025-05-06", "2025-05-07"]
    assert [(r.seq, r.raw) for r in archive.replay(a).orderBy("seq").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    assert {(r.dt, r.station_id): r.events for r in archive.counts(a).collect()} == {("2025-05-06", "s"): 2, ("2025-05-07", "s"): 1, ("unknown", ""): 2}
    assert {r.dt: (r.first_stamp, r.rows) for r in archive.manifest(archive.archive_rows(w)).collect()}["2025-05-06"] == ("20250506T070809.000000Z", 2)
    assert archive.replay(a.limit(0)).count() == 0


def test_history_keeps_the_first_of_a_key(spark):
    cols = "seq BIGINT, event_station_id STRING, event_ts TIMESTAMP, icao STRING, last_seen TIMESTAMP, first_seen TIMESTAMP, lat DOUBLE, lon DOUBLE, position_ts TIMESTAMP"
    row = lambda seq, icao, lat, s=0: (seq, "s", T0, icao, T0 + timedelta(seconds=s), T0, lat, 2.0, T0 + timedelta(seconds=s))
    there, more = spark.createDataFrame([row(1, "a", 1.0)], cols), spark.createDataFrame([row(2, "a", 9.0), row(4, "b", 4.0), row(3, "b", 3.0), row(5, "a", 5.0, 7)], cols)
    merged = history.upsert(there, more)
    assert sorted((r.icao, r.lat) for r in merged.collect()) == [("a", 1.0), ("a", 5.0), ("b", 3.0)]
    assert history.upsert(merged, more).count() == 3
    path = shared_dir(spark, "history")
    history.write_traces(merged, path)
    assert [r.lat for r in history.flight_path(spark.read.parquet(path), "a", T0, T0 + timedelta(seconds=7)).collect()] == [1.0, 5.0]


def test_a_trace_without_identity_stops_the_batch(spark):
    good = '{"icao":"a","first_seen":"2026-01-01T00:00:00Z","last_seen":"2026-01-01T00:00:00Z","event_station_id":"s","event_ts":"2026-01-01T00:00:00Z"}'
    assert history.decode_traces(spark.createDataFrame([(good,)], "value STRING")).count() == 1
    with pytest.raises(Exception, match="lacks"):
        history.decode_traces(spark.createDataFrame([(good,), ("{}",)], "value STRING")).collect()


def test_registry(spark):
    st = spark.createDataFrame([("aa1", T0, None), ("ab2", T0, None), ("b3", T0, T0)], "id STRING, created_at TIMESTAMP, revoked_at TIMESTAMP")
    tok = spark.createDataFrame([("t1", "aa1", T0, None), ("t2", "aa1", T0, T0), ("t3", "b3", T0, None)], "text STRING, station_id STRING, created_at TIMESTAMP, revoked_at TIMESTAMP").withColumn("token_hash", F.sha2("text", 256))
    req = spark.createDataFrame([("1", "Bearer t1"), ("2", "bearer t1"), ("3", "Bearer t2"), ("4", "Bearer t3"), ("5", None), ("6", "Bearer ")], "request_id STRING, header STRING")
    assert {r.request_id: (r.station_id, r.status) for r in registry.authenticate(req, tok, st).collect()} == {"1": ("aa1", 200), **{k: (None, 401) for k in "23456"}}
    assert {r.id: r.active_tokens for r in registry.list_stations(st, tok).collect()} == {"aa1": 1, "ab2": 0, "b3": 1}
    got = registry.resolve(spark.createDataFrame([("a",), ("aa",), ("zz",), ("",)], "prefix STRING"), st)
    assert {r.prefix: (r.matches, r.id) for r in got.collect()} == {"a": (2, None), "aa": (1, "aa1"), "zz": (0, None), "": (3, None)}
    orders = tok.where("text = 't1'").select("station_id", F.left("token_hash", F.lit(12)).alias("prefix"))
    after = registry.revoke_tokens(tok, orders, F.lit(T0))
    assert after.where("revoked_now").count() == 1 and registry.authenticate(req, after.drop("revoked_now"), st).where("status = 200").count() == 0
    assert registry.revoke_station(st, spark.createDataFrame([("aa1",)], "id STRING"), F.lit(T0)).where("revoked_at IS NULL").count() == 1
    assert registry.add_station(st, spark.createDataFrame([(T0,)], "created_at TIMESTAMP")).select("id").distinct().count() == 4
    assert len(registry.list_tokens(tok).first().prefix) == 12


def test_ingress(spark):
    bodies = [(1, '{"events":[{"id":1,"ts":"2026-01-01T00:00:00+00:00","raw":"x"},{"id":2,"raw":""},{"raw":null}]}'), (2, '{"events":[]}'), (3, "{}"), (4, "junk"), (5, '{"events":[{"raw":"y"}]}')]
    req = spark.createDataFrame([(k, "s", T0, b) for k, b in bodies], "request_id INT, station_id STRING, received_at TIMESTAMP, body STRING")
    assert {r.request_id: r.problems for r in ingress.event_problems(req).collect()} == {1: ["events[1].raw", "events[2].raw"], 2: ["events"], 3: ["events"], 4: ["events"], 5: []}
    assert ingress.explode_events(req).count() == 4
    ticks = [("s", 0, 5, 2), ("s", 60, 15, 6), ("s", 120, 15, 6), ("s", 180, 15, 0), ("s", 240, 3, 1), ("s", 300, 4, 1), ("t", 0, 1, 1)]
    df = spark.createDataFrame([(s, T0 + timedelta(seconds=t), q, n) for s, t, q, n in ticks], "station_id STRING, at TIMESTAMP, seq BIGINT, depth BIGINT")
    for chunk in (60, 86_400):
        got = {(r.station_id, (r.at - T0.replace(tzinfo=None)).seconds): r for r in ingress.buffer_report(df, chunk).collect()}
        at = lambda k: got["s", k].last_event_ts and (got["s", k].last_event_ts - T0.replace(tzinfo=None)).seconds
        out = lambda k: got["s", k].last_publish_ts and (got["s", k].last_publish_ts - T0.replace(tzinfo=None)).seconds
        assert [got["s", k].event_rate for k in (0, 60, 120, 180, 240, 300)] == [None, 10 / 60, 0, 0, None, 1 / 60]
        assert [at(k) for k in (0, 60, 120, 180, 240, 300)] == [None, 60, 60, 60, None, 300]
        assert [out(k) for k in (0, 60, 120, 180, 240, 300)] == [None, 60, 60, 180, None, 300]
    beats = spark.createDataFrame([("s", T0, T0 + timedelta(seconds=2), 2), ("s", T0, T0 + timedelta(seconds=1), 1), ("x", T0, T0, 3)], "station_id STRING, reported_at TIMESTAMP, received_at TIMESTAMP, body INT")
    known = spark.createDataFrame([("s",)], "id STRING")
    first = ingress.store_heartbeats(beats.limit(0), beats, known)
    assert [r.body for r in first.collect()] == [1] and ingress.store_heartbeats(first, beats, known).count() == 0
    body = "struct<reported_at:timestamp,uptime_seconds:bigint,disk_free_bytes:bigint,buffer_depth:bigint,event_rate:double>"
    hb = spark.createDataFrame([(1, None), (2, (T0, 1, -1, 0, None)), (3, (T0, 1, 1, 0, 0.0))], f"n INT, body {body}")
    texts = spark.createDataFrame([('{"reported_at":"2025-05-06T07:08:09+00:00","buffer_depth":-1}',), ("junk",)], "body STRING")
    assert sorted(r.problems for r in ingress.heartbeat_problems(ingress.parse_heartbeats(texts)).collect()) == [["buffer_depth"], ["reported_at"]]
    assert {r.n: r.problems for r in ingress.heartbeat_problems(hb).collect()} == {1: ["reported_at"], 2: ["disk_free_bytes"], 3: []}


def test_queue(spark):
    log = queue.append(spark.createDataFrame([(1, "a", "x"), (2, "b", ""), (3, "c", "y"), (4, "d", "z")], "id BIGINT, ts STRING, raw STRING"))
    batch = queue.next_batch(log, 2)
    assert [r.id for r in batch.collect()] == [1, 3]
    assert [r.id for r in queue.next_batch(log, 2, batch).collect()] == [4]
    assert tuple(queue.sample(log, batch).first()) == (1, "d", 4)
    assert tuple(queue.sample(log, log).first()) == (0, None, 4)
    assert tuple(queue.sample(log.limit(0), batch).first()) == (0, None, 0)


def test_map(spark):
    lines = ['a\t{"lat":1}', 'b\t{"lat":2}', "b\tnull", 'a\t{"lat":3}', "a\tgarbage", "\t{}", "c", 'd\t{"x":"1"}']
    df = spark.createDataFrame(list(enumerate(lines)), "seq BIGINT, line STRING")
    assert {r.icao: r.value for r in livemap.fold_lines(df).collect()} == {"a": '{"lat":3}', "d": '{"x":"1"}'}
    sky = spark.createDataFrame([("A", 1.0, 2.0, "", None, None, ["s"], T0), ("B", None, 2.0, "c", 1, 9.0, ["s"], None), ("C", 1.0, 2.0, "c", 1, 100.0, ["s", "t"], T0 - timedelta(seconds=61))], "icao STRING, lat DOUBLE, lon DOUBLE, callsign STRING, altitude INT, track DOUBLE, stations ARRAY<STRING>, position_ts TIMESTAMP")
    got = {r.icao: (r.label, r.altitude, r.heading, r.n_stations, r.stale) for r in livemap.markers(sky, F.lit(T0)).collect()}
    assert got == {"A": ("A", "?", -45.0, 1, False), "C": ("c", "1", 55.0, 2, True)}
    assert tuple(livemap.totals(sky).first()) == (2, 3)
