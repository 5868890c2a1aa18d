"""Queries q_*: logs, codecs, history and registry changes of the network, each over whole tables, with SQL twins."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytide.operators import archive, history, ingress, livemap, registry
from skytide.operators.decode import from_json_log, message_key, to_json_log
from skytide.operators.fold import fold, traces
from skytide.operators.marks import fingerprint
from skytide.plans.network import _A, _D, _F, _KEYS, _REPLAY, _TRACE, Query, _decoded, _deduped, _folded, _requests, _wire, plain
from skytide.plans.network import _fold_sql as fold_sql
from skytide.schemas import PAYLOAD, RFC3339, TRACE, struct
from skytide.session import shared_dir, stage
from skytide.sources import topics
from skytide.sources.tables import table
from skytide.streaming import live

STAMP = {"timestampFormat": RFC3339}
AT_US = 1_741_000_000_000_000
#: Days of the log before this one are expired.
EXPIRED = "2025-03-06T00:00:00Z"


def q_envelope(s, d):
    """The log as JSON records with a member that nobody knows; every tenth is no JSON."""
    record = F.struct("station_id", "id", "ts", "raw", "received_at", F.lit("?").alias("extra"))
    value = F.when(F.pmod("seq", F.lit(10)) == 3, "oops").otherwise(F.to_json(record, STAMP))
    return plain(from_json_log(_wire(s, d).select("seq", value.alias("value"))))


def q_json_codec(s, d):
    """Decoded messages written as JSON and read again."""
    kinds = struct(station_id="string", ts="timestamp", received_at="timestamp", message_type="string", transmission_type="int", icao="string", generated="string", logged="string", **PAYLOAD)
    return plain(to_json_log(_decoded(s, d)).select("key", F.from_json("value", kinds).alias("m")).select("key", "m.*"))


def q_trace_contract(s, d):
    """Traces written as JSON records and read by the history's contract."""
    value = F.to_json(F.struct(*TRACE.names), STAMP).alias("value")
    return plain(history.decode_traces(traces(_folded(s, d)).select(value)))


def _log(rows):
    """Traces as rows of the live pipeline's topics."""
    us = lambda c: F.unix_micros(c)
    made = rows.withColumns({"kind": F.lit("changed"), "event_us": us("event_ts"), "position_us": us("position_ts"), "first_us": us("first_seen"), "last_us": us("last_seen")})
    return made.select(*live.STATE_LOG.names)


def q_history_stream(s, d):
    """Traces of the deduplicated log on the live topic, those of the log with all its repeats on the replay's; one reader of
    both adds them to the history table, twice. What is there of each key."""
    root = shared_dir(s, "history")
    topics.publish(_log(traces(_folded(s, d))), f"{root}/live", 0)
    topics.publish(_log(traces(fold(stage(_decoded(s, d), "decoded")))), f"{root}/replay", 0)
    for attempt in range(2):
        live.start_history(s, [f"{root}/live", f"{root}/replay"], f"{root}/table", f"{root}/checkpoint{attempt}", {"availableNow": True}).awaitTermination()
    return plain(s.read.parquet(f"{root}/table").select(*history.KEY))


def q_history_days(s, d):
    """The history table's folders: traces and aircraft per day."""
    path = f"{shared_dir(s, 'history')}/table"
    history.write_traces(history.insert_new(traces(_folded(s, d)).limit(0), traces(_folded(s, d)), history.KEY, "seq"), path)
    rows = s.read.parquet(path).groupBy("day").agg(F.count("*").alias("traces"), F.countDistinct("icao").alias("aircraft"))
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "traces", "aircraft")


def q_map_lines(s, d):
    """A map's console log: aircraft, tab, JSON; some lines remove, some are broken, have no key or no tab."""
    icao, seq = F.col("icao"), F.col("seq")
    text = F.concat(F.lit('{"seq":'), seq.cast("string"), F.lit("}"))
    line = (
        F.when(seq % 7 == 0, F.concat(icao, F.lit("\tnull"))).when(seq % 11 == 0, F.concat(icao, F.lit("\t{broken"))).when(seq % 13 == 0, F.concat(F.lit("\t"), text)).when(seq % 17 == 0, icao)
        .otherwise(F.concat(icao, F.lit("\t"), text))
    )
    return livemap.fold_lines(_decoded(s, d).where("icao IS NOT NULL").select("seq", line.alias("line")))


def q_heartbeat_json(s, d):
    """Heartbeats as JSON requests, read and checked; a request whose station's name ends in 0 is cut short."""
    body = F.to_json("body", STAMP)
    cut = F.when(F.col("station_id").endswith("0"), F.left(body, F.lit(9))).otherwise(body)
    rows = table(s, d, "heartbeat", "station_id", "received_at", "body").select("station_id", "received_at", cut.alias("body"))
    checked = ingress.heartbeat_problems(ingress.parse_heartbeats(rows))
    return plain(checked.select("station_id", "received_at", "problems", "body.reported_at", "body.uptime_seconds", "body.buffer_depth", "body.event_rate"))


def q_station_revoke(s, d):
    """All stations revoked whose id begins with an even digit."""
    st = table(s, d, "stations")
    return plain(registry.revoke_station(st, st.where("left(id, 1) IN ('0', '2', '4', '6', '8')"), F.timestamp_micros(F.lit(AT_US))))


def q_station_add(s, d):
    """As many stations again, each with a new id and a token: what the registry then holds, ids and tokens by their length."""
    st, tokens, at = table(s, d, "stations"), table(s, d, "station_tokens"), F.timestamp_micros(F.lit(AT_US))
    both = stage(registry.add_station(st, st.select(at.alias("created_at"))), "stations")
    rows, secrets = registry.mint_tokens(both.join(st.select("id"), "id", "left_anti"), at)
    known = tokens.select("token_hash", "station_id", "created_at", "revoked_at").unionByName(rows)
    good = secrets.select("station_id", F.sha2("token", 256).alias("token_hash"), F.length("token").alias("digits"))
    listed = both.join(known.groupBy(F.col("station_id").alias("id")).agg(F.count("*").alias("tokens")), "id", "left").join(good.withColumnRenamed("station_id", "id"), "id", "left")
    return plain(listed.select(F.length("id").alias("length"), "created_at", "revoked_at", F.coalesce("tokens", F.lit(0)).alias("tokens"), "digits"))


def q_token_mint(s, d):
    """A further token for every station that has an active one; requests with the new tokens."""
    tokens, st = table(s, d, "station_tokens"), table(s, d, "stations")
    rows, secrets = registry.mint_tokens(tokens.where("revoked_at IS NULL").select(F.col("station_id").alias("id")).distinct(), F.timestamp_micros(F.lit(AT_US)))
    known = tokens.select("token_hash", "station_id", "created_at", "revoked_at").unionByName(rows)
    requests = secrets.select(F.col("station_id").alias("request_id"), F.concat(F.lit("Bearer "), "token").alias("header"))
    return registry.authenticate(requests, known, st)


def q_text_ingest(s, d):
    """Receiver lines from text files, with carriage returns, taken in batch by batch."""
    root = shared_dir(s, "ingest")
    _wire(s, d).select(F.concat("raw", F.lit("\r")).alias("value")).repartition(6).write.mode("overwrite").text(f"{root}/text")
    topics.ingest(topics.lines(s, f"{root}/text", 2), f"{root}/lines", f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    return topics.read(s, f"{root}/lines", struct(raw="string")).groupBy("raw").agg(F.count("*").alias("n"))


def q_topic_lag(s, d):
    """Readers of a log in three partitions: one has all but one partition's decodable rows, one nothing."""
    rows = _wire(s, d).withColumns({"topic": F.lit("events.raw"), "part": F.pmod("seq", F.lit(3)).cast("int")})
    ends = rows.groupBy("topic", "part").agg(F.max("seq").alias("last"))
    done = rows.where("part = 2 OR seq % 5 <> 0").where("part <> 1 OR seq < 1000").groupBy("topic", "part").agg(F.max("seq").alias("done"))
    groups = s.createDataFrame([("archiver", "events.raw"), ("history", "events.raw")], "reader STRING, topic STRING")
    return topics.lag(ends, done.withColumn("reader", F.lit("archiver")), groups, 20)


def q_replay_batches(s, d):
    """The archive produced again to a topic, in batches of 5,000."""
    topic = f"{shared_dir(s, 'replay')}/topic"
    archive.produce(archive.replay(archive.archive_rows(_wire(s, d))), topic)
    rows = topics.read(s, topic, T.StructType([*live.RAW.fields, T.StructField("batch", T.LongType())]))
    return plain(rows.groupBy("batch").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"), F.count("received_at").alias("received"), F.min("ts").alias("ts")))


def q_state_compact(s, d):
    """The trace topic in three batches, compacted."""
    topic = f"{shared_dir(s, 'compact')}/topic"
    rows = stage(_log(traces(_folded(s, d))), "traces")
    for b in range(3):
        topics.publish(rows.where(F.pmod("seq", F.lit(3)) == b), topic, b)
    topics.compact(s, topic, live.STATE_LOG, "icao", "seq")
    left = topics.read(s, topic, live.STATE_LOG)
    return left.select("icao", "seq", "event_station_id", F.col("last_us").alias("last_seen_us"), "messages", "altitude", "lat", "lon")


def q_retention(s, d):
    """The log as a topic with a batch per day of receipt, of which old days are dropped."""
    topic = f"{shared_dir(s, 'retention')}/topic"
    day = F.coalesce(F.unix_date(F.to_date("received_at")), F.lit(0))
    _wire(s, d).withColumn("batch_id", day).write.mode("overwrite").partitionBy("batch_id").parquet(topic)
    topics.expire(s, topic, live.RAW, "received_at", F.to_timestamp(F.lit(EXPIRED)))
    left = s.read.schema(T.StructType([*live.RAW.fields, T.StructField("batch_id", T.LongType())])).parquet(topic)
    return left.groupBy("batch_id").agg(F.count("*").alias("rows"))


def q_live_expiry(s, d):
    """Every aircraft of the live fold after the log has ended: swept if its last message changed nothing, then removed."""
    root = shared_dir(s, "expiry")
    rows = _deduped(s, d)
    kept = stage(rows.select("seq", "station_id", F.unix_micros("ts").alias("us"), "icao", fingerprint().alias("fp"), *PAYLOAD), "deduped")
    topics.publish(kept, f"{root}/decoded", 0)
    n = kept.where("icao IS NOT NULL").select("icao").distinct().count()
    query = live.start_folder(s, root, {"processingTime": "500 milliseconds"}, sweep_ms=500, expire_ms=1500)
    try:
        while n and query.isActive:
            done = query.lastProgress is not None and topics.read(s, f"{root}/state", live.STATE_LOG).where("kind = 'tombstone'").count()
            if done and done >= n:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    return topics.read(s, f"{root}/state", live.STATE_LOG).groupBy("icao").agg(count("changed"), count("sweep"), count("tombstone"))


def q_live_restart(s, d):
    """Traces of the live pipeline, stopped in the middle of the log and started again from its checkpoints."""
    root, rows = shared_dir(s, "restart"), _wire(s, d)
    middle = rows.agg(F.avg("seq")).first()[0] or 0
    for b, part in enumerate((rows.where(F.col("seq") < middle), rows.where(F.col("seq") >= middle))):
        topics.publish(part, f"{root}/raw", b)
        live.start_decoder(s, topics.subscribe(s, [f"{root}/raw"], live.RAW), root, {"availableNow": True}).awaitTermination()
        live.start_folder(s, root, {"availableNow": True}, None).awaitTermination()
    made = topics.read(s, f"{root}/traces", live.STATE_LOG).drop("kind")
    return plain(made.withColumnsRenamed({"position_us": "position_ts_us", "first_us": "first_seen_us", "last_us": "last_seen_us", "event_us": "event_ts_us"}))


def q_archive_stream(s, d):
    """The log's topic archived by a streaming query, started again for its second half: events per date and station."""
    root, rows = shared_dir(s, "archiver"), _wire(s, d)
    for b in range(2):
        topics.publish(rows.where(F.pmod("seq", F.lit(2)) == b), f"{root}/raw", b)
        live.start_archiver(topics.subscribe(s, [f"{root}/raw"], live.RAW), f"{root}/archive", f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    return archive.read_archive(s, f"{root}/archive").groupBy("dt", "station_id").agg(F.count("*").alias("events"))


def q_gateway_publish(s, d):
    """The events of all requests published to a topic, keyed by station, and read again."""
    topic = f"{shared_dir(s, 'gateway')}/topic"
    rows = ingress.explode_events(_requests(s, d))
    topics.publish(rows.withColumn("key", F.col("station_id")), topic, 0)
    kinds = T.StructType([T.StructField("key", T.StringType()), *[f for f in live.RAW.fields if f.name != "seq"]])
    return plain(topics.read(s, topic, kinds))


def q_state_records(s, d):
    """The state topic's records: the traces, and a tombstone after every seventh; what is there of each aircraft."""
    log = _log(traces(_folded(s, d)))
    gone = log.where("seq % 7 = 0").withColumns({"kind": F.lit("tombstone"), "seq": F.col("seq") + 0.5})
    kept = stage(log.unionByName(gone), "state")
    last = live.state_records(kept).groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("x")).select("key", "x.value").where("value IS NOT NULL")
    return plain(last.select("key", F.from_json("value", TRACE).alias("t")).select("key", "t.last_seen", "t.messages", "t.stations", "t.altitude", "t.lat", "t.lon", "t.on_ground"))


QUERIES: dict[str, Query] = {n: q for n, q in list(globals().items()) if n.startswith("q_")}

# -- SQL twins

_FIELDS = ", ".join(PAYLOAD)
_ALL = _F + ", " + fold_sql("dec", "all_")

SQL: dict[str, str] = {
    "q_envelope": "SELECT seq, "
    + ", ".join(f"CASE WHEN seq % 10 <> 3 THEN {c} END AS {n}" for c, n in (("station_id", "station_id"), ("id", "id"), ("epoch_us(ts)", "ts_us"), ("raw", "raw"), ("epoch_us(received_at)", "received_at_us")))
    + " FROM wire",
    "q_json_codec": _D
    + f' SELECT coalesce(icao, station_id) AS key, station_id, epoch_us(ts) AS ts_us, epoch_us(received_at) AS received_at_us, message_type, transmission_type, icao, "generated", logged, {_FIELDS} FROM dec',
    "q_trace_contract": _F + f" SELECT * EXCLUDE (seq) FROM {_TRACE}",
    "q_history_stream": _ALL + f" SELECT {_KEYS} FROM {_TRACE} UNION SELECT {_KEYS} FROM all_ WHERE changed",
    "q_history_days": _F
    + f", t AS (SELECT DISTINCT {_KEYS} FROM {_TRACE}) SELECT strftime(make_timestamp(last_seen_us), '%Y-%m-%d') AS \"day\", count(*) AS traces, count(DISTINCT icao) AS aircraft FROM t GROUP BY 1",
    "q_map_lines": _D
    + """, l AS (SELECT seq, icao, CASE WHEN seq % 7 = 0 THEN 'null' ELSE '{"seq":' || seq || '}' END AS value FROM dec
        WHERE icao IS NOT NULL AND icao <> '' AND (seq % 7 = 0 OR (seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0)))
    SELECT icao, value FROM l QUALIFY row_number() OVER (PARTITION BY icao ORDER BY seq DESC) = 1 AND value <> 'null'""",
    "q_heartbeat_json": """WITH h AS (SELECT station_id, received_at, CASE WHEN NOT ends_with(station_id, '0') THEN body END AS body FROM heartbeat)
    SELECT station_id, epoch_us(received_at) AS received_at_us, concat_ws(',', CASE WHEN body.reported_at IS NULL THEN 'reported_at' END, CASE WHEN body.uptime_seconds < 0 THEN 'uptime_seconds' END,
        CASE WHEN body.disk_free_bytes < 0 THEN 'disk_free_bytes' END, CASE WHEN body.buffer_depth < 0 THEN 'buffer_depth' END, CASE WHEN body.event_rate < 0 THEN 'event_rate' END) AS problems,
        epoch_us(body.reported_at) AS reported_at_us, body.uptime_seconds AS uptime_seconds, body.buffer_depth AS buffer_depth, body.event_rate AS event_rate FROM h""",
    "q_station_revoke": f"""SELECT id, epoch_us(created_at) AS created_at_us,
    CASE WHEN revoked_at IS NULL AND id[:1] IN ('0', '2', '4', '6', '8') THEN {AT_US} ELSE epoch_us(revoked_at) END AS revoked_at_us FROM stations""",
    "q_station_add": f"""SELECT CAST(length(id) AS INT) AS "length", epoch_us(created_at) AS created_at_us, epoch_us(revoked_at) AS revoked_at_us,
        (SELECT count(*) FROM station_tokens t WHERE t.station_id = s.id) AS tokens, CAST(NULL AS INT) AS digits FROM stations s
    UNION ALL SELECT 36, {AT_US}, NULL, 1, 64 FROM stations""",
    "q_token_mint": """WITH k AS (SELECT DISTINCT station_id FROM station_tokens WHERE revoked_at IS NULL)
    SELECT k.station_id AS request_id, s.id AS station_id, CASE WHEN s.id IS NULL THEN 401 ELSE 200 END AS status
    FROM k LEFT JOIN (SELECT id FROM stations WHERE revoked_at IS NULL) s ON s.id = k.station_id""",
    "q_text_ingest": "SELECT raw, count(*) AS n FROM wire WHERE raw <> '' GROUP BY raw",
    "q_topic_lag": """WITH r AS (SELECT seq, seq % 3 AS part FROM wire), e AS (SELECT part, max(seq) AS last FROM r GROUP BY part),
    c AS (SELECT part, max(seq) AS done FROM r WHERE (part = 2 OR seq % 5 <> 0) AND (part <> 1 OR seq < 1000) GROUP BY part)
    SELECT 'archiver' AS reader, 'events.raw' AS topic, count(*) FILTER (last - done > 20) AS behind FROM c JOIN e USING (part)
    UNION ALL SELECT 'history', 'events.raw', 1""",
    "q_replay_batches": _REPLAY + " SELECT (seq - 1) // 5000 AS batch, count(*) AS rows, CAST(0 AS BIGINT) AS ids, CAST(0 AS BIGINT) AS received, epoch_us(min(ts)) AS ts_us FROM rep GROUP BY 1",
    "q_state_compact": _F
    + f" SELECT icao, seq, event_station_id, last_seen_us, messages, altitude, lat, lon FROM {_TRACE} QUALIFY row_number() OVER (PARTITION BY icao ORDER BY seq DESC) = 1",
    "q_retention": f"""WITH r AS (SELECT coalesce(date_diff('day', DATE '1970-01-01', CAST(received_at AS DATE)), 0) AS batch_id, received_at FROM wire)
    SELECT batch_id, count(*) AS rows FROM r GROUP BY 1 HAVING bool_or(received_at IS NULL OR received_at >= TIMESTAMPTZ '{EXPIRED}')""",
    "q_live_restart": _F + f" SELECT * FROM {_TRACE}",
    "q_archive_stream": _A + " SELECT dt, station_id, count(*) AS events FROM a GROUP BY ALL",
    "q_gateway_publish": "SELECT station_id AS key, station_id, id, epoch_us(ts) AS ts_us, raw, epoch_us(date_trunc('hour', received_at)) AS received_at_us FROM wire WHERE received_at IS NOT NULL",
    "q_state_records": _F
    + f""" SELECT icao AS key, last_seen_us, messages, stations, altitude, lat, lon, on_ground FROM {_TRACE} QUALIFY row_number() OVER (PARTITION BY icao ORDER BY seq DESC) = 1 AND seq % 7 <> 0""",
    "q_live_expiry": _F
    + """, l AS (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY seq DESC) AS n FROM fol)
    SELECT icao, count(*) FILTER (changed) AS changed, count(*) FILTER (n = 1 AND NOT changed) AS sweep, CAST(1 AS BIGINT) AS tombstone FROM l GROUP BY icao""",
}
