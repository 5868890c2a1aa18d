"""Queries q_*: the network's own operators over the wire log and the registry, each over whole tables, with SQL twins.

Times come out as microseconds (BIGINT) and arrays as joined text, so that both engines print them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytide.functions.columns import micros
from skytide.operators import archive, history, ingress, livemap, queue, registry
from skytide.operators.decode import decode, message_key, rejects, to_json_log
from skytide.operators.fold import current_sky, fold, traces
from skytide.operators.marks import drop_replays
from skytide.schemas import PAYLOAD
from skytide.session import shared_dir, stage
from skytide.sources.tables import table, table_path
from skytide.sources.topics import read
from skytide.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
TIMES = ("ts", "received_at", "event_ts", "position_ts", "first_seen", "last_seen", "created_at", "revoked_at", "reported_at", "at", "last_event_ts", "last_publish_ts", "oldest_ts")


def plain(df: DataFrame) -> DataFrame:
    """Times to ``<name>_us``, arrays to text."""
    out = []
    for name, kind in df.dtypes:
        if kind == "timestamp":
            out.append(micros(F.col(name)).alias(f"{name}_us"))
        elif kind == "array<string>":
            out.append(F.array_join(name, ",").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def _wire(s, d):
    return table(s, d, "wire", "seq", "station_id", "id", "ts", "raw", "received_at")


def _decoded(s, d):
    return decode(_wire(s, d))


def _deduped(s, d):
    return drop_replays(stage(_decoded(s, d), "decoded"))


def _folded(s, d):
    return fold(stage(_deduped(s, d), "deduped"))


def _beats(s, d):
    rows = table(s, d, "heartbeat", "station_id", "received_at", "body").where("body.reported_at IS NOT NULL")
    return rows.select("station_id", F.col("body.reported_at").alias("reported_at"), "received_at", "body")


def q_decode(s, d):
    return plain(_decoded(s, d))


def q_decode_rejects(s, d):
    return rejects(_wire(s, d))


def q_decoded_wire(s, d):
    rows = _decoded(s, d)
    keyed = rows.select(message_key().alias("key"), "seq", "station_id", "ts", "message_type", "transmission_type", *PAYLOAD)
    return plain(keyed)


def q_decoded_json(s, d):
    return to_json_log(_decoded(s, d))


def q_dedup(s, d):
    return plain(_deduped(s, d).select("seq", "station_id", "ts", "icao"))


def q_fold(s, d):
    return plain(_folded(s, d))


def q_traces(s, d):
    return plain(traces(_folded(s, d)))


def q_current_sky(s, d):
    return plain(current_sky(_folded(s, d)))


def q_trace_upsert(s, d):
    """Traces of the deduplicated log are there; those of the log with all its repeats come in, twice."""
    there, more = stage(traces(_folded(s, d)), "traces"), stage(traces(fold(stage(_decoded(s, d), "decoded"))), "traces")
    first = history.insert_new(there.limit(0), there, history.KEY, "seq")
    return plain(history.upsert(first, more.unionAll(more)))


def q_backfill_merge(s, d):
    """Traces as they came, merged with those that a replay of the archive makes, on the natural key."""
    there = stage(traces(_folded(s, d)), "traces")
    replayed = archive.replay(archive.archive_rows(_wire(s, d))).withColumn("received_at", F.lit(None).cast("timestamp"))
    again = traces(fold(stage(drop_replays(stage(decode(replayed), "decoded")), "deduped")))
    first = history.insert_new(there.limit(0), there, history.KEY, "seq")
    return plain(history.upsert(first, again).drop("seq"))


#: A range of the log that has every hour of the day.
SINCE, UNTIL = "2025-03-04T06:00:00Z", "2025-03-07T18:00:00Z"


def q_flight_path(s, d):
    """Path of the most heard aircraft over some days."""
    rows = stage(traces(_folded(s, d)), "traces").withColumn("day", F.to_date("last_seen"))
    busiest = rows.groupBy("icao").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "icao").first()
    when = lambda t: F.to_timestamp(F.lit(t))
    path = history.flight_path(rows, busiest.icao if busiest else None, when(SINCE), when(UNTIL))
    return plain(path.where("lat IS NOT NULL AND lon IS NOT NULL"))


def q_archive_partition(s, d):
    return plain(archive.archive_rows(_wire(s, d)))


def q_archive_days(s, d):
    return archive.days(archive.archive_rows(_wire(s, d)))


def q_archive_manifest(s, d):
    return archive.manifest(archive.archive_rows(_wire(s, d)))


def q_archive_read(s, d):
    return plain(archive.replay(archive.archive_rows(_wire(s, d))))


def q_archive_counts(s, d):
    return archive.counts(archive.archive_rows(_wire(s, d)))


def q_archive_round_trip(s, d):
    """The archive written in two overlapping batches and read back: distinct events per date and station."""
    root, rows = shared_dir(s, "archive"), _wire(s, d)
    archive.write_archive(rows, root, 0)
    archive.write_archive(rows, root, 1)
    return archive.counts(archive.read_archive(s, root))


def _requests(s, d):
    """A request per station and hour of receipt, its body JSON."""
    rows = _wire(s, d).where("received_at IS NOT NULL")
    hour = F.date_trunc("hour", "received_at")
    body = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("seq", "id", "ts", "raw"))).alias("events")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})
    return rows.groupBy("station_id", hour.alias("received_at"), F.floor(F.col("seq") / 500)).agg(F.min("seq").alias("request_id"), body.alias("body"))


def q_ingress_explode(s, d):
    return plain(ingress.explode_events(_requests(s, d)))


def q_validate_events(s, d):
    """Each delivery as a request of its own; every line that isn't 22 fields long is sent blank."""
    rows = _wire(s, d)
    raw = F.when(F.size(F.split("raw", ",", -1)) == 22, F.col("raw")).otherwise("")
    body = F.to_json(F.struct(F.array(F.struct("id", raw.alias("raw")), F.struct(F.lit(0).alias("id"), F.lit("x").alias("raw"))).alias("events")))
    return plain(ingress.event_problems(rows.select(F.col("seq").alias("request_id"), body.alias("body"))))


def q_validate_heartbeats(s, d):
    """Heartbeats with a depth lowered by one, so that empty buffers turn negative."""
    rows = table(s, d, "heartbeat", "station_id", "received_at", "body")
    rows = rows.withColumn("body", F.when(F.col("body").isNotNull(), F.col("body").withField("buffer_depth", F.col("body.buffer_depth") - 1)))
    return plain(ingress.heartbeat_problems(rows).select("station_id", "received_at", "problems"))


def q_heartbeat_report(s, d):
    """Buffer samples: the depth of each heartbeat, with the uptime as the counter that starts again."""
    ticks = _beats(s, d).groupBy("station_id", F.col("reported_at").alias("at")).agg(F.max("body.uptime_seconds").alias("seq"), F.max("body.buffer_depth").alias("depth"))
    return plain(ingress.buffer_report(ticks))


def q_heartbeat_upsert(s, d):
    """All heartbeats into an empty table; of the stations only those not revoked are known."""
    rows, known = _beats(s, d), table(s, d, "stations").where("revoked_at IS NULL")
    stored = ingress.store_heartbeats(rows.limit(0), rows, known)
    return plain(stored.select("station_id", "reported_at", "received_at"))


def q_clock_skew(s, d):
    skew = (micros(F.col("received_at")) - micros(F.col("reported_at"))) / 1_000_000
    return plain(_beats(s, d).select("station_id", "reported_at", "received_at", skew.alias("skew_s")))


def _tokens(s, d):
    """Tokens whose text is known: tok-<hash in the table>."""
    return table(s, d, "station_tokens").withColumn("text", F.concat(F.lit("tok-"), F.col("token_hash"))).withColumn("token_hash", F.sha2("text", 256))


def q_auth(s, d):
    """Each token presented rightly, with a prefix in small letters, and cut short."""
    t = _tokens(s, d)
    headers = F.array(F.concat(F.lit("Bearer "), F.col("text")), F.concat(F.lit("bearer "), F.col("text")), F.concat(F.lit("Bearer "), F.substr("text", F.lit(1), F.lit(9))))
    requests = t.select("text", F.posexplode(headers).alias("n", "header")).select(F.concat_ws("/", "text", "n").alias("request_id"), "header")
    return registry.authenticate(requests, t, table(s, d, "stations"))


def q_station_list(s, d):
    return plain(registry.list_stations(table(s, d, "stations"), table(s, d, "station_tokens")))


def q_token_list(s, d):
    return plain(registry.list_tokens(table(s, d, "station_tokens")))


def q_station_resolve(s, d):
    """The first one, two and eight characters of every station, and a prefix of none."""
    st = table(s, d, "stations")
    prefixes = st.select(F.explode(F.array(*[F.left("id", F.lit(n)) for n in (1, 2, 8)], F.lit("zz"))).alias("prefix"))
    return registry.resolve(prefixes, st)


def q_token_revoke(s, d):
    """The tokens of all revoked stations revoked, by prefix."""
    t, st = table(s, d, "station_tokens"), table(s, d, "stations").where("revoked_at IS NOT NULL")
    orders = t.join(F.broadcast(st.select(F.col("id").alias("station_id"))), "station_id", "left_semi").select("station_id", F.left("token_hash", F.lit(12)).alias("prefix"))
    return plain(registry.revoke_tokens(t, orders, F.timestamp_micros(F.lit(1_741_000_000_000_000))))


def _queue(s, d):
    return queue.append(_wire(s, d)).select(F.col("seq").alias("id"), "ts", "raw")


def q_buffer_next_batch(s, d):
    return plain(queue.next_batch(_queue(s, d), 500))


def q_buffer_after_ack(s, d):
    return plain(queue.after_ack(_queue(s, d), queue.next_batch(_queue(s, d), 500)))


def q_buffer_sample(s, d):
    return plain(queue.sample(_queue(s, d), queue.next_batch(_queue(s, d), 500)))


def q_map_view(s, d):
    sky = stage(current_sky(_folded(s, d)), "sky")
    now = sky.agg(F.max(micros(F.col("last_seen")))).first()[0]
    return livemap.markers(sky, F.timestamp_micros(F.lit(now).cast("long")))


def q_map_totals(s, d):
    return livemap.totals(current_sky(_folded(s, d)))


def q_live_traces(s, d):
    """Traces of the live pipeline, run over the whole wire log."""
    root, path = shared_dir(s, "live"), table_path(d, "wire")
    reader, file = s.readStream.schema(live.RAW), path.rpartition("/")
    if s.read.parquet(path).inputFiles()[0].endswith("/" + file[2]):  # a table of a single file
        raw = reader.option("pathGlobFilter", file[2]).parquet(file[0])
    else:
        raw = reader.parquet(path)
    live.start_decoder(s, raw, root, {"availableNow": True}).awaitTermination()
    live.start_folder(s, root, {"availableNow": True}, None).awaitTermination()
    rows = read(s, f"{root}/traces", live.STATE_LOG)
    names = {"position_us": "position_ts_us", "first_us": "first_seen_us", "last_us": "last_seen_us", "event_us": "event_ts_us"}
    return plain(rows.drop("kind").withColumnsRenamed(names))


QUERIES: dict[str, Query] = {n: q for n, q in list(globals().items()) if n.startswith("q_")}

# -- SQL twins

_REASONS = (
    "CASE WHEN station_id IS NULL OR station_id = '' THEN 'station_id' WHEN ts IS NULL THEN 'ts' WHEN f IS NULL OR len(f) <> 22 THEN 'fields'"
    + "".join(f" WHEN f[{n}] <> '' AND NOT (regexp_matches(f[{n}], '^[+-]?[0-9]+$') AND try_cast(f[{n}] AS INT) IS NOT NULL) THEN '{c}'" for c, n in (("transmission_type", 2), ("altitude", 12), ("vertical_rate", 17)))
    + "".join(
        rf" WHEN f[{n}] <> '' AND NOT regexp_matches(f[{n}], '^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$') THEN '{c}'"
        for c, n in (("ground_speed", 13), ("track", 14), ("lat", 15), ("lon", 16))
    )
    + "".join(f" WHEN f[{n}] NOT IN ('', '0', '-1') THEN '{c}'" for c, n in (("alert", 19), ("emergency", 20), ("spi", 21), ("on_ground", 22)))
    + " END AS reason"
)
_PARSED = (
    "f[1] AS message_type, try_cast(nullif(f[2], '') AS INT) AS transmission_type, nullif(f[5], '') AS icao,"
    "CASE WHEN f[7] <> '' OR f[8] <> '' THEN f[7] || ' ' || f[8] END AS \"generated\", CASE WHEN f[9] <> '' OR f[10] <> '' THEN f[9] || ' ' || f[10] END AS logged,"
    r"nullif(regexp_replace(f[11], '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '') AS callsign, try_cast(nullif(f[12], '') AS INT) AS altitude,"
    + "".join(f"try_cast(nullif(trim(f[{n}]), '') AS DOUBLE) AS {c}," for c, n in (("ground_speed", 13), ("track", 14), ("lat", 15), ("lon", 16)))
    + "try_cast(nullif(f[17], '') AS INT) AS vertical_rate, nullif(f[18], '') AS squawk,"
    + ", ".join(f"CASE f[{n}] WHEN '-1' THEN true WHEN '0' THEN false END AS {c}" for c, n in (("alert", 19), ("emergency", 20), ("spi", 21), ("on_ground", 22)))
)
_FIELDS = ", ".join(PAYLOAD)


def _decode_sql(wire: str, out: str) -> str:
    return f"{out}0 AS (SELECT *, {_REASONS} FROM (SELECT *, string_split(raw, ',') AS f FROM {wire})), {out} AS (SELECT seq, station_id, ts, received_at, {_PARSED} FROM {out}0 WHERE reason IS NULL)"


def _dedup_sql(src: str, out: str) -> str:
    return f"""{out}1 AS (SELECT *, coalesce("generated", 'null') || '|' || coalesce(logged, 'null') || '|' || coalesce(icao, 'null') AS fp,
        max(ts) OVER (PARTITION BY station_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {src}),
    {out}2 AS (SELECT *, lag(ts) OVER v AS pts, lag(fp) OVER v AS pfp FROM {out}1 WHERE top IS NULL OR ts >= top WINDOW v AS (PARTITION BY station_id ORDER BY seq)),
    {out} AS (SELECT * EXCLUDE (fp, top, pts, pfp) FROM {out}2 WHERE pts IS NULL OR pts <> ts OR pfp <> fp)"""


def _fold_sql(src: str, out: str) -> str:
    names = [*PAYLOAD, "position_ts"]
    best = ", ".join(f"arg_max({n}, {{'a': ms, 'b': seq}}) FILTER ({n} IS NOT NULL AND ms >= 0) OVER w AS s_{n}" for n in names)
    diff = " OR ".join(f"s_{n} IS DISTINCT FROM lag(s_{n}) OVER o" for n in names)
    cols = ", ".join(f"s_{n} AS {n}" for n in PAYLOAD)
    return f"""{out}1 AS (SELECT *, epoch_us(ts) // 1000 AS ms, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN ts END AS position_ts FROM {src} WHERE icao IS NOT NULL),
    {out}2 AS (SELECT seq, icao, station_id, ts, {best}, min(ts) OVER w AS first_seen, max(ts) OVER w AS last_seen, count(*) OVER w AS messages,
        list_sort(list_distinct(list(station_id) OVER w)) AS st FROM {out}1 WINDOW w AS (PARTITION BY icao ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    {out} AS (SELECT seq, icao, station_id AS event_station_id, epoch_us(ts) AS event_ts_us, {cols}, epoch_us(s_position_ts) AS position_ts_us, epoch_us(first_seen) AS first_seen_us,
        epoch_us(last_seen) AS last_seen_us, array_to_string(st, ',') AS stations, messages, {diff} AS changed FROM {out}2 WINDOW o AS (PARTITION BY icao ORDER BY seq))"""


_D = "WITH " + _decode_sql("wire", "dec")
_DD = _D + ", " + _dedup_sql("dec", "ded")
_F = _DD + ", " + _fold_sql("ded", "fol")
_TRACE = "(SELECT * EXCLUDE (changed) FROM fol WHERE changed)"
_KEYS = "event_station_id, event_ts_us, icao, last_seen_us"
_FIRST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY " + _KEYS + " ORDER BY seq) AS n FROM {}) WHERE n = 1"
_MERGE = "t AS (" + _FIRST.format(_TRACE) + "), u AS (" + _FIRST.format("(SELECT * EXCLUDE (changed) FROM {} WHERE changed)") + ")"
_A = """WITH a AS (SELECT CASE WHEN ts IS NOT NULL AND station_id <> '' THEN strftime(ts, '%Y-%m-%d') ELSE 'unknown' END AS dt,
    CASE WHEN ts IS NOT NULL AND station_id <> '' THEN station_id ELSE '' END AS station_id, CASE WHEN station_id <> '' THEN ts END AS ts, raw FROM wire)"""
_REPLAY = _A + ", rep AS (SELECT row_number() OVER (ORDER BY ts, station_id, raw) AS seq, * FROM (SELECT DISTINCT station_id, ts, raw FROM a WHERE dt <> 'unknown'))"
_H = "WITH h AS (SELECT station_id, body.reported_at AS reported_at, received_at, body FROM heartbeat WHERE body.reported_at IS NOT NULL)"
_Q = "WITH q AS (SELECT seq AS id, ts, raw FROM wire WHERE raw <> ''), k AS (SELECT id FROM q ORDER BY id LIMIT 500)"
_T = "WITH t AS (SELECT station_id, revoked_at, 'tok-' || token_hash AS text, sha256('tok-' || token_hash) AS token_hash FROM station_tokens)"
_US = "epoch_us(ts) AS ts_us"

SQL: dict[str, str] = {
    "q_decode": _D + ' SELECT * EXCLUDE (ts, received_at), epoch_us(ts) AS ts_us, epoch_us(received_at) AS received_at_us FROM dec',
    "q_decode_rejects": _D + " SELECT seq, station_id, raw, reason FROM dec0 WHERE reason IS NOT NULL",
    "q_decoded_wire": _D + f" SELECT coalesce(icao, station_id) AS key, seq, station_id, {_US}, message_type, transmission_type, {_FIELDS} FROM dec",
    "q_dedup": _DD + f" SELECT seq, station_id, {_US}, icao FROM ded",
    "q_fold": _F + " SELECT * FROM fol",
    "q_traces": _F + f" SELECT * FROM {_TRACE}",
    "q_live_traces": _F + f" SELECT * FROM {_TRACE}",
    "q_current_sky": _F + " SELECT * EXCLUDE (changed) FROM fol QUALIFY row_number() OVER (PARTITION BY icao ORDER BY seq DESC) = 1",
    "q_trace_upsert": _F + ", " + _fold_sql("dec", "all_") + ", " + _MERGE.format("all_") + f" SELECT * FROM t UNION ALL SELECT u.* FROM u ANTI JOIN t USING ({_KEYS})",
    "q_backfill_merge": _F
    + ", "
    + _REPLAY[5:]
    + ", rwire AS (SELECT seq, station_id, ts, NULL::TIMESTAMPTZ AS received_at, raw FROM rep), "
    + _decode_sql("rwire", "rdec")
    + ", "
    + _dedup_sql("rdec", "rded")
    + ", "
    + _fold_sql("rded", "rfol")
    + ", "
    + _MERGE.format("rfol")
    + f" SELECT * EXCLUDE (seq) FROM t UNION ALL SELECT * EXCLUDE (seq) FROM (SELECT u.* FROM u ANTI JOIN t USING ({_KEYS}))",
    "q_flight_path": _F
    + f", t AS {_TRACE}, b AS (SELECT icao FROM t GROUP BY icao ORDER BY count(*) DESC, icao LIMIT 1)"
    + " SELECT lat, lon, position_ts_us FROM t WHERE icao IN (SELECT icao FROM b) AND lat IS NOT NULL AND lon IS NOT NULL"
    + f" AND last_seen_us BETWEEN epoch_us(TIMESTAMPTZ '{SINCE}') AND epoch_us(TIMESTAMPTZ '{UNTIL}')",
    "q_archive_partition": _A + f" SELECT dt, station_id, {_US}, raw FROM a",
    "q_archive_days": _A + " SELECT DISTINCT dt FROM a WHERE dt <> 'unknown'",
    "q_archive_manifest": _A
    + " SELECT dt, strftime(min(ts), '%Y%m%dT%H%M%S.%fZ') AS first_stamp, strftime(max(ts), '%Y%m%dT%H%M%S.%fZ') AS last_stamp, count(*) AS rows FROM a GROUP BY dt",
    "q_archive_read": _REPLAY + f" SELECT seq, station_id, {_US}, raw FROM rep",
    "q_archive_counts": _A + " SELECT dt, station_id, count(*) AS events FROM (SELECT DISTINCT * FROM a) GROUP BY ALL",
    "q_archive_round_trip": _A + " SELECT dt, station_id, count(*) AS events FROM (SELECT DISTINCT * FROM a) GROUP BY ALL",
    "q_ingress_explode": f"SELECT station_id, id, {_US}, raw, epoch_us(date_trunc('hour', received_at)) AS received_at_us FROM wire WHERE received_at IS NOT NULL",
    "q_validate_events": "SELECT seq AS request_id, CASE WHEN len(string_split(raw, ',')) = 22 THEN '' ELSE 'events[0].raw' END AS problems FROM wire",
    "q_validate_heartbeats": """SELECT station_id, epoch_us(received_at) AS received_at_us, concat_ws(',', CASE WHEN body.reported_at IS NULL THEN 'reported_at' END,
        CASE WHEN body.uptime_seconds < 0 THEN 'uptime_seconds' END, CASE WHEN body.disk_free_bytes < 0 THEN 'disk_free_bytes' END,
        CASE WHEN body.buffer_depth - 1 < 0 THEN 'buffer_depth' END, CASE WHEN body.event_rate < 0 THEN 'event_rate' END) AS problems FROM heartbeat""",
    "q_heartbeat_report": _H
    + """, t AS (SELECT station_id, reported_at AS tick, max(body.uptime_seconds) AS seq, max(body.buffer_depth) AS depth FROM h GROUP BY ALL),
    p AS (SELECT *, lag(tick) OVER w AS pat, lag(seq) OVER w AS pseq, lag(depth) OVER w AS pdepth FROM t WINDOW w AS (PARTITION BY station_id ORDER BY tick)),
    r AS (SELECT *, pat IS NULL OR seq < pseq AS reset, seq - pseq AS arrived, pdepth + seq - pseq - depth AS gone FROM p),
    e AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY tick) AS epoch FROM r)
    SELECT station_id, epoch_us(tick) AS at_us, CASE WHEN NOT reset THEN arrived / ((epoch_us(tick) - epoch_us(pat)) / 1000000) END AS event_rate,
        epoch_us(max(CASE WHEN NOT reset AND arrived > 0 THEN tick END) OVER x) AS last_event_ts_us, epoch_us(max(CASE WHEN NOT reset AND gone > 0 THEN tick END) OVER x) AS last_publish_ts_us
    FROM e WINDOW x AS (PARTITION BY station_id, epoch ORDER BY tick)""",
    "q_heartbeat_upsert": _H
    + """ SELECT station_id, epoch_us(reported_at) AS reported_at_us, epoch_us(min(received_at)) AS received_at_us FROM h
    WHERE station_id IN (SELECT id FROM stations WHERE revoked_at IS NULL) GROUP BY station_id, reported_at""",
    "q_clock_skew": _H + " SELECT station_id, epoch_us(reported_at) AS reported_at_us, epoch_us(received_at) AS received_at_us, (epoch_us(received_at) - epoch_us(reported_at)) / 1000000 AS skew_s FROM h",
    "q_auth": _T
    + """, r AS (SELECT text || '/0' AS request_id, text AS token FROM t UNION ALL SELECT text || '/1', NULL FROM t UNION ALL SELECT text || '/2', substr(text, 1, 9) FROM t),
    ok AS (SELECT token_hash, station_id FROM t WHERE revoked_at IS NULL AND station_id IN (SELECT id FROM stations WHERE revoked_at IS NULL))
    SELECT request_id, station_id, CASE WHEN station_id IS NULL THEN 401 ELSE 200 END AS status FROM r LEFT JOIN ok ON sha256(r.token) = ok.token_hash""",
    "q_station_list": """SELECT id, epoch_us(s.created_at) AS created_at_us, epoch_us(s.revoked_at) AS revoked_at_us, count(token_hash) FILTER (t.revoked_at IS NULL) AS active_tokens
    FROM stations s LEFT JOIN station_tokens t ON t.station_id = s.id GROUP BY ALL""",
    "q_token_list": 'SELECT station_id, token_hash[:12] AS "prefix", epoch_us(created_at) AS created_at_us, epoch_us(revoked_at) AS revoked_at_us FROM station_tokens',
    "q_station_resolve": """WITH p AS (SELECT DISTINCT unnest([id[:1], id[:2], id[:8], 'zz']) AS pre FROM stations)
    SELECT pre AS "prefix", count(id) AS matches, CASE WHEN count(id) = 1 THEN min(id) END AS id FROM p LEFT JOIN stations ON starts_with(id, pre) GROUP BY pre""",
    "q_token_revoke": """SELECT token_hash, station_id, epoch_us(created_at) AS created_at_us, CASE WHEN hit THEN 1741000000000000 ELSE epoch_us(revoked_at) END AS revoked_at_us, hit AS revoked_now
    FROM (SELECT *, revoked_at IS NULL AND station_id IN (SELECT id FROM stations WHERE revoked_at IS NOT NULL) AS hit FROM station_tokens)""",
    "q_buffer_next_batch": _Q + f" SELECT id, {_US}, raw FROM q WHERE id IN (SELECT id FROM k)",
    "q_buffer_after_ack": _Q + f" SELECT id, {_US}, raw FROM q WHERE id NOT IN (SELECT id FROM k)",
    "q_buffer_sample": _Q + " SELECT count(*) AS depth, epoch_us(arg_min(ts, id)) AS oldest_ts_us, (SELECT max(id) FROM q) AS seq FROM q WHERE id NOT IN (SELECT id FROM k)",
    "q_map_view": _F
    + """, sky AS (SELECT * FROM fol QUALIFY row_number() OVER (PARTITION BY icao ORDER BY seq DESC) = 1)
    SELECT icao, lat, lon, coalesce(nullif(callsign, ''), icao) AS label, coalesce(CAST(altitude AS VARCHAR), '?') AS altitude, coalesce(track, 0) - 45 AS heading,
        CAST(len(string_split(stations, ',')) AS INT) AS n_stations, coalesce((SELECT max(last_seen_us) FROM sky) - position_ts_us > 60000000, false) AS stale
    FROM sky WHERE lat IS NOT NULL AND lon IS NOT NULL""",
    "q_map_totals": _F
    + """, sky AS (SELECT * FROM fol QUALIFY row_number() OVER (PARTITION BY icao ORDER BY seq DESC) = 1)
    SELECT count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS visible, count(*) AS tracked FROM sky""",
}
