"""Queries p1 to p7: the receiver network's data made fit for use. SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytide.functions.columns import MICROS, aircraft, bucket, micros
from skytide.operators.redelivery import count_corrections, hourly_counts, repeated_deliveries
from skytide.operators.regrid import regrid
from skytide.operators.sessions import sessions
from skytide.operators.spikes import implausible
from skytide.operators.trips import stops_and_trips
from skytide.operators.zones import points_in_zones
from skytide.sources.tables import table, table_path

Query = Callable[[SparkSession, str], DataFrame]


def _spells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decode", "icao", "event_ts")
    return sessions(rows, aircraft(F.col("icao")), micros(F.col("event_ts")), gap_s=600)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _spells(spark, d).select(F.col("device").alias("icao"), "start_us", "end_us")


def p1_spells(spark: SparkSession, d: str) -> DataFrame:
    return _spells(spark, d).select(F.col("device").alias("icao"), "start_us", "end_us", "duration_us", "events")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_deliveries(spark, table_path(d, "wire"))


def p3_readings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decode", "seq", "icao", "event_ts", "altitude", "ground_speed", "lat", "lon", "vertical_rate")
    return implausible(rows, F.col("seq"), aircraft(F.col("icao")), micros(F.col("event_ts")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_readings(spark, d).select("seq", "field")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "heartbeat", "station_id", "body")
    readings = {"buffer_depth": F.col("body.buffer_depth"), "event_rate": F.col("body.event_rate")}
    return regrid(rows, F.col("station_id"), micros(F.col("body.reported_at")), readings).withColumnRenamed("source", "station_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_grid(spark, d).where("reports = 0").select("station_id", "slot_us")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return hourly_counts(spark, table_path(d, "wire"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_counts(spark, d).where("corrected").select("station_id", "period_us")


def p5_corrections(spark: SparkSession, d: str) -> DataFrame:
    return count_corrections(spark, table_path(d, "wire"))


def p6_trips(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decode", "icao", "event_ts", "lat", "lon")
    return stops_and_trips(rows, aircraft(F.col("icao")), micros(F.col("event_ts")), F.col("lat"), F.col("lon")).withColumnRenamed("device", "icao")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    half_hour = lambda c: bucket(F.col(c), 1800 * MICROS)
    return p6_trips(spark, d).where("kind = 'stop'").select("icao", half_hour("start_us").alias("start_slot"), half_hour("end_us").alias("end_slot"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows, fields = table(spark, d, "decode", "seq", "lat", "lon"), table(spark, d, "airfields", "airfield_id", "lat", "lon", "radius_m")
    return points_in_zones(rows, F.col("seq"), F.col("lat"), F.col("lon"), fields, "airfield_id").withColumnRenamed("key", "seq")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_spells": p1_spells,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_readings": p3_readings,
    "p4_found": p4_found,
    "p4_grid": p4_grid,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p5_corrections": p5_corrections,
    "p6_found": p6_found,
    "p6_trips": p6_trips,
    "p7_found": p7_found,
}

_SPELLS = """
WITH e AS (SELECT upper(trim(icao)) AS icao, epoch_us(event_ts) AS us FROM decode WHERE trim(icao) <> '' AND event_ts IS NOT NULL),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY icao ORDER BY us) <= 600000000 THEN 0 ELSE 1 END AS opens FROM e),
g AS (SELECT *, sum(opens) OVER (PARTITION BY icao ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM f),
s AS (SELECT icao, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS events FROM g GROUP BY icao, n)
"""
_KEPT = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY station_id, id, ts ORDER BY received_at NULLS LAST, seq) AS n FROM wire),
kept AS (SELECT station_id, epoch_us(ts) - epoch_us(ts) % 3600000000 AS period_us, epoch_us(received_at) AS recv FROM o
         WHERE (id = 0 OR id IS NULL OR n = 1) AND ts IS NOT NULL AND received_at IS NOT NULL),
c AS (SELECT station_id, period_us, count(*) FILTER (recv <= period_us + 3900000000) AS on_time,
             count(*) FILTER (recv > period_us + 3900000000 AND recv <= period_us + 25200000000) AS late,
             count(*) FILTER (recv > period_us + 25200000000) AS beyond FROM kept GROUP BY ALL)
"""
_CORRECTIONS = """
WITH s AS (SELECT min(seq) AS low, (max(seq) - min(seq) + 10) // 10 AS step FROM wire),
r AS (SELECT station_id, id, ts, epoch_us(received_at) AS recv, seq, (seq - low) // step AS b FROM wire, s),
k AS (SELECT station_id, id, ts, b, min({'unknown': recv IS NULL, 'recv': coalesce(recv, 0), 'seq': seq}) AS m FROM r WHERE id <> 0 GROUP BY ALL),
q AS (SELECT *, min(m) OVER (PARTITION BY station_id, id, ts ORDER BY b) AS now,
             min(m) OVER (PARTITION BY station_id, id, ts ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM k),
moves AS (SELECT station_id, ts, b, CASE WHEN NOT now.unknown THEN now.recv END AS recv, 1 AS d FROM q WHERE old IS NULL OR now.seq <> old.seq
          UNION ALL SELECT station_id, ts, b, CASE WHEN NOT old.unknown THEN old.recv END, -1 FROM q WHERE now.seq <> old.seq
          UNION ALL SELECT station_id, ts, b, recv, 1 FROM r WHERE id = 0 OR id IS NULL),
h AS (SELECT station_id, b, epoch_us(ts) - epoch_us(ts) % 3600000000 AS period_us, recv, d FROM moves WHERE ts IS NOT NULL AND recv IS NOT NULL),
c AS (SELECT station_id, period_us, b, sum(CASE WHEN recv <= period_us + 25200000000 THEN d ELSE 0 END) AS n FROM h GROUP BY ALL),
v AS (SELECT *, sum(n) OVER (PARTITION BY station_id, period_us ORDER BY b) AS now FROM c),
o AS (SELECT CAST(b AS INT) AS batch, station_id, period_us, unnest([n - now, now]) AS delta FROM v WHERE n <> 0)
"""
_GRID = """
WITH r AS (SELECT station_id, epoch_us(body.reported_at) AS us, body.buffer_depth AS depth, body.event_rate AS rate FROM heartbeat
           WHERE body.reported_at IS NOT NULL),
b AS (SELECT station_id, us - us % 300000000 AS slot_us, us - us % 86400000000 AS day, count(*) AS reports,
             max({'us': us, 'v': depth}) FILTER (depth IS NOT NULL) AS depth, max({'us': us, 'v': rate}) FILTER (rate IS NOT NULL) AS rate
      FROM r GROUP BY ALL),
g AS (SELECT station_id, day, unnest(generate_series(min(slot_us), max(slot_us), 300000000)) AS slot_us FROM b GROUP BY station_id, day),
j AS (SELECT g.station_id, g.slot_us, coalesce(b.reports, 0) AS reports, b.depth, b.rate,
             last_value(b.depth IGNORE NULLS) OVER w AS ld, last_value(b.rate IGNORE NULLS) OVER w AS lr
      FROM g LEFT JOIN b USING (station_id, day, slot_us) WINDOW w AS (PARTITION BY g.station_id, g.day ORDER BY g.slot_us ROWS UNBOUNDED PRECEDING)),
k AS (SELECT station_id, slot_us, reports, CASE WHEN depth IS NOT NULL OR slot_us - ld.us <= 900000000 THEN ld.v END AS buffer_depth,
             CASE WHEN rate IS NOT NULL OR slot_us - lr.us <= 900000000 THEN lr.v END AS event_rate FROM j)
"""

SQL: dict[str, str] = {
    "p1_found": _SPELLS + "SELECT icao, start_us, end_us FROM s",
    "p1_spells": _SPELLS + "SELECT icao, start_us, end_us, duration_us, events FROM s",
    "p2_found": """SELECT seq FROM (SELECT seq, id, row_number() OVER (PARTITION BY station_id, id, ts ORDER BY received_at NULLS LAST, seq) AS n FROM wire)
                   WHERE n > 1 AND id <> 0""",
    "p4_found": _GRID + "SELECT station_id, slot_us FROM k WHERE reports = 0",
    "p4_grid": _GRID
    + """SELECT station_id, slot_us, reports, buffer_depth, event_rate,
         CASE WHEN reports > 0 THEN 'observed' WHEN buffer_depth IS NOT NULL OR event_rate IS NOT NULL THEN 'filled' ELSE 'missing' END AS state FROM k""",
    "p5_found": _KEPT + "SELECT station_id, period_us FROM c WHERE late > 0",
    "p5_counts": _KEPT + "SELECT *, on_time + late AS messages, late > 0 AS corrected FROM c",
    "p5_corrections": _CORRECTIONS + "SELECT batch, station_id, period_us, CAST(delta AS BIGINT) AS delta FROM o WHERE delta <> 0",
    "p7_found": """SELECT seq, airfield_id FROM decode d JOIN airfields a
                   ON 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(a.lat - d.lat) / 2), 2)
                      + cos(radians(d.lat)) * cos(radians(a.lat)) * pow(sin(radians(a.lon - d.lon) / 2), 2)))) <= a.radius_m
                   WHERE abs(d.lat) <= 90 AND abs(d.lon) <= 180""",
}
