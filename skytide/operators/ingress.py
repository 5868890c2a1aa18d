"""Requests with batches of events or a heartbeat: parsing, validation, storing, and the report that a station makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytide.functions.chunked import carry_in
from skytide.functions.columns import MICROS, bucket
from skytide.operators.history import insert_new
from skytide.operators.registry import small
from skytide.schemas import EVENTS_BODY, HEARTBEAT_BODY


def explode_events(requests: DataFrame) -> DataFrame:
    """The events of requests (``request_id, station_id, received_at, body`` as JSON), stamped with station and time."""
    e = F.explode(F.from_json("body", EVENTS_BODY)["events"]).alias("e")
    return requests.select("station_id", "received_at", e).select("station_id", "e.id", "e.ts", "e.raw", "received_at")


def event_problems(requests: DataFrame) -> DataFrame:
    """``request_id, problems``: what is wrong with each request, by member; none if it is fine."""
    events = F.from_json("body", EVENTS_BODY)["events"]
    bad = F.filter(F.transform(events, lambda e, i: F.when(F.coalesce(e["raw"], F.lit("")) == "", F.concat(F.lit("events["), i.cast("string"), F.lit("].raw")))), lambda x: x.isNotNull())
    return requests.select("request_id", F.when(F.coalesce(F.size(events), F.lit(0)) <= 0, F.array(F.lit("events"))).otherwise(bad).alias("problems"))


def parse_heartbeats(requests: DataFrame) -> DataFrame:
    """requests with ``body`` (JSON) read as a report; text that isn't one gives a body without members, which
    heartbeat_problems reports."""
    return requests.withColumn("body", F.from_json("body", HEARTBEAT_BODY))


def heartbeat_problems(heartbeats: DataFrame) -> DataFrame:
    """heartbeats with ``problems``: the members of ``body`` that are missing or negative."""
    b = F.col("body")
    negative = [F.when(F.coalesce(b[m], F.lit(0)) < 0, m) for m in ("uptime_seconds", "disk_free_bytes", "buffer_depth", "event_rate")]
    return heartbeats.withColumn("problems", F.array_compact(F.array(F.when(b["reported_at"].isNull(), "reported_at"), *negative)))


def store_heartbeats(existing: DataFrame, incoming: DataFrame, stations: DataFrame) -> DataFrame:
    """Heartbeats to append: the first received per station and reported_at that the table lacks, of known stations. Of equal
    receive times, the least body."""
    known = incoming.where("reported_at IS NOT NULL").join(small(stations.select(F.col("id").alias("station_id"))), "station_id", "left_semi")
    return insert_new(existing, known.withColumn("o", F.struct("received_at", "body")), ["station_id", "reported_at"], "o").drop("o")


def buffer_report(ticks: DataFrame, chunk_s: int = 86_400) -> DataFrame:
    """What a station reports from samples of its buffer (``station_id, at, seq, depth``; at unique per station):
    ``event_rate, last_event_ts, last_publish_ts``.

    arrived = seq - the tick before's; left = depth before + arrived - depth now. A tick with arrivals (removals) is the
    last event (publication) until the next. The first tick, and one whose seq went back (a new buffer), say nothing and
    forget what was before. Running state is kept over chunks of time.
    """
    rows = ticks.withColumn("chunk", bucket(F.unix_micros("at"), chunk_s * MICROS))
    tick = F.struct("at", "seq", "depth")
    rows = carry_in(rows, ["station_id"], {"prev": F.max(tick)}, {"prev": "last"})
    w = Window.partitionBy("station_id", "chunk").orderBy("at")
    rows = rows.withColumn("p", F.coalesce(F.lag(tick).over(w), F.col("c_prev"))).drop("c_prev")
    reset = F.col("p").isNull() | (F.col("seq") < F.col("p.seq"))
    arrived = F.col("seq") - F.col("p.seq")
    left = F.col("p.depth") + arrived - F.col("depth")
    rows = rows.withColumns({"reset": F.when(reset, F.col("at")), "event": F.when(~reset & (arrived > 0), F.col("at")), "publish": F.when(~reset & (left > 0), F.col("at"))})
    names = ["reset", "event", "publish"]
    rows = carry_in(rows, ["station_id"], {n: F.max(n) for n in names}, dict.fromkeys(names, "max"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.greatest(f"c_{n}", F.max(n).over(run)) for n in names}
    rows = rows.withColumns({f"l_{n}": c for n, c in last.items()})
    held = lambda n: F.when(F.col(f"l_{n}") > F.col("l_reset"), F.col(f"l_{n}"))
    seconds = (F.unix_micros("at") - F.unix_micros("p.at")) / MICROS
    return rows.select(
        "station_id", "at", F.when(F.col("reset").isNull(), arrived / seconds).alias("event_rate"), held("event").alias("last_event_ts"), held("publish").alias("last_publish_ts")
    )
