"""Messages of many stations folded into one picture per aircraft, by field-level last-writer-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytide.functions.chunked import carry_in
from skytide.schemas import PAYLOAD

CHUNK = 200_000
FIELDS = [*PAYLOAD, "position_ts"]


def fold(messages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per message with an icao: the aircraft's picture after it.

    ``seq, icao, event_station_id, event_ts``, the payload, ``position_ts, first_seen, last_seen, stations, messages,
    changed``. A field takes a value unless a newer one (by event time in milliseconds; within one millisecond the later
    ``seq`` wins) has set it; times before 1970 set nothing but count. ``position_ts`` is a field set by messages with lat
    and lon. ``changed``: any field differs from the row before (all absent before the first).

    The state of a field is the largest (millisecond, seq, value) so far, so state over chunks of ``seq`` is a maximum of
    maxima: a long series is spread over tasks.
    """
    ms = F.unix_millis("ts")
    rows = messages.where("icao IS NOT NULL").withColumn("chunk", F.floor(F.col("seq") / chunk)).withColumn("ms", ms)
    rows = rows.withColumn("position_ts", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("ts")))
    state = lambda f: F.max(F.when(F.col(f).isNotNull() & (F.col("ms") >= 0), F.struct("ms", "seq", F.col(f).alias("v"))))
    totals = {f: state(f) for f in FIELDS} | {"n": F.count("*"), "first": F.min("ts"), "last": F.max("ts"), "st": F.collect_set("station_id")}
    over = dict.fromkeys(FIELDS, "max") | {"n": "sum", "first": "min", "last": "max", "st": "set"}
    rows = carry_in(rows, ["icao"], totals, over)
    ordered = Window.partitionBy("icao", "chunk").orderBy("seq")
    w = ordered.rowsBetween(Window.unboundedPreceding, 0)
    now = {f"s_{f}": F.greatest(F.col(f"c_{f}"), state(f).over(w))["v"] for f in FIELDS}
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        now
        | {
            "messages": F.coalesce("c_n", F.lit(0)) + F.count("*").over(w),
            "first_seen": F.least("c_first", F.min("ts").over(w)),
            "last_seen": F.greatest("c_last", F.max("ts").over(w)),
            "stations": F.array_sort(F.array_union(F.coalesce("c_st", none), F.collect_set("station_id").over(w))),
            "opening": F.row_number().over(ordered) == 1,
        }
    )
    before = lambda f: F.when(F.col("opening"), F.col(f"c_{f}.v")).otherwise(F.lag(f"s_{f}").over(ordered))
    changed = F.lit(False)
    for f in FIELDS:
        changed = changed | ~F.col(f"s_{f}").eqNullSafe(before(f))
    return rows.withColumn("changed", changed).select(
        "seq", "icao", F.col("station_id").alias("event_station_id"), F.col("ts").alias("event_ts"), *[F.col(f"s_{f}").alias(f) for f in FIELDS],
        "first_seen", "last_seen", "stations", "messages", "changed",
    )


def traces(folded: DataFrame) -> DataFrame:
    """The pictures that differ from the one before, stamped with what changed them."""
    return folded.where("changed").drop("changed")


def current_sky(folded: DataFrame) -> DataFrame:
    """The last picture of each aircraft. Aggregated map-side: a row per aircraft and task is shuffled."""
    cols = [c for c in folded.columns if c not in ("icao", "changed")]
    return folded.groupBy("icao").agg(F.max_by(F.struct(*cols), "seq").alias("x")).select("icao", "x.*")


def view(state_log: DataFrame) -> DataFrame:
    """Live pictures of a state log (``seq, icao, op, ...``; op ``tombstone`` removes): the last row per aircraft, unless it
    removes. Rows with a null or empty key are ignored."""
    cols = [c for c in state_log.columns if c != "icao"]
    last = state_log.where("icao <> ''").groupBy("icao").agg(F.max_by(F.struct(*cols), "seq").alias("x")).select("icao", "x.*")
    return last.where("op <> 'tombstone'")
