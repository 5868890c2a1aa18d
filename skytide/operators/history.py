"""Traces kept as an append-only history with a natural key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytide.schemas import TRACE

KEY = ["event_station_id", "event_ts", "icao", "last_seen"]
REQUIRED = ["event_station_id", "event_ts", "icao", "first_seen", "last_seen"]


def insert_new(existing: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows of incoming to append: of each key the first by order, if existing doesn't have it. Keys have no nulls."""
    others = [c for c in incoming.columns if c not in key]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("x")).select(*key, "x.*").select(*incoming.columns)
    return first.join(existing.select(*key), key, "left_anti").select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str] = KEY, order: str = "seq") -> DataFrame:
    """existing with the new rows of incoming; conflicts do nothing."""
    return existing.unionByName(insert_new(existing, incoming, key, order))


def decode_traces(log: DataFrame, value: str = "value") -> DataFrame:
    """Traces of a log of JSON records. A record without one of the required members ends the query with an error, so that a
    broken producer is noticed before anything is written."""
    t = log.select(F.from_json(F.col(value), TRACE).alias("t")).select("t.*")
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    return t.withColumn("icao", F.when(missing, F.raise_error(F.lit("a trace lacks a required member")).cast("string")).otherwise(F.col("icao")))


def write_traces(rows: DataFrame, path: str) -> None:
    """Append to the history table: by day of last_seen, sorted by aircraft and time, so that reads of one aircraft's range
    prune folders and skip row groups."""
    rows = rows.withColumn("day", F.to_date("last_seen"))
    rows.repartition("day", F.pmod(F.xxhash64("icao"), F.lit(16))).sortWithinPartitions("day", "icao", "last_seen").write.mode("append").option("compression", "zstd").partitionBy("day").parquet(path)


def flight_path(traces: DataFrame, icao, start, end) -> DataFrame:
    """Positions of an aircraft in a range of last_seen (columns or times), in order."""
    start, end = F.lit(start), F.lit(end)
    inside = (F.col("icao") == icao) & F.col("last_seen").between(start, end)
    if "day" in traces.columns:
        inside = inside & F.col("day").between(F.to_date(start), F.to_date(end))
    return traces.where(inside).select("lat", "lon", "position_ts").orderBy("position_ts")
