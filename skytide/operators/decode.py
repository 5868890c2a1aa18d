"""Raw lines to typed messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytide.functions.sbs import good_line, parsed, reject_reason, split_line
from skytide.schemas import EVENT, PAYLOAD, RFC3339


def _envelope(wire: DataFrame) -> Column:
    """What is wrong with a row before its line is read; null if nothing."""
    return F.when(F.col("station_id").isNull() | (F.col("station_id") == ""), "station_id").when(F.col("ts").isNull(), "ts")


def _good(wire: DataFrame) -> Column:
    return _envelope(wire).isNull() & good_line(F.col("raw"))


def decode(wire: DataFrame) -> DataFrame:
    """The messages of a log (``seq, station_id, ts, received_at, raw``), typed. A line with one bad field, another number of
    fields than 22, or an envelope without station or time gives no row; see rejects. Row by row, so copies stay copies.

    The filter reads the line, not its fields, so fields are split once and only for good lines.
    """
    good = wire.where(_good(wire)).withColumn("f", split_line(F.col("raw")))
    return good.select("seq", "station_id", "ts", "received_at", *[c.alias(n) for n, c in parsed(F.col("f")).items()])


def rejects(wire: DataFrame) -> DataFrame:
    """The lines that decode leaves out: ``seq, station_id, raw, reason``."""
    bad = wire.where(~_good(wire)).withColumn("f", split_line(F.col("raw")))
    return bad.select("seq", "station_id", "raw", F.coalesce(_envelope(wire), reject_reason(F.col("f"))).alias("reason"))


def from_json_log(log: DataFrame, value: str = "value") -> DataFrame:
    """Wire rows of a log of JSON records. Unknown members are ignored; text that isn't JSON gives nulls, which decode
    rejects."""
    e = F.from_json(F.col(value), EVENT)
    return log.select(*[c for c in log.columns if c != value], e.alias("e")).select("*", "e.*").drop("e")


def message_key():
    """What a decoded message is keyed by: its aircraft, else its station."""
    return F.coalesce(F.col("icao"), F.col("station_id"))


def to_json_log(decoded: DataFrame) -> DataFrame:
    """``key, value`` of decoded messages: JSON without absent members, times in UTC with microseconds."""
    members = ["station_id", "ts", "received_at", "message_type", "transmission_type", "icao", "generated", "logged", *PAYLOAD]
    return decoded.select(message_key().alias("key"), F.to_json(F.struct(*members), {"timestampFormat": RFC3339}).alias("value"))
