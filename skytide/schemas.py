"""Explicit schemas of everything that comes in as text, and the fields of a message's payload."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
_TYPES |= {"strings": T.ArrayType(T.StringType()), "bigints": T.ArrayType(T.LongType())}


def struct(**fields: str | T.DataType) -> T.StructType:
    """A schema from names and types. (Parsing DDL needs a session, which modules don't have when they are imported.)"""
    return T.StructType([T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()])


#: The nullable attributes that messages carry and snapshots accumulate.
PAYLOAD = {
    "callsign": "string", "altitude": "int", "ground_speed": "double", "track": "double", "lat": "double", "lon": "double",
    "vertical_rate": "int", "squawk": "string", "alert": "boolean", "emergency": "boolean", "spi": "boolean", "on_ground": "boolean",
}
EVENT = struct(station_id="string", id="bigint", ts="timestamp", raw="string", received_at="timestamp")
EVENTS_BODY = struct(events=T.ArrayType(struct(id="bigint", ts="timestamp", raw="string")))
HEARTBEAT_BODY = struct(
    reported_at="timestamp", uptime_seconds="bigint", disk_free_bytes="bigint", buffer_depth="bigint", oldest_buffered_ts="timestamp",
    last_publish_ts="timestamp", last_event_ts="timestamp", event_rate="double",
)
TRACE = struct(
    icao="string", first_seen="timestamp", last_seen="timestamp", position_ts="timestamp", stations="strings", messages="bigint", **PAYLOAD,
    event_station_id="string", event_ts="timestamp",
)
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
