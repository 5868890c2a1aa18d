"""The live map's view of the current sky."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_lines(lines: DataFrame) -> DataFrame:
    """``icao, value`` of a compacted log of ``seq, line`` (key, tab, JSON): the last line of each key counts, ``null`` removes
    it, and text that isn't JSON leaves what was before. Lines without a key are ignored."""
    parts = F.split("line", "\t", 2)
    key, value = parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    rows = lines.select("seq", key.alias("icao"), value.alias("value")).where((F.col("icao") != "") & F.try_parse_json("value").isNotNull())
    last = rows.groupBy("icao").agg(F.max_by("value", "seq").alias("value"))
    return last.where("value <> 'null'")


def markers(sky: DataFrame, now, stale_s: int = 60) -> DataFrame:
    """What the map draws for each aircraft with a position: label, popup numbers, heading, stations and whether it is stale."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    age = F.unix_micros(now) - F.unix_micros("position_ts")
    return sky.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        "icao", "lat", "lon",
        F.coalesce(F.when(F.col("callsign") != "", F.col("callsign")), F.col("icao")).alias("label"),
        shown("altitude").alias("altitude"),
        (F.coalesce("track", F.lit(0.0)) - 45).alias("heading"),
        F.size("stations").alias("n_stations"),
        F.coalesce(age > stale_s * 1_000_000, F.lit(False)).alias("stale"),
    )


def totals(sky: DataFrame) -> DataFrame:
    """``visible`` (with a position) and ``tracked`` aircraft."""
    return sky.agg(F.count(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), 1)).alias("visible"), F.count("*").alias("tracked"))
