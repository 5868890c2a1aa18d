"""Replayed batches dropped by a high-water mark per station."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytide.functions.chunked import carry_in

CHUNK = 200_000


def fingerprint():
    """What tells two messages of one instant apart: generated, logged and icao, absent ones written as null."""
    part = lambda c: F.coalesce(F.col(c), F.lit("null"))
    return F.concat(part("generated"), F.lit("|"), part("logged"), F.lit("|"), part("icao"))


def drop_replays(decoded: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The messages that pass their station's mark, in order of ``seq`` (unique).

    The mark is the time and fingerprint of the newest message that passed. A message older than the mark, or of its time
    and fingerprint, is dropped; any other passes and becomes the mark. Two different messages of one instant so both
    pass, and payload isn't compared. Messages need a station and a time (decode sees to that).

    The mark is so the one of the greatest time among the messages before, and of those the last: a running maximum of
    (time, seq, fingerprint) per station, kept over chunks of ``seq``.
    """
    mark = F.struct("ts", "seq", "fp")
    rows = decoded.withColumn("chunk", F.floor(F.col("seq") / chunk)).withColumn("fp", fingerprint())
    rows = carry_in(rows, ["station_id"], {"mark": F.max(mark)}, {"mark": "max"})
    w = Window.partitionBy("station_id", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest("c_mark", F.max(mark).over(w))
    passes = F.col("before").isNull() | (F.col("ts") > F.col("before.ts")) | ((F.col("ts") == F.col("before.ts")) & (F.col("fp") != F.col("before.fp")))
    return rows.withColumn("before", before).where(passes).select(*decoded.columns)
