"""Spells of activity: each device's events split where it was silent for longer than a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytide.functions.columns import MICROS, bucket


def sessions(df: DataFrame, device: Column, event_us: Column, gap_s: float = 600.0, chunk_s: int = 86_400) -> DataFrame:
    """Sessions of each device: ``device, start_us, end_us, duration_us, events``.

    Two neighbouring events belong to one session if they are at most ``gap_s`` apart. Rows with a null device or time
    belong to none; repeated rows and ties count as events of the same session; an empty table gives no rows. The input
    may hold columns of any name, as only the two expressions are read.

    Time is divided twice. Events within one cell of width ``gap_s`` are always of one session, so cells are
    pre-aggregated before the shuffle (a hot device costs a row a cell, not a row an event). Cells of a chunk of
    ``chunk_s`` form partial sessions in a window bounded by the chunk; partial sessions, few by then, are merged over
    chunk borders where the gap between them is short enough.
    """
    gap = round(gap_s * MICROS)
    cell = max(gap, 1)
    chunk = max(round(chunk_s * MICROS) // cell, 1) * cell
    cells = (
        df.select(device.alias("device"), event_us.alias("us"))
        .where(F.col("device").isNotNull() & F.col("us").isNotNull())
        .groupBy("device", bucket(F.col("us"), chunk).alias("chunk"), bucket(F.col("us"), cell).alias("cell"))
        .agg(F.min("us").alias("a"), F.max("us").alias("z"), F.count("*").alias("n"))
    )
    local = _merge(cells.repartition("device", "chunk"), ["device", "chunk"], gap)
    return _merge(local, ["device"], gap).select(
        "device", F.col("a").alias("start_us"), F.col("z").alias("end_us"), (F.col("z") - F.col("a")).alias("duration_us"), F.col("n").alias("events")
    )


def _merge(parts: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Join runs of parts (disjoint and ordered by time within keys) that are at most gap apart."""
    w = Window.partitionBy(*keys).orderBy("a")
    opens = F.when(F.col("a") - F.lag("z").over(w) <= gap, 0).otherwise(1)
    return (
        parts.withColumn("opens", opens)
        .withColumn("part", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "part")
        .agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("n"))
        .drop("part")
    )
