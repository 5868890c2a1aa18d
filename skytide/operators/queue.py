"""A station's buffer as a table: appended rows with growing ids, of which some have been acknowledged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame) -> DataFrame:
    """The rows that the buffer takes: those with a line that isn't blank."""
    return rows.where("raw <> ''")


def next_batch(queue: DataFrame, limit: int, ack: DataFrame | None = None) -> DataFrame:
    """The first rows by id that aren't acknowledged. Each task keeps its own first ones, so nothing is sorted as a whole."""
    left = queue if ack is None else after_ack(queue, ack)
    return left.orderBy("id").limit(limit)


def after_ack(queue: DataFrame, ack: DataFrame) -> DataFrame:
    """What is left once the rows with the ids of ack are gone."""
    return queue.join(ack.select("id"), "id", "left_anti")


def sample(log: DataFrame, ack: DataFrame) -> DataFrame:
    """One row ``depth, oldest_ts, seq``: rows left, the time of the first of them, and the highest id ever given, which
    acknowledging doesn't lower. An empty queue has depth 0, no time and seq 0."""
    marked = log.join(ack.select("id", F.lit(True).alias("gone")), "id", "left")
    left = F.col("gone").isNull()
    return marked.agg(F.count(F.when(left, 1)).alias("depth"), F.min_by("ts", F.when(left, F.col("id"))).alias("oldest_ts"), F.coalesce(F.max("id"), F.lit(0)).alias("seq"))
