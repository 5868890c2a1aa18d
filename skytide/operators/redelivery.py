"""Messages delivered more than once, and counts by event time that late deliveries correct."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytide.streaming.ledger import BATCHES, ledger


def repeated_deliveries(spark: SparkSession, path: str, batches: int = BATCHES, watermark_s: int = 86_400) -> DataFrame:
    """``seq`` of each delivery in the wire log at path to be dropped, so that one of each message stays.

    Deliveries with equal ``station_id``, ``id`` and ``ts`` (null equal to null) are one message, of which the earliest
    received (null last), then lowest ``seq``, stays. ``id`` 0 or null: a message of its own. Ties, repeated rows (of
    distinct ``seq``), an empty log and further columns are fine; ``seq`` is the log's unique position, without nulls.

    The log passes the ledger in micro-batches; the answer is the same for any number of them and any watermark.
    """
    return ledger(spark, path, batches, drops=True, watermark_s=watermark_s).close().dropped()


def _counts(spark: SparkSession, path: str, batches: int, grace_s: int, cutoff_s: int):
    return ledger(spark, path, batches, drops=False, counts=True, grace_s=grace_s, cutoff_s=cutoff_s).close()


def hourly_counts(spark: SparkSession, path: str, batches: int = BATCHES, grace_s: int = 300, cutoff_s: int = 21_600) -> DataFrame:
    """Messages per station and UTC hour of ``ts``: ``station_id, period_us, on_time, late, beyond, messages, corrected``.

    Only the kept delivery of each message counts, in the hour of its ``ts``; without ``ts`` or ``received_at`` it
    counts nowhere. ``late``: received more than grace_s and at most cutoff_s after the hour's end; ``beyond``: later,
    not part of ``messages``. ``corrected``: the hour has late ones. An empty log gives no rows.

    The counts are the last version that the ledger's signed deltas lead to.
    """
    counts = _counts(spark, path, batches, grace_s, cutoff_s).counted()
    return counts.where("on_time > 0 OR late > 0 OR beyond > 0").select(
        "station_id", "period_us", "on_time", "late", "beyond", (F.col("on_time") + F.col("late")).alias("messages"), (F.col("late") > 0).alias("corrected")
    )


def count_corrections(spark: SparkSession, path: str, batches: int = BATCHES, grace_s: int = 300, cutoff_s: int = 21_600) -> DataFrame:
    """The retractions and additions that a reader of the hourly counts gets batch by batch: ``batch, station_id, period_us,
    delta``; their sum per hour is its ``messages``."""
    return _counts(spark, path, batches, grace_s, cutoff_s).corrections()
