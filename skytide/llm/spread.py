"""Texts over the tasks of a stage that is bound by CPU."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """rows as the scan splits them, without a shuffle, if there is a split for every core. A table of fewer splits is small
    (less than a split's size for each core) and is shuffled once, to even out the tasks."""
    if partitions:
        return rows.repartition(partitions)
    cores = max(rows.sparkSession.sparkContext.defaultParallelism, 2)
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(4 * cores)
