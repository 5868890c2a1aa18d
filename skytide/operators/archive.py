"""The archive: every event as it was heard, in Parquet by date, and its replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytide.session import shared_dir

UNKNOWN = "unknown"
ORDER = ["ts", "station_id", "raw"]


def archive_rows(wire: DataFrame) -> DataFrame:
    """``dt, station_id, ts, raw``. An event without station or time is kept too: its line under ``unknown``, with an empty
    station and no time. Nothing is dropped or merged."""
    valid = F.coalesce(F.col("ts").isNotNull() & (F.col("station_id") != ""), F.lit(False))
    return wire.select(
        F.when(valid, F.date_format("ts", "yyyy-MM-dd")).otherwise(UNKNOWN).alias("dt"),
        F.when(valid, F.col("station_id")).otherwise("").alias("station_id"),
        F.when(valid, F.col("ts")).alias("ts"),
        "raw",
    )


def write_archive(wire: DataFrame, root: str, batch: int, rows_per_file: int = 5_000_000) -> None:
    """Add a batch of events to the archive under root, as ``dt=.../batch=...``; a batch written again replaces itself.

    Zstandard, sorted within files, so that row groups can be skipped by time. A date with many rows is spread over
    tasks by a salt of time and cut into files of rows_per_file.
    """
    rows = archive_rows(wire).withColumn("batch", F.lit(batch))
    salt = F.pmod(F.xxhash64("ts", "station_id"), F.lit(16))
    (
        rows.repartition("dt", salt)
        .sortWithinPartitions("dt", *ORDER)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("dt", "batch")
        .parquet(root)
    )


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """All rows of an archive with their ``dt``; filters on dt prune folders."""
    return spark.read.schema("station_id STRING, ts TIMESTAMP, raw STRING, dt STRING, batch INT").parquet(root).select("dt", "station_id", "ts", "raw")


def days(archive: DataFrame) -> DataFrame:
    """The dates there are, in order, without ``unknown``."""
    return archive.select("dt").distinct().where(F.col("dt") != UNKNOWN).orderBy("dt")


def replay(archive: DataFrame) -> DataFrame:
    """The distinct rows of all dates in canonical order: ``seq`` (1, 2, ...), ``station_id, ts, raw``. Overlapping batches
    hold rows twice; ``unknown`` is not replayed.

    The order is made by a range partitioning with offsets from the partitions' counts, so no task sees more than its
    range. (A global row_number would sort everything in one.)
    """
    rows = archive.where(F.col("dt") != UNKNOWN).select(*ORDER).dropDuplicates(ORDER)
    return numbered(rows, ORDER)


def produce(replayed: DataFrame, topic: str, size: int = 5000) -> None:
    """Write a replay to a folder topic as deliveries without a number of their own (id 0) or a receive time, in batches of
    ``size`` records in order (column ``batch``)."""
    rows = replayed.select("seq", "station_id", F.lit(0).cast("long").alias("id"), "ts", "raw", F.lit(None).cast("timestamp").alias("received_at"), F.floor((F.col("seq") - 1) / size).alias("batch"))
    rows.repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(f"{topic}/batch_id=0")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``seq``: their place in the order of the given columns (which must be total for a unique answer)."""
    spark = rows.sparkSession
    at = shared_dir(spark, "ordered")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).write.mode("overwrite").parquet(at)
    kept = spark.read.parquet(at)
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))  # a row per partition
    return kept.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("at") + 1).alias("seq"), *rows.columns)


def manifest(archive: DataFrame) -> DataFrame:
    """Per date what names its file: ``dt, first_stamp, last_stamp, rows``."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss.SSSSSS'Z'")
    return archive.groupBy("dt").agg(stamp(F.min("ts")).alias("first_stamp"), stamp(F.max("ts")).alias("last_stamp"), F.count("*").alias("rows"))


def counts(archive: DataFrame) -> DataFrame:
    """Distinct events per date and station, ``unknown`` included: rows are first made distinct on a key that spreads them,
    so a hot station isn't counted in one task."""
    distinct = archive.select("dt", "station_id", "ts", "raw").dropDuplicates()
    return distinct.groupBy("dt", "station_id").agg(F.count("*").alias("events"))
