"""Logs between jobs. A topic is a folder of Parquet batches, written whole and idempotently, read as a stream; or a Kafka
topic, where the connector is on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skytide.session import filesystem, remove_dir


def publish(rows: DataFrame, topic: str, batch: int) -> None:
    """Write a batch to a folder topic. The same batch written again replaces itself, so a retry publishes nothing twice."""
    rows.write.mode("overwrite").parquet(f"{topic}/batch_id={batch}")


def subscribe(spark: SparkSession, topics: list[str], schema: T.StructType, batch_bytes: int | None = None) -> DataFrame:
    """The rows of folder topics as one stream, each reader with its own checkpoint. ``batch_id`` is not a column."""
    out = None
    for t in topics:
        r = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        r = r.option("maxBytesPerTrigger", str(batch_bytes)) if batch_bytes else r
        df = r.parquet(t)
        out = df if out is None else out.unionByName(df)
    return out


def read(spark: SparkSession, topic: str, schema: T.StructType) -> DataFrame:
    """All rows of a folder topic."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(topic)


def compact(spark: SparkSession, topic: str, schema: T.StructType, key: str, order: str) -> None:
    """Rewrite a folder topic that no query is writing to, so that only the last row of each key by order remains. The rows are
    written beside it first, so a reader finds either the old batches or the new one."""
    rows = read(spark, topic, schema)
    others = [c for c in schema.names if c != key]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), order).alias("x")).select(key, "x.*").select(*schema.names)
    new = f"{topic.rstrip('/')}.compacted"
    last.write.mode("overwrite").parquet(f"{new}/batch_id=0")
    fs, at = filesystem(spark, topic)
    fs.delete(at, True)
    fs.rename(filesystem(spark, new)[1], at)


def expire(spark: SparkSession, topic: str, schema: T.StructType, time: str, before) -> None:
    """Drop the batches of a folder topic in which every row is older than a time; a batch with one newer row, or one without a
    time, stays whole."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(topic)
    old = rows.groupBy("batch_id").agg(F.max(F.coalesce(F.col(time) >= before, F.lit(True))).alias("kept")).where("NOT kept")
    for r in old.select("batch_id").toLocalIterator():
        remove_dir(spark, f"{topic}/batch_id={r.batch_id}")


def lag(ends: DataFrame, commits: DataFrame, groups: DataFrame, slack: int) -> DataFrame:
    """``reader, topic, behind``: how many partitions of a topic (ends: ``topic, part, last``) each of its readers (groups:
    ``reader, topic``; commits: ``reader, topic, part, done``) has more than slack records left of. A reader that has
    committed nothing of a topic hasn't started: it is behind by 1."""
    left = commits.join(ends, ["topic", "part"]).groupBy("reader", "topic").agg(F.count(F.when(F.col("last") - F.col("done") > slack, 1)).alias("behind"))
    return groups.join(left, ["reader", "topic"], "left").select("reader", "topic", F.coalesce("behind", F.lit(1)).alias("behind"))


def ingest(rows: DataFrame, topic: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Micro-batches of a stream into a folder topic, as often as the trigger says and as large as the source's limit per
    batch. What is pending when the query stops is read again when it starts, so nothing is dropped."""
    return rows.writeStream.foreachBatch(lambda df, b: publish(df, topic, b)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def lines(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of receiver lines from text files, carriage returns removed, blank lines left out; files: of one batch at
    most."""
    r = spark.readStream.option("maxFilesPerTrigger", str(files)) if files else spark.readStream
    return r.text(path).select(F.regexp_replace("value", r"\r+$", "").alias("raw")).where("raw <> ''")


def kafka(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """Records of Kafka topics from the earliest offset, committed ones only: ``key, value`` as text and ``seq``, an order
    within each partition."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    r = r.option("startingOffsets", "earliest").option("kafka.isolation.level", "read_committed").load()
    return r.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("offset").alias("seq"))


def to_kafka(rows: DataFrame, servers: str, topic: str) -> None:
    """Send a batch of ``key, value`` to a Kafka topic (at least once; readers merge by key)."""
    rows.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
