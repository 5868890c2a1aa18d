"""The message ledger: a keyed streaming state store of the messages seen so far.

Messages are delivered at least once. A message is known by ``(station_id, id, ts)``; the delivery that stays is the one
received first (unknown receive times last), then the lowest ``seq``. The log is not in receive order, so the keeper of
a message may still change when a later log entry turns out to have been received earlier.

A log comes in micro-batches of a stream, each of which turns state ``b-1`` and its rows into state ``b``:

* state: the keepers, stored by day of their event time, as the event time is part of the key. A batch adds only the keepers
  that are new or better, as ``state/batch=b/day=..``; nothing is rewritten, as of several versions of a message the best
  one counts, which an aggregate takes;
* expiry: the days at or after the watermark (``watermark_s`` behind the latest event time of the batches before) are the
  working state; a batch reads those of them that its own rows lie in;
* late-arrival lookup: a day behind the watermark, and messages without an event time, have left the working state. Rows of
  such days are looked up by key in the folders of just those days, so expiry never loses a repeat.

Everything a batch makes lies in folders named by the batch and is overwritten when the batch is run again after a
failure; results read only batches that are done, and the stream's checkpoint makes a batch count only then. State and output
so advance together, and a ledger opened again on its folder goes on where it stopped.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytide.functions.columns import MICROS, bucket, floor_to
from skytide.session import filesystem, remove_dir, shared_dir
from skytide.sources.tables import instants

KEY = ["station_id", "id", "ts_us"]
HOUR_US, DAY_US = 3600 * MICROS, 86_400 * MICROS
#: Micro-batches that a closed log is cut into at least, and their rows at most.
BATCHES, BATCH_ROWS = 10, 200_000_000
#: The day of messages without an event time.
NO_DAY = -(2**31)
_STATE = "station_id STRING, id BIGINT, ts_us BIGINT, recv_us BIGINT, seq BIGINT"
_COUNTS = "station_id STRING, period_us BIGINT, on_time BIGINT, late BIGINT, beyond BIGINT"
_PART = ", batch INT, day INT"
_OFFSET = "batch INT, first BIGINT, last BIGINT, files ARRAY<STRING>, top BIGINT, days ARRAY<INT>"


def _day(us):
    return F.coalesce(bucket(us, DAY_US), F.lit(NO_DAY)).cast("int")


@dataclass
class Ledger:
    """A ledger in a shared folder. ``drops``: also write each delivery that repeats another; ``counts``: also keep
    counts per station and hour of ``ts``, corrected by signed deltas."""

    spark: SparkSession
    root: str
    drops: bool = True
    counts: bool = False
    watermark_s: int = 86_400
    grace_s: int = 300
    cutoff_s: int = 21_600
    #: Latest event time of each batch, and the batches that have a folder for each day, by kind of folder.
    _tops: dict = field(default_factory=dict)
    _places: dict = field(default_factory=lambda: {"state": defaultdict(set), "counts": defaultdict(set)})

    def __post_init__(self):
        for text in _texts(self.spark, f"{self.root}/tops"):
            self._tops |= {int(k): v for k, v in json.loads(text).items()}
        for kind in self._places:
            for b in _children(self.spark, f"{self.root}/{kind}", "batch="):
                self._index(kind, b)

    # -- the stream

    def replay(self, path: str, batches: int = BATCHES) -> Ledger:
        """Feed a closed log (a Parquet table of any number of files), in order of ``seq``; returns when all of it is in.

        The log is cut into at least so many ranges of ``seq``, of at most about BATCH_ROWS rows. The stream's records are
        these ranges (offsets into the log, with the files that hold them): each micro-batch takes one and reads its rows
        from the log itself, so files may be of any size and nothing is copied."""
        offsets = f"{self.root}/offsets"
        fs, at = filesystem(self.spark, offsets)
        if not fs.exists(at):
            _write_texts(self.spark, offsets, {f"{x['batch']:08d}.json": json.dumps(x) for x in self._cut(path, batches)})
        schema = self.spark.read.parquet(path).schema
        stream = self.spark.readStream.schema(_OFFSET).option("maxFilesPerTrigger", 1).json(offsets)

        def take(ranges: DataFrame, _: int) -> None:
            for r in ranges.collect():  # one
                rows = instants(ranges.sparkSession.read.schema(schema).parquet(*r.files)).where(F.col("seq").between(r.first, r.last))
                self.apply(rows, r.batch, r.top, r.days)

        self._run(stream, take)
        return self

    def follow(self, stream: DataFrame, trigger: dict) -> Ledger:
        """Feed a stream of deliveries."""
        self._run(stream, self.apply, trigger)
        return self

    def _run(self, stream: DataFrame, sink, trigger: dict | None = None) -> None:
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{self.root}/stream").trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()

    def _cut(self, path: str, batches: int) -> list[dict]:
        """The ranges of a log: a row per range and file comes to the driver, about as many as the log has files."""
        log = instants(self.spark.read.parquet(path))
        low, high, n = log.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
        if low is None:
            return []
        step = -(-(high - low + 1) // max(batches, -(-n // BATCH_ROWS)))
        seq, ts, recv = F.col("seq"), F.unix_micros("ts"), F.unix_micros("received_at")
        part = F.call_function("div", seq - F.lit(low), F.lit(step)).cast("int").alias("batch")
        found = log.where("seq IS NOT NULL").groupBy(part, F.col("_metadata.file_path").alias("file")).agg(F.max(F.least(ts, recv)).alias("top"), F.collect_set(_day(ts)).alias("days"))
        out: dict[int, dict] = {}
        for r in found.collect():
            x = out.setdefault(r.batch, {"batch": r.batch, "first": low + r.batch * step, "last": low + (r.batch + 1) * step - 1, "files": [], "top": None, "days": []})
            x["files"].append(r.file)
            x["top"] = r.top if x["top"] is None or (r.top or x["top"]) > x["top"] else x["top"]
            x["days"] = sorted({*x["days"], *r.days})
        return [out[b] for b in sorted(out)]

    def apply(self, rows: DataFrame, batch: int, top: int | None = None, days: list[int] | None = None) -> None:
        """One micro-batch (``station_id, id, ts, received_at, seq``). Running it again with the same number replaces what it
        wrote. top, days: its latest event time and its event days (found out if not given). Event times after the receive
        time count as the receive time."""
        spark = rows.sparkSession
        rows = rows.select("station_id", "id", F.unix_micros("ts").alias("ts_us"), F.unix_micros("received_at").alias("recv_us"), "seq").withColumn("day", _day(F.col("ts_us")))
        if days is None:
            top, days = rows.agg(F.max(F.least("ts_us", "recv_us")), F.collect_set("day")).first()
        mark = self._watermark(batch)
        named = rows.where("id <> 0")  # 0 and null: the station gave no number, so each delivery is its own message
        best = F.struct(F.col("recv_us").isNull().alias("unknown"), "recv_us", "seq")
        union = named.withColumn("old", F.lit(False)).unionByName(self._seen(spark, batch, days, mark, named).withColumn("old", F.lit(True)))
        keepers = (
            union.groupBy(*KEY, "day")
            .agg(F.min(best).alias("k"), F.min(F.when(F.col("old"), best)).alias("o"))
            .where("o IS NULL OR o.seq <> k.seq")
            .select(*KEY, "day", F.col("k.recv_us").alias("recv_us"), F.col("k.seq").alias("seq"), F.col("o.recv_us").alias("old_recv_us"), F.col("o.seq").alias("old_seq"))
        )
        keepers.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/state/batch={batch}")
        self._index("state", batch)
        made = self._read(spark, "state", _STATE + ", old_recv_us BIGINT, old_seq BIGINT", [(batch, d) for d in self._days("state", batch)])
        if self.drops:
            losers = named.select("seq").unionAll(made.where("old_seq IS NOT NULL").select(F.col("old_seq").alias("seq")))
            losers.join(made.select("seq"), "seq", "left_anti").write.mode("overwrite").parquet(f"{self.root}/drops/batch={batch}")
        if self.counts:
            self._count(rows.where("id = 0 OR id IS NULL"), made, batch, days)
        self._tops[batch] = top
        _write_texts(spark, f"{self.root}/tops", {str(batch): json.dumps({batch: top})})
        _write_texts(spark, f"{self.root}/done", {str(batch): ""})

    # -- state

    def _watermark(self, batch: int) -> int:
        tops = [t for b, t in self._tops.items() if b < batch and t is not None]
        return max(tops) - self.watermark_s * MICROS if tops else -(2**62)

    def _seen(self, spark: SparkSession, batch: int, days: list[int], mark: int, named: DataFrame) -> DataFrame:
        """The keepers so far that a batch's rows may repeat: the working state of its days, and of its days behind the
        watermark what its late rows' keys find there."""
        first = max(mark // DAY_US, NO_DAY + 1)
        at = lambda ds: [(b, d) for d in ds for b in sorted(self._places["state"][d]) if b < batch]
        working = self._read(spark, "state", _STATE, at([d for d in days if d >= first]))
        late = at([d for d in days if d < first])
        if not late:
            return working
        c, k = self._read(spark, "state", _STATE, late).alias("c"), named.where(F.col("day") < first).select(*KEY).distinct().alias("k")
        return working.unionByName(c.join(k, [F.col(f"c.{x}").eqNullSafe(F.col(f"k.{x}")) for x in KEY], "left_semi"))

    def _read(self, spark: SparkSession, kind: str, schema: str, at: list[tuple[int, int]]) -> DataFrame:
        """The folders of some (batch, day), with the day, and for counts with the batch."""
        keep = [c.split()[0] for c in schema.split(", ")] + ["day"] + (["batch"] if kind == "counts" else [])
        if not at:
            return spark.createDataFrame([], schema + _PART).select(*keep)
        paths = [f"{self.root}/{kind}/batch={b}/day={d}" for b, d in at]
        return spark.read.schema(schema + _PART).option("basePath", f"{self.root}/{kind}").parquet(*paths).select(*keep)

    def _index(self, kind: str, batch: int) -> None:
        for d in _children(self.spark, f"{self.root}/{kind}/batch={batch}", "day="):
            self._places[kind][d].add(batch)

    def _days(self, kind: str, batch: int) -> list[int]:
        return [d for d, bs in self._places[kind].items() if batch in bs]

    # -- counts by event time

    def _count(self, unnamed: DataFrame, made: DataFrame, batch: int, days: list[int]) -> None:
        """Fold the batch's changes of keepers into the counts: a new keeper adds to its hour, a replaced one is retracted
        from it. The signed deltas take the last version of each hour that they touch to a new one; other hours, and other
        days' folders, are neither read nor written."""
        one = lambda df, recv, sign: df.select("station_id", "ts_us", F.col(recv).alias("recv_us"), F.lit(sign).cast("long").alias("d"))
        moves = one(made, "recv_us", 1).unionAll(one(unnamed, "recv_us", 1)).unionAll(one(made.where("old_seq IS NOT NULL"), "old_recv_us", -1))
        end = F.col("period_us") + HOUR_US
        names = ("on_time", "late", "beyond")
        deltas = (
            moves.where("ts_us IS NOT NULL AND recv_us IS NOT NULL")
            .withColumn("period_us", floor_to(F.col("ts_us"), HOUR_US))
            .withColumn("class", F.when(F.col("recv_us") <= end + self.grace_s * MICROS, 0).when(F.col("recv_us") <= end + self.cutoff_s * MICROS, 1).otherwise(2))
            .groupBy("station_id", "period_us")
            .agg(*[F.sum(F.when(F.col("class") == k, F.col("d")).otherwise(0)).alias(n) for k, n in enumerate(names)])
        )
        at = [(b, d) for d in days for b in sorted(self._places["counts"][d]) if b < batch]
        before = self._read(made.sparkSession, "counts", _COUNTS, at).drop("day")
        both = before.unionByName(deltas.withColumn("batch", F.lit(None).cast("int")))
        delta = F.col("batch").isNull()
        last = F.max_by(F.when(~delta, F.struct(*names)), "batch").alias("v")
        now = both.groupBy("station_id", "period_us").agg(last, *[F.sum(F.when(delta, F.col(n))).alias(n) for n in names]).where("on_time IS NOT NULL")
        of = lambda n: F.coalesce(F.col(f"v.{n}"), F.lit(0))
        now = now.select("station_id", "period_us", *[(of(n) + F.col(n)).alias(n) for n in names], (of("on_time") + of("late")).alias("was"), _day(F.col("period_us")).alias("day"))
        now.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/counts/batch={batch}")
        self._index("counts", batch)

    # -- results

    def batches(self) -> list[int]:
        """The batches that are done."""
        return sorted(_children(self.spark, f"{self.root}/done", ""))

    def close(self) -> Ledger:
        """Give up the state, which only further batches need; results stay."""
        remove_dir(self.spark, f"{self.root}/state")
        return self

    def dropped(self) -> DataFrame:
        """``seq`` of each delivery that repeats another."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], "seq BIGINT")
        return self.spark.read.schema("seq BIGINT").parquet(*[f"{self.root}/drops/batch={b}" for b in done])

    def _versions(self, extra: str = "") -> DataFrame:
        done = set(self.batches())
        return self._read(self.spark, "counts", _COUNTS + extra, [(b, d) for d, bs in self._places["counts"].items() for b in sorted(bs & done)])

    def counted(self) -> DataFrame:
        """The last version of each station's hour."""
        names = ("on_time", "late", "beyond")
        return self._versions().groupBy("station_id", "period_us").agg(F.max_by(F.struct(*names), "batch").alias("v")).select("station_id", "period_us", "v.*")

    def corrections(self) -> DataFrame:
        """What a downstream reader of the counts gets: for each version of an hour whose count differs from the one before,
        that one with a minus sign (unless it was 0) and the new one with a plus: ``batch, station_id, period_us, delta``."""
        now = F.col("on_time") + F.col("late")
        signed = F.explode(F.array(-F.col("was"), now)).alias("delta")
        return self._versions(", was BIGINT").where(now != F.col("was")).select("batch", "station_id", "period_us", signed).where("delta <> 0")


def _children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers that the names in a folder end in, after a prefix; of no folder, none."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].lstrip("-").isdigit()]


def _write_texts(spark: SparkSession, folder: str, texts: dict[str, str]) -> None:
    """Small files, each written whole under another name first, dated in order."""
    fs, p = filesystem(spark, folder)
    fs.mkdirs(p)
    for n, (name, text) in enumerate(texts.items()):
        fs, p = filesystem(spark, f"{folder}/{name}")
        _, tmp = filesystem(spark, f"{folder}/_{name}")
        out = fs.create(tmp, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        fs.delete(p, False)
        fs.rename(tmp, p)
        if len(texts) > 1:
            fs.setTimes(p, 1_000_000_000_000 + 1000 * n, -1)


def _texts(spark: SparkSession, folder: str) -> list[str]:
    fs, p = filesystem(spark, folder)
    return [r.value for r in spark.read.text(folder).collect()] if fs.exists(p) else []


def ledger(spark: SparkSession, path: str, batches: int = BATCHES, **options) -> Ledger:
    """A new ledger in the shared folder with all deliveries under path in it."""
    return Ledger(spark, shared_dir(spark, "ledger"), **options).replay(path, batches)
