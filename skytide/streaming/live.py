"""The live pipeline: two chained streaming queries with keyed state, and two that keep what passes.

A: raw log -> decode -> high-water mark per station -> decoded topic. B: decoded topic -> fold per aircraft, with sweeps and
expiry by processing time -> state log and trace log. Beside them, C keeps every raw event in the archive, and D adds the
traces of the live log and of a replay's log to the history table, each once. State lives in the RocksDB state store and is checkpointed with the
query's progress; sinks are folder topics whose batches replace themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skytide.operators.archive import write_archive
from skytide.operators.decode import decode
from skytide.operators.history import KEY, REQUIRED, insert_new, write_traces
from skytide.operators.marks import fingerprint
from skytide.schemas import PAYLOAD, RFC3339, struct
from skytide.session import filesystem, ship
from skytide.sources.topics import publish, subscribe

SWEEP_MS, EXPIRE_MS = 10_000, 300_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RAW = struct(seq="bigint", station_id="string", id="bigint", ts="timestamp", raw="string", received_at="timestamp")
#: Times travel as microseconds through Python, which keeps them exact and free of time zones.
DECODED = struct(seq="bigint", station_id="string", us="bigint", icao="string", fp="string", **PAYLOAD)
PICTURE = struct(**PAYLOAD, position_us="bigint", first_us="bigint", last_us="bigint", stations="strings", messages="bigint").fields
STATE_LOG = T.StructType([*struct(kind="string", seq="bigint", icao="string", event_station_id="string", event_us="bigint").fields, *PICTURE])
FIELDS = [*PAYLOAD, "position_us"]


class MarkProcessor(StatefulProcessor):
    """Drops messages at or behind their station's mark; see operators.marks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "us BIGINT, fp STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values("seq", kind="stable")
        us, fp = x["us"].to_numpy(), x["fp"].to_numpy()
        if self.mark.exists():
            first, name = self.mark.get()
        else:
            first, name = np.iinfo(np.int64).min, None
        # a message no older than all before it passes or equals the mark, so the mark is the one before among these
        new = us >= np.maximum.accumulate(np.append(first, us))[:-1]
        us, fp = us[new], fp[new]
        if len(us):
            self.mark.update((int(us[-1]), fp[-1]))
            yield x[new][(us != np.append(first, us)[:-1]) | (fp != np.append(name, fp)[:-1])]

    def close(self) -> None:
        pass


class FoldProcessor(StatefulProcessor):
    """One aircraft's picture. Emits it when a field changes (kind ``changed``); at the sweep after an unchanged message
    (``sweep``); and a ``tombstone`` once nothing has been heard for longer than expire_ms, after which it starts afresh.
    Without sweep_ms there are no timers: a replay, over which nothing expires."""

    def __init__(self, sweep_ms: int | None = SWEEP_MS, expire_ms: int = EXPIRE_MS):
        self.sweep_ms, self.expire_ms = sweep_ms, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        extra = struct(set_ms="bigints", dirty="boolean", heard_ms="bigint")
        self.state = handle.getValueState("aircraft", T.StructType([*PICTURE, *extra.fields]))

    def _load(self) -> dict:
        names = [f.name for f in PICTURE] + ["set_ms", "dirty", "heard_ms"]
        s = dict(zip(names, self.state.get()))
        s["stations"], s["set_ms"] = list(s["stations"]), list(s["set_ms"])
        return s

    def _store(self, s: dict) -> None:
        self.state.update(tuple(s[f.name] for f in PICTURE) + (s["set_ms"], s["dirty"], s["heard_ms"]))

    def _alone(self, kind: str, icao: str, s: dict | None) -> pd.DataFrame:
        return _frame([[kind], [None], [icao], [None], [None], *[[s and s[f.name]] for f in PICTURE]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.sweep_ms else 0
        if self.state.exists():
            s = self._load()
        else:
            s = dict.fromkeys([f.name for f in PICTURE]) | {"stations": [], "messages": 0, "set_ms": [0] * len(FIELDS)}
            if self.sweep_ms:
                self.handle.registerTimer(now + self.sweep_ms)
        s["heard_ms"] = now
        x = pd.concat(list(rows)).sort_values("seq", kind="stable")
        pictures, changed = apply(s, x)
        self._store(s)
        at = np.flatnonzero(changed)
        if len(at):
            given = [x[c].to_numpy()[at] for c in ("seq", "station_id", "us")]
            yield _frame([["changed"] * len(at), given[0], [key[0]] * len(at), given[1], given[2], *[[pictures[f.name][i] for i in at] for f in PICTURE]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        at, s = expiredTimerInfo.getExpiryTimeInMs(), self._load()
        if at - s["heard_ms"] > self.expire_ms:
            self.state.clear()
            yield self._alone("tombstone", key[0], None)
            return
        if s["dirty"]:
            s["dirty"] = False
            self._store(s)
            yield self._alone("sweep", key[0], s)
        self.handle.registerTimer(at + self.sweep_ms)

    def close(self) -> None:
        pass


def _frame(columns: list) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(STATE_LOG.names, columns)})


def apply(s: dict, x: pd.DataFrame) -> tuple[dict[str, list], np.ndarray]:
    """Fold an aircraft's messages, in order, into its picture s; the pictures after each (a list per member), and whether any
    field changed. A field takes the value of a message that is at least as new (in milliseconds) as the one that last set
    it: who takes it is told by a running maximum, for all messages at once."""
    n = len(x)
    us = x["us"].to_numpy()
    ms, rows, changed, out = us // 1000, np.arange(n), np.zeros(n, bool), {}
    there = {f: x[f].notna().to_numpy() for f in PAYLOAD} | {"position_us": (x["lat"].notna() & x["lon"].notna()).to_numpy()}
    for k, f in enumerate(FIELDS):
        has = there[f]
        if not has.any():
            out[f] = [s[f]] * n
            continue
        v = us if f == "position_us" else x[f].to_numpy()
        takes = has & (ms >= np.maximum.accumulate(np.append(s["set_ms"][k], np.where(has, ms, -1)))[:-1])
        by = np.maximum.accumulate(np.where(takes, rows, -1)).tolist()
        known = {i: _plain(f, v[i]) for i in np.flatnonzero(takes).tolist()} | {-1: s[f]}
        values = [known[i] for i in by]
        for i in np.flatnonzero(takes).tolist():
            changed[i] |= values[i] != (values[i - 1] if i else s[f])
        out[f], s[f] = values, values[-1]
        if by[-1] >= 0:
            s["set_ms"][k] = int(ms[by[-1]])
    first, last = us if s["first_us"] is None else np.append(s["first_us"], us), us if s["last_us"] is None else np.append(s["last_us"], us)
    out["first_us"], out["last_us"] = np.minimum.accumulate(first)[-n:].tolist(), np.maximum.accumulate(last)[-n:].tolist()
    out["messages"] = (s["messages"] + 1 + rows).tolist()
    stations, held = [], s["stations"]
    for name in x["station_id"].to_numpy():
        if name not in held:
            held = sorted([*held, name])
        stations.append(held)
    out["stations"] = stations
    s |= {"first_us": out["first_us"][-1], "last_us": out["last_us"][-1], "messages": out["messages"][-1], "stations": held, "dirty": not changed[-1]}
    return out, changed


def _plain(f: str, v):
    """A value of a message's column, which pandas may have widened, as the type of the field."""
    kind = "bigint" if f == "position_us" else PAYLOAD[f]
    return {"int": int, "bigint": int, "double": float, "boolean": bool}.get(kind, str)(v)


def decoded_stream(raw: DataFrame) -> DataFrame:
    """Query A's plan over a stream of RAW."""
    rows = decode(raw).select("seq", "station_id", F.unix_micros("ts").alias("us"), "icao", fingerprint().alias("fp"), *PAYLOAD)
    return rows.groupBy("station_id").transformWithStateInPandas(MarkProcessor(), DECODED, "Append", "None")


def state_stream(decoded: DataFrame, sweep_ms: int | None = SWEEP_MS, expire_ms: int = EXPIRE_MS) -> DataFrame:
    """Query B's plan over a stream of DECODED."""
    rows = decoded.where("icao IS NOT NULL")
    return rows.groupBy("icao").transformWithStateInPandas(FoldProcessor(sweep_ms, expire_ms), STATE_LOG, "Append", "ProcessingTime" if sweep_ms else "None")


def start_decoder(spark: SparkSession, raw: DataFrame, root: str, trigger: dict) -> StreamingQuery:
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    sink = lambda df, b: publish(df, f"{root}/decoded", b)
    return decoded_stream(raw).writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint/decoder").trigger(**trigger).start()


def start_folder(spark: SparkSession, root: str, trigger: dict, sweep_ms: int | None = SWEEP_MS, expire_ms: int = EXPIRE_MS) -> StreamingQuery:
    """A query with timers never runs out of work: give sweep_ms None with the trigger availableNow. Both outputs of a batch come from one evaluation: the state log is written, and the trace log is cut from it."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def sink(df: DataFrame, b: int) -> None:
        publish(df, f"{root}/state", b)
        publish(df.sparkSession.read.schema(STATE_LOG).parquet(f"{root}/state/batch_id={b}").where("kind = 'changed'"), f"{root}/traces", b)

    states = state_stream(subscribe(spark, [f"{root}/decoded"], DECODED), sweep_ms, expire_ms)
    return states.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint/folder").trigger(**trigger).start()


def state_records(log: DataFrame) -> DataFrame:
    """``key, value`` of a state log: the picture as JSON, with times in UTC; a tombstone has no value."""
    stamped = log.withColumns({new: F.timestamp_micros(old) for old, new in (("first_us", "first_seen"), ("last_us", "last_seen"), ("position_us", "position_ts"))})
    members = F.struct("icao", "first_seen", "last_seen", "position_ts", "stations", "messages", *PAYLOAD)
    return stamped.select("seq", F.col("icao").alias("key"), F.when(F.col("kind") != "tombstone", F.to_json(members, {"timestampFormat": RFC3339})).alias("value"))


def start_archiver(raw: DataFrame, archive: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Query C: every event of the raw log into the archive, undecodable ones included. A batch run again replaces itself."""
    return raw.writeStream.foreachBatch(lambda df, b: write_archive(df, archive, b)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_history(spark: SparkSession, topics: list[str], table: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Query D: the traces of several topics (live, and of a replay) into one history table, by natural key, so that neither
    a replay nor a retry adds a trace twice. A trace without one of its required members ends the query before the batch is
    written."""
    names = {"event_us": "event_ts", "first_us": "first_seen", "last_us": "last_seen", "position_us": "position_ts"}

    def sink(df: DataFrame, b: int) -> None:
        times = {new: F.timestamp_micros(old) for old, new in names.items()}
        rows = df.withColumns(times).drop("kind", *names)
        broken = F.greatest(*[F.col(c).isNull() for c in REQUIRED])
        rows = rows.withColumn("icao", F.when(broken, F.raise_error(F.lit("a trace lacks a required member")).cast("string")).otherwise(F.col("icao")))
        days = [r.day for r in rows.select(F.to_date("last_seen").alias("day")).distinct().collect()]  # few
        there = _history(df.sparkSession, table, rows.schema, days)
        write_traces(insert_new(there, rows, KEY, "seq"), table)

    traces = subscribe(spark, topics, STATE_LOG)
    return traces.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _history(spark: SparkSession, table: str, schema: T.StructType, days: list) -> DataFrame:
    """The history's rows of some days of last_seen, which is part of the key, so no other folder can hold a batch's keys."""
    fs, path = filesystem(spark, table)
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    kept = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
    return spark.read.schema(kept).parquet(table).where(F.col("day").isin(days)).drop("day")
