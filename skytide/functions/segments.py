"""Python stages over sorted partitions: whole segments at a time, many segments in one numpy pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytide.functions.columns import bucket
from skytide.session import ship


def chunked(df: DataFrame, keys: list[str], us: str, chunk_us: int, halo_us: int, order: list[str]) -> DataFrame:
    """Rows placed into time chunks of their keys and sorted within, so that a hot key is spread over its chunks.

    Each chunk also gets the rows up to halo_us outside it (``core`` is false for them), as context. A partition holds
    whole (keys, chunk) segments, contiguous and ordered.
    """
    at = F.pmod(F.col(us), F.lit(chunk_us))
    own = bucket(F.col(us), chunk_us)
    if halo_us:
        places = F.array_compact(F.array(own, F.when(at < halo_us, own - 1), F.when(at >= chunk_us - halo_us, own + 1)))
        df = df.withColumn("own", own).withColumn("chunk", F.explode(places)).withColumn("core", F.col("chunk") == F.col("own")).drop("own")
    else:
        df = df.withColumn("chunk", own).withColumn("core", F.lit(True))
    # a given number of partitions isn't merged at run time by size, which says little about the time that Python takes
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys, "chunk").sortWithinPartitions(*keys, "chunk", *order)


def whole_segments(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of at least rows rows (the last may be smaller) that end where a segment ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = None
        for k in keys:
            last = t.column(k)[-1]
            eq = pc.equal(t.column(k), last) if last.is_valid else pc.is_null(t.column(k))
            same = eq if same is None else pc.and_kleene(same, eq)
        cut = t.num_rows - pc.sum(pc.fill_null(same, False)).as_py()
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def segment_ids(t: pa.Table, keys: list[str]) -> np.ndarray:
    """0, 1, 2, ... for the contiguous segments of a table."""
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        c = t.column(k)
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            c = c.combine_chunks().dictionary_encode()
            c = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).indices
        v = c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def floats(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return pc.cast(t.column(name), pa.float64()).to_numpy()


def on_segments(df: DataFrame, keys: list[str], f: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str, rows: int = 100_000) -> DataFrame:
    """f over the whole segments of a frame made by chunked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_segments(batches, [*keys, "chunk"], rows):
            yield f(t, segment_ids(t, [*keys, "chunk"]))

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


