"""Evaluation texts leaking into training text, by greedy string tiling with a running Karp-Rabin hash.

A seed is a run of the least length of words, the same in a document and a test item. Documents and items are joined by the
Karp-Rabin hashes of their seeds. Each pair found is then tiled: the search length falls from the longest run that both
could share to the least, and at each length at which running hashes over what isn't covered yet agree, the common runs are
laid as tiles, each word of either side once. Longer tiles so go before shorter ones, reordered passages count once each
wherever they stand, and a pair counts if the tiles cover enough of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytide.llm.spread import spread
from skytide.llm.words import hashes, rolling, words
from skytide.session import ship, stage

SCHEMA = "key BIGINT, item BIGINT, tiles INT, longest INT, covered INT, item_words INT"
#: Bits of the map of the items' seeds that goes to every task (2 MB); of many items it only lets through more documents.
BITS = 1 << 24
BASE = 0x9E3779B97F4A7C15


class Running:
    """Hashes of every run of any length of a text's words, each length in one pass over prefix sums."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        with np.errstate(over="ignore"):
            up = np.full(n, BASE, np.uint64)
            down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            if n:
                up[0] = down[0] = 1
            up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * up)])
        self.free = np.ones(n, bool)

    def room(self) -> np.ndarray:
        """How many words from each on aren't covered."""
        n = len(self.free)
        blocked = np.where(self.free, n, np.arange(n))
        return np.minimum.accumulate(blocked[::-1])[::-1] - np.arange(n) if n else np.empty(0, int)

    def runs(self, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of a length that aren't covered."""
        at = np.flatnonzero(room >= length)
        with np.errstate(over="ignore"):
            return at, (self.sums[at + length] - self.sums[at]) * self.down[at]


def tile(doc: list[str], item: list[str], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, in item, words) of at least that many words, longest first, each word of either side once.

    The longest run that both still share is found by bisection, as a shared run holds shared runs of every lesser length;
    from tile to tile the length only falls. Each tile covers words of the item, so the passes over a document are bounded by
    the item's words, however often words repeat."""
    d, i = Running(hashes(doc)), Running(hashes(item))
    out: list[tuple[int, int, int]] = []
    room_d, room_i = d.room(), i.room()
    length = min(len(doc), len(item))

    def shared(n: int) -> bool:
        few, many = np.sort(i.runs(room_i, n)[1]), d.runs(room_d, n)[1]
        return len(few) > 0 and bool((few[np.minimum(np.searchsorted(few, many), len(few) - 1)] == many).any())

    while length >= least and shared(least):
        low, high = least, length
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        length = low
        at_d, h_d = d.runs(room_d, length)
        at_i, h_i = i.runs(room_i, length)
        by = np.argsort(h_d, kind="stable")
        at_d, h_d = at_d[by], h_d[by]
        first, last = np.searchsorted(h_d, h_i), np.searchsorted(h_d, h_i, side="right")
        laid = False
        for q, a, z in zip(at_i.tolist(), first.tolist(), last.tolist()):
            if a == z or not (i.free[q] and i.free[q + length - 1]):
                continue
            p = at_d[a:z]
            p = p[d.free[p] & d.free[p + length - 1]]  # what was laid in this pass is no shorter
            if len(p) and doc[p[0] : p[0] + length] == item[q : q + length]:
                d.free[p[0] : p[0] + length] = i.free[q : q + length] = False
                out.append((int(p[0]), q, length))
                laid = True
        if not laid:  # equal hashes of other words
            length -= 1
        room_d, room_i = d.room(), i.room()
    return out


def _seeds_of(ws: list[list[str]], least: int, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The seeds' hashes of many lists of words, and the number of each one's list; each pair once. bits: only those in the
    map."""
    r = rolling(hashes([w for x in ws for w in x]), least)
    ends = np.cumsum([len(x) for x in ws])
    at = np.arange(len(r))
    if bits is not None:
        n = r & np.uint64(BITS - 1)
        at = np.flatnonzero(bits[n >> np.uint64(3)] >> (n & np.uint64(7)).astype(np.uint8) & 1)
    of = np.searchsorted(ends, at, side="right")
    inside = at + least <= ends[of] if len(at) else np.empty(0, bool)  # within one list
    both = np.unique(np.stack([of[inside], r[at[inside]].view(np.int64)]), axis=1)
    return both[0], both[1]


def _seeds(items: DataFrame, least: int) -> DataFrame:
    """``item, seed``, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, found = _seeds_of([words(t) for t in b.column("item_text").to_pylist()], least)
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(of)), pa.array(found)], names=["item", "seed"])

    return items.mapInArrow(run, "item BIGINT, seed BIGINT").distinct()


def _bits(seeds: DataFrame) -> np.ndarray:
    """The map of the seeds, made by an aggregate; its blocks of 4 kB are at most 512."""
    n = (F.col("seed").bitwiseAND(F.lit(BITS - 1)) + 1).alias("n")
    out = np.zeros(BITS // 8, np.uint8)
    for r in seeds.select(n).groupBy(F.bitmap_bucket_number("n").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")).collect():
        out[(r.block - 1) * 4096 : r.block * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _candidates(spark: SparkSession, rows: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """The documents with a seed in the map, and the seeds."""
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shared.value
        for b in batches:
            of, found = _seeds_of([words(t) for t in b.column("text").to_pylist()], least, there)
            hit, first = np.unique(of, return_index=True)
            seeds = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), pa.array(found))
            keep = pa.array(hit)
            yield pa.RecordBatch.from_arrays([b.column("key").take(keep), b.column("text").take(keep), seeds], names=["key", "text", "seeds"])

    return rows.mapInArrow(run, "key BIGINT, text STRING, seeds ARRAY<BIGINT>")


def leaks(
    df: DataFrame, key: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, least: int = 8, coverage: float = 0.0, partitions: int | None = None
) -> DataFrame:
    """Each document and test item with tiles of at least ``least`` consecutive words in common that cover at least the share
    ``coverage`` of the item's words: ``key, item, tiles, longest, covered, item_words`` (``covered``: the item's words under
    tiles). With coverage 0 one tile will do.

    Words are runs of letters and digits; letter case, punctuation, spacing, line marks, invisible characters and Unicode
    form make no difference. Null and empty texts, and items of fewer words, hold nothing; documents are read whole; equal
    documents give a row each, null keys included; an empty side gives none.

    A bitmap of fixed size lets pass the documents that may hold a seed, in one pass over the texts without a shuffle. These
    few are written to the shared folder; their seeds meet those of the items in a shuffled join, so neither the number of
    items nor a seed that many documents hold is bounded by a task's or the driver's memory.
    """
    spark = df.sparkSession
    ship(spark)
    items = items.select(item_id.cast("long").alias("item"), item_text.alias("item_text")).where("item IS NOT NULL AND item_text IS NOT NULL")
    seeds = _seeds(items, least)
    rows = spread(df.select(key.cast("long").alias("key"), text.alias("text")).where("text IS NOT NULL"), partitions)
    held = stage(_candidates(spark, rows, _bits(seeds), least).withColumn("row", F.monotonically_increasing_id()), "leaks")
    pairs = held.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("row", "item").distinct()
    both = pairs.join(held.select("row", "key", "text"), "row").join(items, "item").select("row", "key", "text", "item", "item_text")
    # a given number isn't merged at run time by size, which says little about the time that tiling takes
    both = both.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "row", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t, n, u in zip(*[b.column(c).to_pylist() for c in ("key", "text", "item", "item_text")]):
                item = words(u)
                laid = [x[2] for x in tile(words(t), item, least)]
                if laid and sum(laid) >= coverage * len(item):
                    out.append((k, n, len(laid), max(laid), sum(laid), len(item)))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 4)], names=["key", "item", "tiles", "longest", "covered", "item_words"])

    return both.mapInArrow(run, SCHEMA)
