"""Running state over long keys in bounded windows.

A running aggregate over a key that holds a third of all rows would put them into one task. Instead, rows are placed into
chunks of their order column; each chunk's total is taken (with map-side combination), totals are accumulated, and each row
joins what came before its chunk. Windows then span (key, chunk) only, and the join shares their partitioning.

A long key has many chunks too, so their totals are accumulated on two levels: over groups of WIDTH chunks, and within each
group. A window over groups is WIDTH times shorter than one over chunks, and one within a group holds WIDTH rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chunks of a group.
WIDTH = 256

#: How totals accumulate: over a window; two of them, either of which may be null; and in an aggregate, ``chunk`` being
#: their order.
_OVER = {
    "max": lambda c, w: F.max(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "sum": lambda c, w: F.sum(c).over(w),
    "last": lambda c, w: F.last(c, ignorenulls=True).over(w),
    "set": lambda c, w: F.array_distinct(F.flatten(F.collect_list(c).over(w))),
}
_BOTH = {
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "last": lambda a, b: F.coalesce(b, a),
    "set": lambda a, b: F.coalesce(F.array_union(a, b), a, b),
}
_ALL = {
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("chunk"))),
    "set": lambda c: F.array_distinct(F.flatten(F.collect_list(c))),
}


def carry_in(rows: DataFrame, keys: list[str], totals: dict[str, Column], over: dict[str, str], width: int = WIDTH) -> DataFrame:
    """rows (with a ``chunk`` column, and no nulls in keys) with, for each total, ``c_<name>``: it over all earlier chunks of the key, null for
    the first (or an empty set).

    totals: an aggregate per chunk. over: how chunks accumulate: ``max``, ``min``, ``sum``, ``set`` (union of arrays) or
    ``last`` (of the nearest earlier chunk that has one).
    """
    group = F.floor(F.col("chunk") / width).alias("group")
    per = rows.groupBy(*keys, "chunk").agg(*[c.alias(n) for n, c in totals.items()]).select("*", group)
    ahead = lambda *by: Window.partitionBy(*by).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    groups = per.groupBy(*keys, "group").agg(*[_ALL[over[n]](F.col(n)).alias(n) for n in totals]).withColumn("order", F.col("group"))
    groups = groups.select(*keys, "group", *[_OVER[over[n]](F.col(n), ahead(*keys)).alias(f"g_{n}") for n in totals])
    both = per.withColumn("order", F.col("chunk")).join(groups, [*keys, "group"])
    within = {n: _OVER[over[n]](F.col(n), ahead(*keys, "group")) for n in totals}
    before = both.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("chunk").alias("k_chunk"), *[_BOTH[over[n]](F.col(f"g_{n}"), within[n]).alias(f"c_{n}") for n in totals])
    match = [F.col(f"k_{k}") == F.col(k) for k in keys] + [F.col("k_chunk") == F.col("chunk")]
    return rows.join(before, match, "left").drop("k_chunk", *[f"k_{k}" for k in keys])
