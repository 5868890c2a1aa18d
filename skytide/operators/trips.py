"""Stops and trips from location pings, by penalised changepoint segmentation.

Per device, stray positions are filtered out, and the rest is read as one position a minute with the displacement from
the minute before. Breaks of more than ten minutes cut the series into pieces. Within a piece, optimal partitioning with
a penalty per changepoint (PELT) divides the log displacement into stretches of constant mobility, each labelled dwell or
move by its speed. The ends of a dwell are then set by the exact distance of its positions from its place. Dwells of one
place, with nothing but strays between them and no hole of more than three hours, make one stop; what lies between stops
is a trip.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytide.functions.columns import CLOCK_SET_US, MICROS
from skytide.functions.segments import chunked, floats, on_segments, whole_segments
from skytide.operators.spikes import FIELDS, outliers, transmissions
from skytide.operators.zones import distance_m

LEGS = "device STRING, a BIGINT, z BIGINT, n BIGINT, dwell BOOLEAN, lat DOUBLE, lon DOUBLE, lat0 DOUBLE, lon0 DOUBLE, lat1 DOUBLE, lon1 DOUBLE, metres DOUBLE"
SPELLS = "device STRING, kind STRING, start_us BIGINT, end_us BIGINT, pings BIGINT, metres DOUBLE, lat DOUBLE, lon DOUBLE"
#: A break in the signal; the longest hole within a stop; a bin of the signal (seconds).
BREAK_S, HOLE_S, BIN_S = 600, 3 * 3600, 60
#: Displacement per minute below which a stretch is a dwell, and the scale of the log signal (metres).
STILL_M, NOISE_M = 90.0, 30.0
#: Positions elsewhere that don't end a stop.
STRAYS = 2


def stops_and_trips(
    df: DataFrame, device: Column, event_us: Column, lat: Column, lon: Column, radius_m: float = 300.0, least_s: float = 600.0, chunk_s: int = 12 * 3600
) -> DataFrame:
    """``device, kind (stop or trip), start_us, end_us, duration_us, pings, metres, lat, lon``.

    A stop: a device within radius_m of one place (``lat``, ``lon``) for at least least_s. A trip: pings outside
    stops, up to the next stop or a hole of more than three hours; ``metres`` is the way along the filtered pings, 0 for a stop. Rows
    with a null device, time or position, times before 2000 and positions beyond 90 or 180 degrees are no pings. Copies
    of a ping and ties change nothing; an empty table gives no rows.

    Devices are cut into chunks of time, so a hot one is spread over tasks; the chunks' few legs are merged per device.
    """
    rows = df.select(device.alias("device"), event_us.alias("us"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    rows = rows.where("device IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180").where(F.col("us") >= CLOCK_SET_US)

    def cut(t: pa.Table, seg: np.ndarray) -> pa.RecordBatch:
        return _legs(t, seg, radius_m)

    legs = on_segments(chunked(rows, ["device"], "us", chunk_s * MICROS, 0, ["us", "lat", "lon"]), ["device"], cut, LEGS)

    def join(batches):
        for t in whole_segments(batches, ["device"], 20_000):
            yield _join(t, radius_m, least_s)

    return legs.repartition("device").sortWithinPartitions("device", "a", "z").mapInArrow(join, SPELLS).select(
        "device", "kind", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "pings", "metres", "lat", "lon"
    )


def _turn(d):
    return (d + 180) % 360 - 180


def _legs(t: pa.Table, seg: np.ndarray, radius_m: float) -> pa.RecordBatch:
    """The dwells and moves of whole segments."""
    us, lat, lon = t.column("us").to_numpy(), floats(t, "lat"), floats(t, "lon")
    sec = (us - us.min()) / MICROS
    keep = np.flatnonzero(np.diff(transmissions(seg, sec, np.round(lat * 1e6) * 1e9 + np.round(lon * 1e6)), prepend=-1))
    for f, v in ((FIELDS[2], lat), (FIELDS[3], lon)):
        s = np.ones(len(keep)) if f.name == "lat" else 1 / np.maximum(np.cos(np.radians(lat[keep])), 0.05)
        keep = keep[~outliers(f, seg[keep], sec[keep], v[keep], s, np.full(len(keep), f.per_s))]
    seg, sec, us, lat, lon = seg[keep], sec[keep], us[keep], lat[keep], lon[keep]
    rows: list[tuple] = []
    if len(keep):
        new = np.ones(len(keep), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (sec[1:] - sec[:-1] > BREAK_S)
        starts = np.append(np.flatnonzero(new), len(keep))
        step = np.zeros(len(keep))
        step[1:] = distance_m(lat[:-1], lon[:-1], lat[1:], lon[1:])
        for i, j in zip(starts[:-1], starts[1:]):
            for a, z, still in _stretches(sec[i:j], lat[i:j], lon[i:j], radius_m):
                a, z = a + i, z + i
                rows.append((keep[a], us[a], us[z - 1], z - a, still, np.median(lat[a:z]), _middle(lon[a:z]), lat[a], lon[a], lat[z - 1], lon[z - 1], step[a + 1 : z].sum()))
    cols = list(zip(*rows)) if rows else [()] * 12
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.float64()] * 7]
    device = t.column("device").combine_chunks().take(pa.array(cols[0], pa.int64()))
    device = device.combine_chunks() if isinstance(device, pa.ChunkedArray) else device
    return pa.RecordBatch.from_arrays([device, *[pa.array(c, k) for c, k in zip(cols[1:], kinds)]], names=[x.split()[0] for x in LEGS.split(", ")])


def _middle(lon) -> float:
    """The median longitude, also across 180 degrees."""
    return float(_turn(lon[0] + np.median(_turn(lon - lon[0]))))


def _stretches(sec, lat, lon, radius_m):
    """(from, to, is it a dwell) of a piece without breaks."""
    n = len(sec)
    cell = np.floor((sec - sec[0]) / BIN_S).astype(int)
    at = np.flatnonzero(np.diff(cell, prepend=-1))
    end = np.append(at[1:], n)
    if len(at) < 3:
        still = distance_m(np.median(lat), _middle(lon), lat, lon).max() <= radius_m
        return [(0, n, True)] if still else _exact([], lat, lon, radius_m)
    mid = (at + end - 1) // 2
    y, x = np.array([np.median(lat[a:z]) for a, z in zip(at, end)]), np.array([_middle(lon[a:z]) for a, z in zip(at, end)])
    moved = distance_m(y[:-1], x[:-1], y[1:], x[1:]) / np.maximum((sec[mid[1:]] - sec[mid[:-1]]) / BIN_S, 0.5)
    moved = np.insert(moved, 0, moved[0])
    signal = np.log1p(moved / NOISE_M)
    noise = np.median(np.abs(np.diff(signal))) / 0.954
    cuts = changepoints(signal, 3 * max(noise, 0.3) ** 2 * math.log(len(signal)))
    found = []
    for b, e in zip(cuts[:-1], cuts[1:]):
        found.append([at[b], end[e - 1], bool(np.median(moved[b:e]) < STILL_M)])
    return _exact(found, lat, lon, radius_m)


def changepoints(y: np.ndarray, penalty: float) -> list[int]:
    """Optimal partitioning of a series into stretches of constant mean (least squares), with pruning; the bounds from 0
    to its length."""
    n = len(y)
    s1, s2 = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
    best, prev = np.zeros(n + 1), np.zeros(n + 1, int)
    best[0] = -penalty
    cand = np.array([0])
    for t in range(1, n + 1):
        cost = best[cand] + s2[t] - s2[cand] - (s1[t] - s1[cand]) ** 2 / (t - cand) + penalty
        k = int(np.argmin(cost))
        best[t], prev[t] = cost[k], cand[k]
        cand = np.append(cand[cost - penalty <= best[t]], t)
    out = [n]
    while out[-1]:
        out.append(int(prev[out[-1]]))
    return out[::-1]


def _exact(found, lat, lon, radius_m):
    """Set the ends of each dwell by distance from its place: it loses pings outside and takes neighbours inside. A
    lone ping outside doesn't end it."""
    n = len(lat)
    label = np.full(n, -1)
    for k, (a, z, still) in enumerate(found):
        if not still:
            continue
        y, x = np.median(lat[a:z]), _middle(lon[a:z])
        lo, hi = a, z
        while lo < z and distance_m(y, x, lat[lo], lon[lo]) > radius_m:
            lo += 1
        while hi > lo and distance_m(y, x, lat[hi - 1], lon[hi - 1]) > radius_m:
            hi -= 1
        if lo >= hi:
            continue
        near = distance_m(y, x, lat[:lo], lon[:lo]) <= radius_m
        while lo > 0 and (near[lo - 1] or (lo > 1 and near[lo - 2])):
            lo -= 1 if near[lo - 1] else 2
        near = distance_m(y, x, lat[hi:], lon[hi:]) <= radius_m
        h = 0
        while h < len(near) and (near[h] or (h + 1 < len(near) and near[h + 1])):
            h += 1 if near[h] else 2
        free = np.flatnonzero(label[lo : hi + h] < 0) + lo
        label[free] = k
    # the first and the last pings of a piece may belong to a stop that goes on beyond the break
    if label[0] < 0:
        far = np.flatnonzero((distance_m(lat[0], lon[0], lat, lon) > radius_m) | (label >= 0))
        label[: far[0] if len(far) else n] = len(found)
    if label[-1] < 0:
        far = np.flatnonzero((distance_m(lat[-1], lon[-1], lat, lon) > radius_m) | (label >= 0))
        label[far[-1] + 1 if len(far) else 0 :] = len(found) + 1
    cut = np.append(np.flatnonzero(np.diff(label, prepend=-2)), n)
    return [(a, z, bool(label[a] >= 0)) for a, z in zip(cut[:-1], cut[1:])]


def _metres(lat1, lon1, lat2, lon2) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(math.sqrt(min(1, h)))


def _join(t: pa.Table, radius_m: float, least_s: float) -> pa.RecordBatch:
    """Stops and trips from the legs of whole devices."""
    out: list[tuple] = []
    legs: list[dict] = []
    for leg in [*t.to_pylist(), None]:
        if legs and (leg is None or leg["device"] != legs[0]["device"]):
            out += _spells(legs, radius_m, least_s)
            legs = []
        if leg is not None:
            legs.append(leg)
    cols = list(zip(*out)) if out else [()] * 8
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SPELLS.split(", ")])


def _spells(legs: list[dict], radius_m: float, least_s: float):
    """Merge a device's legs, in order of time, to stops; the rest to trips."""
    stops: list[dict] = []
    todo, cur, aside = list(reversed(legs)), None, []
    while todo or cur:
        leg = todo.pop() if todo else None
        if leg is not None and cur is None:
            if leg["dwell"]:
                cur, aside = dict(leg), []
            continue
        fits = leg is not None and leg["a"] - cur["z"] <= HOLE_S * MICROS
        if fits and _metres(cur["lat"], cur["lon"], leg["lat"], leg["lon"]) <= radius_m and (leg["dwell"] or leg["metres"] <= 2 * radius_m):
            n = cur["n"] + leg["n"]
            w = leg["n"] / n
            cur |= {"z": max(cur["z"], leg["z"]), "n": n, "lat": cur["lat"] + w * (leg["lat"] - cur["lat"]), "lon": _turn(cur["lon"] + w * _turn(leg["lon"] - cur["lon"]))}
            aside = []
            continue
        if fits and sum(x["n"] for x in aside) + leg["n"] <= STRAYS:
            aside.append(leg)
            continue
        if cur["z"] - cur["a"] >= least_s * MICROS:
            stops.append(cur)
        if leg is not None:
            aside.append(leg)
        todo += reversed(aside)
        cur, aside = None, []
    yield from ((s["device"], "stop", s["a"], s["z"], s["n"], 0.0, s["lat"], s["lon"]) for s in stops)
    k, trip = 0, []
    for leg in legs:
        while k < len(stops) and stops[k]["z"] < leg["a"]:
            yield from _trip(trip)
            k, trip = k + 1, []
        if k < len(stops) and leg["a"] >= stops[k]["a"] and leg["z"] <= stops[k]["z"]:
            yield from _trip(trip)
            trip = []
            continue
        if trip and leg["a"] - trip[-1]["z"] > HOLE_S * MICROS:
            yield from _trip(trip)
            trip = []
        trip.append(leg)
    yield from _trip(trip)


def _trip(legs: list[dict]):
    if legs and legs[-1]["z"] > legs[0]["a"]:
        way = sum(x["metres"] for x in legs) + sum(_metres(p["lat1"], p["lon1"], q["lat0"], q["lon0"]) for p, q in zip(legs, legs[1:]))
        yield (legs[0]["device"], "trip", legs[0]["a"], legs[-1]["z"], sum(x["n"] for x in legs), way, None, None)
