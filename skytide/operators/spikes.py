"""Implausible readings: limit violations, spikes and stuck values, judged by how each aircraft otherwise flies.

Each field of an aircraft is an irregular time series with an autoregression fitted to it robustly (Huber): an increment is a
share of what the slope before it makes one expect, plus noise. Residuals from the forecasts, forwards and backwards, are
set against the series' own robust scale and a floor given by the field's plain scatter.

1. Readings outside what can be reported at all are flagged and leave the series.
2. Additive outliers and level shifts are tested iteratively. A reading is an additive outlier if it lies on one side of both
   the forecast from before and the one from after, beyond the threshold. After a jump, readings that stay at the new level
   make a level shift, as over a hole in coverage, and are none; those that return are a patch of outliers, of any number of
   transmissions, for as long as a forecast says anything (half of HOLE_S). The worst go first; the series is tested again
   without them until nothing more is found, each series for itself.
3. In what is left, runs of one unchanged value are stuck if the aircraft's other readings say that it changed: a
   position or a speed in the air that repeats to the last digit, unlike its scatter elsewhere, or an altitude under a
   steady vertical rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytide.functions.columns import CLOCK_SET_US, MICROS
from skytide.functions.segments import chunked, floats, on_segments


@dataclass(frozen=True)
class Field:
    """low, high: what can be reported. floor: the least residual of an outlier. per_s: how fast it may change. sag: what
    the floor grows by per second of distance to the nearer neighbour, beyond a minute; for positions it is instead the
    share of the way that the aircraft flies in that time, by its own speed where that is known."""

    name: str
    low: float
    high: float
    floor: float
    per_s: float
    sag: float


FIELDS = (
    Field("altitude", -1500, 60_000, 2500, 60, 40),
    Field("ground_speed", 0, 1000, 40, 5, 0.5),
    Field("lat", -90, 90, 0.15, 0.003, 1),
    Field("lon", -180, 180, 0.15, 0.003, 1),
)
#: Seconds: copies of one transmission lie within COPY_S; neighbours further than HOLE_S away forecast nothing.
COPY_S, HOLE_S = 0.6, 600.0
#: Residuals of this many robust scales are outliers.
SCALES = 8.0
#: Seconds between readings that tell a slope, and how far a slope is carried on.
TREND_S, REACH_S = (3.0, 120.0), 60.0
#: Transmissions from which an unchanged value is stuck.
STUCK = {"position": 6, "ground_speed": 7, "altitude": 5}
#: A vertical rate (ft/min) that moves an altitude, and the change (ft) that a run must have missed.
CLIMB, MISSED_FT = 400, 400
#: Feet a second of a climb or descent whose rate wasn't heard.
CRUISE_FT_S = 33


def implausible(df: DataFrame, seq: Column, device: Column, event_us: Column, chunk_s: int = 6 * 3600, halo_s: int = 2400) -> DataFrame:
    """``seq, field, kind`` of each implausible reading; kind is ``limit``, ``spike`` or ``stuck``.

    df has ``altitude, ground_speed, lat, lon, vertical_rate`` (any of them null). Rows with a null device or seq, a
    null time or one before 2000 are no cases, nor context. Every copy of a transmission counts; repeated rows give
    repeated results only if their seq differs. Ties in time are ordered by seq. An empty table gives no rows.

    Series are cut into chunks of chunk_s with halo_s of context at both ends, so a hot aircraft is spread over tasks by
    time; a task holds a chunk at a time.
    """
    names = [f.name for f in FIELDS] + ["vertical_rate"]
    rows = df.select(seq.alias("seq"), device.alias("device"), event_us.alias("us"), *[F.col(n).cast("double").alias(n) for n in names])
    rows = rows.where(F.col("device").isNotNull() & F.col("seq").isNotNull() & (F.col("us") >= CLOCK_SET_US) & F.coalesce(*names).isNotNull())
    parts = chunked(rows, ["device"], "us", chunk_s * MICROS, halo_s * MICROS, ["us", "seq"])
    return on_segments(parts, ["device"], _flag, "seq BIGINT, field STRING, kind STRING").distinct()


def _flag(t: pa.Table, seg: np.ndarray) -> pa.RecordBatch:
    us = t.column("us").to_numpy()
    sec = (us - us.min()) / MICROS
    core, seq = np.asarray(t.column("core")), t.column("seq").to_numpy()
    values = {f.name: floats(t, f.name) for f in FIELDS}
    out: list[tuple[np.ndarray, str, str]] = []
    bad = {}
    pace = None
    for f in FIELDS:
        kind = classify(f, seg, sec, values[f.name], values["lat"], pace)
        if f.name == "ground_speed":
            pace = degrees_per_s(seg, sec, np.where(kind > 0, np.nan, values[f.name]))
        bad[f.name] = kind > 0
        out += [(np.flatnonzero((kind == 1) & core), f.name, "limit"), (np.flatnonzero((kind == 2) & core), f.name, "spike")]
    good = lambda n: np.where(bad[n], np.nan, values[n])
    both = np.isfinite(good("lat")) & np.isfinite(good("lon"))
    place = np.where(both, np.round(good("lat") * 1e6) * 1e9 + np.round(good("lon") * 1e6), np.nan)
    held = stuck_runs(seg, sec, place, STUCK["position"])
    out += [(np.flatnonzero(held & core), n, "stuck") for n in ("lat", "lon")]
    speed = good("ground_speed")
    held = stuck_runs(seg, sec, speed, STUCK["ground_speed"]) & (speed > 0)
    out.append((np.flatnonzero(held & core), "ground_speed", "stuck"))
    out.append((np.flatnonzero(stuck_altitude(seg, sec, good("altitude"), floats(t, "vertical_rate")) & core), "altitude", "stuck"))
    rows = np.concatenate([r for r, _, _ in out])
    return pa.RecordBatch.from_arrays(
        [pa.array(seq[rows]), pa.array(np.repeat([n for _, n, _ in out], [len(r) for r, _, _ in out])), pa.array(np.repeat([k for _, _, k in out], [len(r) for r, _, _ in out]))],
        names=["seq", "field", "kind"],
    )


def degrees_per_s(seg, sec, knots) -> np.ndarray:
    """At most how fast each row's aircraft moves: a margin over the speeds heard before and after, else the limit."""
    out = np.full(len(sec), FIELDS[2].per_s)
    heard = np.flatnonzero(np.isfinite(knots))
    if len(heard):
        nxt, rows = np.searchsorted(heard, np.arange(len(sec))), np.arange(len(sec))
        before, after = heard[np.maximum(nxt - 1, 0)], heard[np.minimum(nxt, len(heard) - 1)]
        ok = (seg[before] == seg) & (seg[after] == seg) & (np.abs(sec - sec[before]) <= HOLE_S / 2) & (np.abs(sec[after] - sec) <= HOLE_S / 2)
        out[rows[ok]] = np.minimum(out[ok], (np.maximum(knots[before], knots[after])[ok] * 1.3 + 20) / 216_000)  # a knot is a minute an hour
    return out


def classify(f: Field, seg, sec, v, lat, pace=None) -> np.ndarray:
    """Of each row 0 (fine or no reading), 1 (limit) or 2 (spike)."""
    kind = np.zeros(len(v), np.int8)
    kind[np.isfinite(v) & ((v < f.low) | (v > f.high))] = 1
    kind[np.isinf(v)] = 1
    rows = np.flatnonzero(np.isfinite(v) & (kind == 0))
    if len(rows) < 2:
        return kind
    group = transmissions(seg[rows], sec[rows], v[rows])
    first = np.flatnonzero(np.diff(group, prepend=-1))
    g_seg, g_sec, g_v = seg[rows][first], sec[rows][first], v[rows][first]
    stretch = np.ones(len(first))
    if f.name == "lon":  # degrees of longitude are shorter away from the equator
        y = lat[rows][first]
        y = np.where(np.isfinite(y) & (np.abs(y) <= 90), y, 0)
        y = np.median(np.stack([y, np.roll(y, 1), np.roll(y, -1)]), 0)
        stretch = 1 / np.maximum(np.cos(np.radians(y)), 0.05)
    pace = np.full(len(first), f.per_s) if pace is None else pace[rows][first]
    spikes = outliers(f, g_seg, g_sec, g_v, stretch, pace)
    kind[rows[spikes[group]]] = 2
    return kind


def transmissions(seg, sec, v) -> np.ndarray:
    """Number of the transmission of each reading: equal neighbours within COPY_S are copies of one."""
    new = np.ones(len(v), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (v[1:] != v[:-1]) | (sec[1:] - sec[:-1] > COPY_S)
    return np.cumsum(new) - 1


def _turn(f: Field, d):
    return (d + 180) % 360 - 180 if f.name == "lon" else d


def slopes(f: Field, seg, sec, v, stretch) -> tuple[np.ndarray, np.ndarray]:
    """The change per second up to each reading from the one before, and from it to the one after; 0 where there is none
    near enough, or where copies lie too close to tell. Bounded by what the field can do."""
    up_to, on = np.zeros(len(v)), np.zeros(len(v))
    if len(v) > 1:
        dt = sec[1:] - sec[:-1]
        ok = (seg[1:] == seg[:-1]) & (dt >= TREND_S[0]) & (dt <= TREND_S[1])
        most = f.per_s * stretch[1:]
        s = np.where(ok, np.clip(_turn(f, v[1:] - v[:-1]) / np.maximum(dt, TREND_S[0]), -most, most), 0)
        up_to[1:], on[:-1] = s, s
    return up_to, on


def autoregression(f: Field, seg, sec, v, stretch) -> tuple[np.ndarray, np.ndarray]:
    """Each reading's series' coefficient and robust scale. The model: an increment is phi times the increment that the
    slope before it makes one expect, plus noise (an autoregression of first order in the rates, so of second order in the
    values). Huber's estimate by reweighted least squares, steep slopes weighted down (an outlier's neighbours have them), phi within 0 and
    1; the scale is 1.4826 times the median absolute
    residual. A series of under 8 increments is a random walk (phi 0)."""
    n = int(seg[-1]) + 1 if len(seg) else 0
    phi, size = np.zeros(n), np.zeros(n)
    if len(v) > 2:
        dt = sec[1:] - sec[:-1]
        rows = np.flatnonzero((seg[1:] == seg[:-1]) & (dt <= TREND_S[1]))
        g, y = seg[rows + 1], _turn(f, v[rows + 1] - v[rows])
        u = slopes(f, seg, sec, v, stretch)[0][rows] * np.minimum(dt[rows], REACH_S)
        many = np.bincount(g, minlength=n) >= 8
        size = _medians(g, np.abs(y), n)
        lever = np.minimum(1, 2.5 * np.maximum(_medians(g, np.abs(u), n)[g], 1e-9) / np.maximum(np.abs(u), 1e-12)) ** 2
        for _ in range(4):  # Huber's weights settle quickly
            r = np.abs(y - phi[g] * u)
            w = lever * np.minimum(1, 1.345 * np.maximum(size[g], 1e-9) / np.maximum(r, 1e-12))
            uu = np.bincount(g, w * u * u, n)
            phi = np.where(many & (uu > 0), np.clip(np.bincount(g, w * u * y, n) / np.maximum(uu, 1e-30), 0, 1), 0)
        size = _medians(g, np.abs(y - phi[g] * u), n)
    return phi[seg], size[seg]


def _medians(g, r, n) -> np.ndarray:
    """1.4826 times the median of each group; 0 for one without rows."""
    out = np.zeros(n)
    if len(g):
        by = np.lexsort((r, g))
        s, at, count = np.unique(g[by], return_index=True, return_counts=True)
        out[s] = 1.4826 * r[by][at + count // 2]
    return out


def outliers(f: Field, seg, sec, v, stretch, pace) -> np.ndarray:
    """Additive outliers among the transmissions of many series.

    Each series is worked to a fixed point of its own: single outliers, then ends, leaps and patches, each only where the
    series shows none of the kinds before it; what is found is taken out and the series tested again without it. A series in
    which nothing is found is done. So its answer is the same alone and beside any others.
    """
    bad = np.zeros(len(v), bool)
    if not len(v):
        return bad
    phi, size = autoregression(f, seg, sec, v, stretch)
    least = np.maximum(f.floor * (np.minimum(stretch, 3) if f.name == "lon" else 1), SCALES * size)
    rate = np.full(len(v), f.per_s) if f.name in ("altitude", "ground_speed") else pace * stretch
    live = np.arange(len(v))
    while len(live):
        found = np.zeros(len(live), bool)
        hit = np.zeros(int(seg[-1]) + 1, bool)
        for test in (_singles, _ends, _leaps, _patches):
            open_ = np.flatnonzero(~hit[seg[live]])
            if not len(open_):
                break
            k = live[open_]
            new = test(f, seg[k], sec[k], v[k], phi[k], least[k], stretch[k], rate[k])
            found[open_[new]] = True
            hit[seg[k[new]]] = True
        bad[live[found]] = True
        live = live[hit[seg[live]] & ~found]
    return bad


def _over(f: Field, seg, sec, v, phi, least, stretch, rate):
    """Per reading the forecasts' reach: what the trend adds to it going on, and going back; and the threshold that a
    reading has to pass that lies dt from it."""
    up_to, on = slopes(f, seg, sec, v, stretch)
    fore = lambda a, dt: phi[a] * up_to[a] * np.minimum(dt, REACH_S)
    back = lambda z, dt: -phi[z] * on[z] * np.minimum(dt, REACH_S)
    plain = f.name in ("altitude", "ground_speed")
    slack = lambda near, i: f.sag * (np.maximum(near - 60, 0) if plain else near * rate[i])
    return fore, back, slack


def _singles(f: Field, seg, sec, v, phi, least, stretch, rate) -> np.ndarray:
    """The test for an additive outlier at each reading: its residuals from the forecast from before and from the one from
    after lie on one side, both beyond the threshold, whether the trend goes on or the level stays."""
    n = len(v)
    found = np.zeros(n, bool)
    if n < 3:
        return found
    fore, back, slack = _over(f, seg, sec, v, phi, least, stretch, rate)
    a, i, z = np.arange(n - 2), np.arange(1, n - 1), np.arange(2, n)
    da, dz = sec[i] - sec[a], sec[z] - sec[i]
    inside = (seg[a] == seg[z]) & (da <= HOLE_S) & (dz <= HOLE_S)
    p, q = _turn(f, v[i] - v[a]), _turn(f, v[i] - v[z])
    pt, qt = p - fore(a, da), q - back(z, dz)
    up, down = np.minimum(np.minimum(p, pt), np.minimum(q, qt)), np.minimum(np.minimum(-p, -pt), np.minimum(-q, -qt))
    s = slack(np.minimum(da, dz), i)
    if f.name == "ground_speed":  # an aircraft may land and take off again, but not the other way round
        s = np.where(up > down, s / 5, s)
    over = np.where(inside, np.maximum(up, down) - least[i] - s, -1) > 0
    if over.any():
        worst = _rougher(f, seg, sec, v, rate, over)
        found[np.flatnonzero(worst) + 1] = True
    return found


def _patches(f: Field, seg, sec, v, phi, least, stretch, rate) -> np.ndarray:
    """The test of level shifts: after a jump that the forecast rules out, the readings either stay (a level shift, no
    outlier) or come back to where the forecast from before leaves them, within half of HOLE_S. Then all of them, however many,
    are a patch of outliers if they lie beyond both sides' forecasts. Of overlapping patches of a series the shortest, then
    the worst."""
    n = len(v)
    found = np.zeros(n, bool)
    if n < 4:
        return found
    fore, back, slack = _over(f, seg, sec, v, phi, least, stretch, rate)
    a = np.arange(n - 1)
    i = a + 1
    dt = sec[i] - sec[a]
    p = _turn(f, v[i] - v[a])
    near = (seg[a] == seg[i]) & (dt <= HOLE_S)
    jump = np.minimum(np.abs(p), np.where(p * (p - fore(a, dt)) > 0, np.abs(p - fore(a, dt)), 0))
    patches = []
    for j in np.flatnonzero(near & (jump > least[i])).tolist():
        b = j + 1  # the first reading of the patch
        last = int(np.searchsorted(seg, seg[b], side="right"))
        end = b + int(np.searchsorted(sec[b:last], sec[b] + HOLE_S / 2, side="right"))
        d = _turn(f, v[b : min(end + 1, last)] - v[j])
        side = 1.0 if d[0] > 0 else -1.0
        still = side * d > least[b]
        r = len(d) if still.all() else int(np.argmin(still))
        z = b + r
        if r < 2 or z >= last or sec[z] - sec[z - 1] > HOLE_S or sec[z - 1] - sec[b] > HOLE_S / 2:
            continue
        w, ts = v[b:z], sec[b:z]
        pb, pz = side * _turn(f, w - v[j]), side * _turn(f, w - v[z])
        tb, tz = pb - side * fore(j, ts - sec[j]), pz - side * back(z, sec[z] - ts)
        s = slack(min(sec[b] - sec[j], sec[z] - sec[z - 1]), b)
        if f.name == "ground_speed" and side > 0:
            s /= 5
        s += rate[b] * min(sec[z - 1] - sec[b], sec[b] - sec[j], sec[z] - sec[z - 1])  # the longer it lasts, the more it may have flown there
        worst = min(pb.min(), pz.min(), tb.min(), tz.min()) - least[b] - s
        if worst > 0:
            patches.append((r, -worst, b, z))
    for r, _, b, z in sorted(patches):
        if not found[max(b - 1, 0) : z + 1].any():
            found[b:z] = True
    return found


def _rougher(f: Field, seg, sec, v, rate, hit) -> np.ndarray:
    """Which of the candidates to take out first (candidate i is reading i + 1). A spike makes its neighbours look like
    spikes to the other side: of two candidates in a row, the one goes whose absence leaves the smoother series; of more, every
    second one."""
    n = len(v)

    def link(a, b):
        ok = (b < n) & (seg[np.minimum(b, n - 1)] == seg[a])
        b = np.minimum(b, n - 1)
        d = np.abs(_turn(f, v[b] - v[a]))
        return np.where(ok, np.maximum(d - rate[a] * (sec[b] - sec[a]), 0) + d / 1000, 0)

    out = hit.copy()
    c = np.flatnonzero(hit)
    begin = np.flatnonzero(np.diff(c, prepend=-2) != 1)
    long = np.diff(np.append(begin, len(c)))
    # two in a row: the roughness without either
    i = c[begin[long == 2]]
    p = i + 1
    first, second = link(p - 1, p + 1) + link(p + 1, p + 2), link(p - 1, p) + link(p, p + 2)
    out[i[first > second]] = False
    out[i[first <= second] + 1] = False
    # more: spikes and fine readings take turns; of the two, those go that lie further from the readings around the row
    many = np.repeat(long > 2, long)
    row, place = np.repeat(np.arange(len(begin)), long), np.arange(len(c)) - np.repeat(begin, long)
    far = np.minimum(np.abs(_turn(f, v[c + 1] - v[np.repeat(c[begin], long)])), np.abs(_turn(f, v[c + 1] - v[np.repeat(c[begin + long - 1] + 2, long)]))) if len(c) else np.empty(0)
    mean = [np.bincount(row, far * (place % 2 == k), len(begin)) / np.maximum(np.bincount(row, place % 2 == k, len(begin)), 1) for k in (0, 1)]
    stays = np.where(mean[0] >= mean[1], 1, 0)
    out[c[many & (place % 2 == stays[row])]] = False
    return out


def _ends(f: Field, seg, sec, v, phi, least, stretch, rate) -> np.ndarray:
    """First and last readings of a series, or beside a hole, against the forecast from the one side that there is."""
    n = len(v)
    found = np.zeros(n, bool)
    if n < 3:
        return found
    joined = (seg[1:] == seg[:-1]) & (sec[1:] - sec[:-1] <= HOLE_S)
    for step in (1, -1):
        i = np.flatnonzero(~np.append(joined, False) if step < 0 else ~np.insert(joined, 0, False))
        i = i[(i + 2 * step >= 0) & (i + 2 * step < n)]
        p, q = i + step, i + 2 * step
        ok = (seg[p] == seg[i]) & (seg[q] == seg[i]) & (np.abs(sec[i] - sec[p]) <= HOLE_S / 5) & (np.abs(sec[p] - sec[q]) <= HOLE_S / 2)
        i, p, q = i[ok], p[ok], q[ok]
        d1, dt1 = _turn(f, v[p] - v[q]), np.maximum(np.abs(sec[p] - sec[q]), 1e-3)
        calm = np.abs(d1) <= f.per_s * stretch[p] * dt1 + least[p] / 4
        d0, dt0 = _turn(f, v[i] - v[p]), np.abs(sec[i] - sec[p])
        found[i[calm & (np.abs(d0) > least[i] + (0.9 if f.name == "ground_speed" else 1) * f.per_s * stretch[i] * dt0)]] = True
    return found


def _leaps(f: Field, seg, sec, v, phi, least, stretch, rate) -> np.ndarray:
    """Readings that no aircraft can reach from the one before (or leave for the one after), where the series without
    them is possible, and without their neighbour it isn't. One that agrees with its other neighbour is a level shift."""
    n = len(v)
    found = np.zeros(n, bool)
    if n < 4:
        return found

    def possible(a, b):  # a < b; nothing is known over a hole
        ok = (a >= 0) & (b < n)
        a, b = np.maximum(a, 0), np.minimum(b, n - 1)
        dt = sec[b] - sec[a]
        near = ok & (seg[a] == seg[b]) & (dt <= HOLE_S)
        fits = np.abs(_turn(f, v[b] - v[a])) <= rate[b] * dt + least[b]
        return near & fits, near & ~fits

    i = np.arange(1, n)
    i = i[possible(i - 1, i)[1]]
    without, not_without = possible(i - 1, i + 1)
    without_last, not_without_last = possible(i - 2, i)
    apart = lambda a, b: np.abs(_turn(f, v[np.minimum(b, n - 1)] - v[np.maximum(a, 0)])) > least[i] * 0.75
    found[i[without & not_without_last & apart(i, i + 1)]] = True
    found[i[without_last & not_without & apart(i - 2, i - 1)] - 1] = True
    return found


def _runs(seg, sec, v):
    """Rows with a reading, the run (equal values in a series) and the transmission of each."""
    rows = np.flatnonzero(np.isfinite(v))
    s, x = seg[rows], v[rows]
    new = np.ones(len(rows), bool)
    new[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (sec[rows][1:] - sec[rows][:-1] > HOLE_S)
    return rows, np.cumsum(new) - 1, transmissions(s, sec[rows], x), new


def stuck_runs(seg, sec, v, least: int) -> np.ndarray:
    """Rows that repeat a value over at least so many transmissions, but for the first transmission."""
    out = np.zeros(len(v), bool)
    rows, run, trans, new = _runs(seg, sec, v)
    if len(rows):
        first = trans[np.flatnonzero(new)][run]
        last = np.append(trans[np.flatnonzero(new)[1:] - 1], trans[-1])[run]
        out[rows[(last - first + 1 >= least) & (trans > first)]] = True
    return out


def stuck_altitude(seg, sec, alt, rate) -> np.ndarray:
    """Rows that repeat an altitude although it must have changed: the vertical rate heard before and after them says so, or
    the altitude after the run is further away than an aircraft can climb or sink meanwhile. A run may begin in level flight;
    then it is stuck from when the change set in, told by the jump at its end and the rate."""
    out = np.zeros(len(alt), bool)
    rows, run, trans, new = _runs(seg, sec, alt)
    if not len(rows):
        return out
    heard = np.flatnonzero(np.isfinite(rate))
    nxt = np.searchsorted(heard, rows)
    b, a = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
    if len(heard):
        before, after = heard[np.maximum(nxt - 1, 0)], heard[np.minimum(nxt, len(heard) - 1)]
        b = np.where((nxt > 0) & (seg[before] == seg[rows]) & (sec[rows] - sec[before] <= 120), rate[before], np.nan)
        a = np.where((nxt < len(heard)) & (seg[after] == seg[rows]) & (sec[after] - sec[rows] <= 120), rate[after], np.nan)
    moving = (np.abs(a) > CLIMB) & (np.abs(b) > CLIMB) & (a * b > 0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(rows)) - 1
    then = np.minimum(ends + 1, len(rows) - 1)
    wait = sec[rows[then]] - sec[rows[ends]]
    jump = np.abs(alt[rows[then]] - alt[rows[ends]])
    jumped = (seg[rows[then]] == seg[rows[ends]]) & (wait <= 200) & (jump > MISSED_FT + FIELDS[0].per_s * wait)
    many = trans[ends] - trans[starts] + 1 >= STUCK["altitude"]
    some = np.add.reduceat(moving, starts) > 0
    for k in np.flatnonzero(many & (jumped | some)):
        s, e = starts[k], ends[k] + 1
        t, m = sec[rows[s:e]], moving[s:e]
        first = int(np.argmax(m)) if m.any() else e - s
        until = t[first] if first < len(t) else np.inf
        if jumped[k]:
            close = heard[slice(*np.searchsorted(heard, [rows[s], rows[then[k]] + 1]))]
            near = np.abs(rate[close[(np.abs(rate[close]) > CLIMB) & (sec[close] > t[-1] - 300)]])
            pace = np.median(near) / 60 if len(near) else CRUISE_FT_S
            until = min(until, t[-1] + wait[k] - jump[k] / pace)  # it may have climbed earlier, but not later
        level = heard[slice(*np.searchsorted(heard, [rows[s], rows[e - 1] + 1]))]
        level = level[(np.abs(rate[level]) <= CLIMB) & (sec[level] <= until)]
        onset = max(sec[level[-1]] if len(level) else -np.inf, until if jumped[k] else -np.inf)
        hit = np.flatnonzero(t > onset)
        if not len(hit):
            continue
        h = int(hit[0])
        missed = abs(np.sum(np.diff(t)[h:] * np.where(m[h:-1], b[s:e][h:-1] / 60, 0))) if e - s - h > 1 else 0
        if trans[e - 1] - trans[s + h] + 1 >= (2 if jumped[k] else STUCK["altitude"] - 1) and (jumped[k] or missed >= MISSED_FT):
            stuck = np.arange(s + h, e)
            out[rows[stuck[trans[stuck] > trans[s]]]] = True
    return out
