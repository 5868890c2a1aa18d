"""Points in circular zones on the sphere, by trapezoidal decomposition.

A zone's boundary meets each parallel of latitude in two points, so between the latitudes where zones begin, end or cross
each other (a slab) the boundaries are edges in a fixed order of longitude. Between two neighbouring edges of a slab lies
a trapezoid, every point of which is in the same zones. A point is located by binary search for its slab, then by binary
search among the slab's edges, each evaluated at the point's own latitude.

Slabs are distributed by latitude: a group of them, those of one degree, goes with the zones that reach into it to the tasks
that get the points of these latitudes, and is built there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytide.session import ship

EARTH_M = 6_371_008.8
#: Degrees of latitude of a group of slabs, and of the cells that points without a zone near are told by.
BAND = 1.0
#: Zones of one decomposition, and the zones that its trapezoids may list altogether; zones beyond make further ones, which
#: each point is also looked up in.
ZONES, MEMBERS = 512, 2_000_000
#: Zones are widened by this share of their radius for the search; the distance itself decides.
SLACK = 1e-6


def distance_m(lat1, lon1, lat2, lon2):
    """Great-circle distance (haversine) of arrays in degrees."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h)))


class Slabs:
    """The decomposition of zones (arrays of id, degrees and metres) between two latitudes."""

    def __init__(self, ids, lat, lon, radius_m, bottom=-90.0, top=90.0):
        ok = np.isfinite(lat) & np.isfinite(lon) & np.isfinite(radius_m) & (np.abs(lat) <= 90) & (radius_m >= 0)
        self.ids, self.lat, self.lon, self.radius = ids[ok], lat[ok], (lon[ok] + 180) % 360 - 180, radius_m[ok]
        ang = np.minimum(self.radius / EARTH_M * (1 + SLACK) + 1e-12, np.pi)
        self.sin_lat, self.cos_lat, self.cos_ang = np.sin(np.radians(self.lat)), np.cos(np.radians(self.lat)), np.cos(ang)
        south, north = self.lat - np.degrees(ang), self.lat + np.degrees(ang)
        # over a pole, a zone reaches the parallels up to the one on the far side
        low, high = np.where(north > 90, np.minimum(south, 180 - north), south), np.where(south < -90, np.maximum(north, -180 - south), north)
        south, north = np.maximum(low, -90), np.minimum(high, 90)
        polar = (self.lat + np.degrees(ang) > 90) | (self.lat - np.degrees(ang) < -90)
        turn = np.concatenate([np.where(self.lat + np.degrees(ang) > 90, 180 - (self.lat + np.degrees(ang)), 0), np.where(self.lat - np.degrees(ang) < -90, -180 - (self.lat - np.degrees(ang)), 0)])
        self.south, self.north = south, north
        cuts = np.unique(np.concatenate([south, north, turn[np.concatenate([polar, polar])], self._crossings(), [bottom, top]]))
        self.cuts = cuts[(cuts >= bottom) & (cuts <= top)]
        mid = (self.cuts[1:] + self.cuts[:-1]) / 2
        held = np.searchsorted(np.sort(south), mid) - np.searchsorted(np.sort(north), mid)
        #: At most how many zones the trapezoids list.
        self.size = int((held * (2 * held + 1)).sum())
        # degrees of longitude that no zone lies further away than, from the middle of them
        self.middle = float(np.median(self.lon)) if len(self.lon) else 0.0
        with np.errstate(invalid="ignore"):
            wide = np.where(np.abs(self.lat) + np.degrees(ang) >= 90, 180, np.degrees(np.arcsin(np.minimum(np.sin(ang) / np.maximum(self.cos_lat, 1e-12), 1))))
        self.reach = float((np.abs((self.lon - self.middle + 180) % 360 - 180) + wide).max()) + 1e-6 if len(self.lon) else -1.0
        if self.size <= MEMBERS or len(self.ids) == 1:
            self._build()

    def half(self, zone, lat_deg):
        """Half the width in degrees of longitude that each zone has at a latitude."""
        phi = np.radians(lat_deg)
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (self.cos_ang[zone] - np.sin(phi) * self.sin_lat[zone]) / (np.cos(phi) * self.cos_lat[zone])
        return np.degrees(np.arccos(np.clip(np.nan_to_num(c, nan=-1.0, posinf=1.0, neginf=-1.0), -1, 1)))

    def _crossings(self):
        """Latitudes at which the boundaries of two zones cross. Pairs come from a sweep over latitude."""
        order, found = np.argsort(self.south, kind="stable"), []
        south, north = self.south[order], self.north[order]
        xyz = np.stack([self.cos_lat * np.cos(np.radians(self.lon)), self.cos_lat * np.sin(np.radians(self.lon)), self.sin_lat], 1)
        for k in range(len(order)):
            j = order[k + 1 : np.searchsorted(south, north[k], side="right")]
            i = order[k]
            d = xyz[j] @ xyz[i]
            angle = np.arccos(np.clip(d, -1, 1))
            a, b = np.arccos(self.cos_ang[i]), np.arccos(self.cos_ang[j])
            j = j[(angle < a + b) & (angle > np.abs(a - b)) & (1 - d * d > 1e-18)]
            if not len(j):
                continue
            d = (xyz[j] @ xyz[i])[:, None]
            u, v = (self.cos_ang[i] - d * self.cos_ang[j][:, None]) / (1 - d * d), (self.cos_ang[j][:, None] - d * self.cos_ang[i]) / (1 - d * d)
            mid = u * xyz[i] + v * xyz[j]
            n = np.cross(np.broadcast_to(xyz[i], mid.shape), xyz[j])
            t = np.sqrt(np.maximum(0, (1 - (mid**2).sum(1)) / (n**2).sum(1)))[:, None]
            found += [np.degrees(np.arcsin(np.clip((mid + s * t * n)[:, 2], -1, 1))) for s in (1, -1)]
        return np.concatenate(found) if found else np.empty(0)

    def _build(self):
        starts, zones, sides, shifts, tops, members, whole_at = [0], [], [], [], [0], [], []
        order = np.argsort(self.south, kind="stable")
        for s in range(len(self.cuts) - 1):
            mid = (self.cuts[s] + self.cuts[s + 1]) / 2
            z = order[: np.searchsorted(self.south[order], mid)]
            z = z[self.north[z] > mid]
            half = self.half(z, mid)
            whole, cut = z[half >= 180], z[half < 180]
            # a zone over the line of 180 degrees also lies 360 degrees further
            z3 = np.concatenate([cut, cut, cut])
            shift = np.repeat([-360.0, 0.0, 360.0], len(cut))
            half = self.half(z3, mid)
            near = (self.lon[z3] + shift + half >= -180.5) & (self.lon[z3] + shift - half <= 180.5)
            z3, shift, half = z3[near], shift[near], half[near]
            edge = np.concatenate([self.lon[z3] + shift - half, self.lon[z3] + shift + half])
            by = np.argsort(edge, kind="stable")
            zone, side, sh = np.tile(z3, 2)[by], np.repeat([-1, 1], len(z3))[by], np.tile(shift, 2)[by]
            inside = list(whole)
            for k in range(len(by) + 1):  # the trapezoids of the slab, from west to east
                members.extend(inside)
                tops.append(len(members))
                if k < len(by):
                    inside.append(zone[k]) if side[k] < 0 else inside.remove(zone[k])
            zones.append(zone), sides.append(side), shifts.append(sh)
            starts.append(starts[-1] + len(by))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        self.starts, self.zones, self.sides, self.shifts = np.array(starts), cat(zones, int), cat(sides, int), cat(shifts, float)
        self.tops, self.members = np.array(tops), np.array(members, dtype=int)

    def locate(self, lat, lon):
        """Pairs of point and zone (indexes) with the point in the zone."""
        lat, lon = np.asarray(lat, float), np.asarray(lon, float)
        p = np.flatnonzero((np.abs(lat) <= 90) & (np.abs(lon) <= 180) & (lat >= self.cuts[0]) & (lat <= self.cuts[-1]) & (np.abs((lon - self.middle + 180) % 360 - 180) <= self.reach))
        if not len(self.ids) or not len(p):
            return np.empty(0, int), np.empty(0, int)
        x, y = lon[p], lat[p]
        slab = np.clip(np.searchsorted(self.cuts, y, side="right") - 1, 0, len(self.cuts) - 2)
        first = self.starts[slab]
        lo, hi = first.copy(), self.starts[slab + 1].copy()
        while True:  # all points at once: the first edge east of each
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            m = (lo[open_] + hi[open_]) // 2
            e = self.lon[self.zones[m]] + self.shifts[m] + self.sides[m] * self.half(self.zones[m], y[open_])
            west = e <= x[open_]
            lo[open_], hi[open_] = np.where(west, m + 1, lo[open_]), np.where(west, hi[open_], m)
        trap = lo + slab  # each slab has one trapezoid more than edges
        n = self.tops[trap + 1] - self.tops[trap]
        point = np.repeat(np.arange(len(p)), n)
        member = self.members[np.repeat(self.tops[trap] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        near = distance_m(y[point], x[point], self.lat[member], self.lon[member]) <= self.radius[member]
        return p[point[near]], member[near]


def decompositions(ids, lat, lon, radius_m, low=-90.0, high=90.0, zones=ZONES) -> Iterator[Slabs]:
    """Zones in as many decompositions as their bounds ask for, neighbours in longitude together."""
    order = np.argsort(lon, kind="stable")
    todo = [order[k : k + zones] for k in range(0, len(order), zones)]
    while todo:
        part = todo.pop()
        slabs = Slabs(ids[part], lat[part], lon[part], radius_m[part], low, high)
        if slabs.size > MEMBERS and len(part) > 1:
            todo += [part[: len(part) // 2], part[len(part) // 2 :]]
        elif len(slabs.ids):
            yield slabs


def _bands(low: Column, high: Column) -> Column:
    """The groups of slabs from one latitude to another."""
    number = lambda c: F.least(F.greatest(F.floor((c + 90) / BAND), F.lit(0)), F.lit(int(180 / BAND) - 1)).cast("int")
    return F.sequence(number(low), number(high))


def points_in_zones(points: DataFrame, key: Column, lat: Column, lon: Column, zones: DataFrame, zone_id: str, salts: int | None = None) -> DataFrame:
    """Each pair of a point and a zone whose circle holds it: ``key`` and the zone's id.

    zones: columns zone_id (BIGINT), ``lat``, ``lon``, ``radius_m``. Points without a position, or beyond 90 or 180
    degrees, lie in none; equal points and overlapping zones give a row for each pair, an empty side none. Zones with a
    null in any column, beyond 90 degrees, or of a negative radius hold nothing.

    Points that share no cell of a degree with any zone leave first, by a broadcast of the cells with zones, of which the
    globe has 64,800. The others are shuffled once to the slabs of their latitude; a hot latitude is split by ``salts``, and
    its zones go to each of its tasks. A task holds the zones of one group of slabs, in decompositions of bounded size.
    """
    spark = points.sparkSession
    ship(spark)
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    flat = points.select(key.cast("long").alias("key"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).where("abs(lat) <= 90 AND abs(lon) <= 180")
    ang = F.least(F.degrees(F.col("radius_m") / EARTH_M * (1 + 1e-5)) + 1e-6, F.lit(180.0))
    z = zones.select(F.col(zone_id).cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "radius_m")]).dropna().where("abs(lat) <= 90 AND radius_m >= 0")
    over, under = F.col("lat") + F.col("ang") > 90, F.col("lat") - F.col("ang") < -90  # a pole lies within
    low = F.when(over, F.least(F.col("lat") - F.col("ang"), 180 - F.col("lat") - F.col("ang"))).otherwise(F.col("lat") - F.col("ang"))
    high = F.when(under, F.greatest(F.col("lat") + F.col("ang"), -180 - F.col("lat") + F.col("ang"))).otherwise(F.col("lat") + F.col("ang"))
    wide = F.when(over | under, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(F.radians("ang")) / F.cos(F.radians("lat")), F.lit(1.0)))))
    z = z.withColumn("ang", ang).withColumns({"wide": wide, "band": F.explode(_bands(low, high))}).drop("ang")
    cell = lambda c: F.floor((c + 180) / BAND).cast("int")
    round_ = int(360 / BAND)
    cells = z.select("band", F.explode(F.sequence(cell(F.col("lon") - F.col("wide") - 1e-6), cell(F.col("lon") + F.col("wide") + 1e-6))).alias("cell"))
    cells = cells.select("band", F.pmod("cell", F.lit(round_)).alias("cell")).distinct()  # at most 64,800
    near = flat.withColumns({"band": _bands(F.col("lat"), F.col("lat"))[0], "cell": F.pmod(cell(F.col("lon")), F.lit(round_))}).join(F.broadcast(cells), ["band", "cell"], "left_semi")
    group = lambda salt: (F.col("band") * salts + salt).alias("slabs")
    moving = near.select(group(F.pmod(F.xxhash64("key", "lat", "lon"), F.lit(salts)).cast("int")), "key", "lat", "lon", F.lit(None).cast("double").alias("radius_m"))
    held = z.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(group(F.col("salt")), "key", "lat", "lon", "radius_m")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, slabs = None, [], None
        for x in batches:
            g = x.column("slabs").to_numpy()
            ids, rows = x.column("key"), [x.column(n).to_numpy(zero_copy_only=False) for n in ("lat", "lon", "radius_m")]
            bounds = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            points, hits = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if g[a] != at:
                    at, parts, slabs = g[a], [], None
                m = a + int(np.count_nonzero(np.isfinite(rows[2][a:b])))  # zones come first
                if m > a:
                    parts.append([ids.slice(a, m - a).to_numpy(), *[r[a:m] for r in rows]])
                if m == b or not parts:
                    continue
                if slabs is None:
                    low = (at // salts) * BAND - 90
                    slabs = list(decompositions(*[np.concatenate(p) for p in zip(*parts)], low, low + BAND))
                for s in slabs:
                    p, z = s.locate(rows[0][m:b], rows[1][m:b])
                    if len(p):
                        points.append(p + m)
                        hits.append(s.ids[z])
            if points:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(points))), pa.array(np.concatenate(hits).astype(np.int64))], names=["key", "zone"])

    both = held.unionByName(moving).repartition("slabs").sortWithinPartitions("slabs", F.col("radius_m").desc_nulls_last())
    return both.mapInArrow(find, "key BIGINT, zone BIGINT").withColumnRenamed("zone", zone_id)
