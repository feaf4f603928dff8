"""Geometry as Column expressions over ``array<struct<lat,lon>>`` paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: earth radius in metres.
EARTH_M = 6371000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = map(_c, (lat1, lon1, lat2, lon2))
    s = F.sin(F.radians(a2 - a1) / 2)
    t = F.sin(F.radians(o2 - o1) / 2)
    h = s * s + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * t * t
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(h))


def along(a: Column, b: Column, t: Column) -> Column:
    """The point a fraction ``t`` of the way from ``a`` to ``b``."""
    return F.struct((a["lat"] + (b["lat"] - a["lat"]) * t).alias("lat"),
                    (a["lon"] + (b["lon"] - a["lon"]) * t).alias("lon"))


def point_to_segment(plat: Column, plon: Column, alat: Column, alon: Column,
                     blat: Column, blon: Column) -> Column:
    """struct(d, t): metres from a point to a segment, and the clamped foot in [0, 1].

    Works in metres east and north of the segment's start, scaled at its mid-latitude.
    """
    k = F.cos(F.radians((alat + blat) / 2)) * EARTH_M
    dx, dy = F.radians(blon - alon) * k, F.radians(blat - alat) * EARTH_M
    px, py = F.radians(plon - alon) * k, F.radians(plat - alat) * EARTH_M
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / size)))
    return _bind(t, lambda u: F.struct(
        F.sqrt((px - u * dx) * (px - u * dx) + (py - u * dy) * (py - u * dy)).alias("d"),
        u.alias("t")))


def segments(path) -> Column:
    """Consecutive point pairs of a path as array<struct<a,b>>."""
    p = _c(path)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    return F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def path_length_m(path) -> Column:
    return F.aggregate(segments(path), F.lit(0.0), lambda s, g: s + haversine_m(
        g["a"]["lat"], g["a"]["lon"], g["b"]["lat"], g["b"]["lon"]))


def bounding_box(path) -> Column:
    p = _c(path)
    lats, lons = F.transform(p, lambda q: q["lat"]), F.transform(p, lambda q: q["lon"])
    return F.struct(F.array_min(lats).alias("min_lat"), F.array_min(lons).alias("min_lon"),
                    F.array_max(lats).alias("max_lat"), F.array_max(lons).alias("max_lon"))


def locate_on_path(path, length_m, plat, plon) -> Column:
    """struct(distance, fraction) of a point against a path.

    The first of equally near segments wins. No path is infinitely far; a single point
    sits at fraction 0; a missing or zero length falls back to the summed segments.
    """
    p, length, la, lo = map(_c, (path, length_m, plat, plon))

    def measured(g):
        hit = point_to_segment(la, lo, g["a"]["lat"], g["a"]["lon"],
                               g["b"]["lat"], g["b"]["lon"])
        size = haversine_m(g["a"]["lat"], g["a"]["lon"], g["b"]["lat"], g["b"]["lon"])
        return F.struct(hit.alias("hit"), size.alias("size"))

    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("at"),
                     F.lit(0.0).alias("done"))

    def nearer(acc, m):
        better = m["hit"]["d"] < acc["d"]
        return F.struct(
            F.when(better, m["hit"]["d"]).otherwise(acc["d"]).alias("d"),
            F.when(better, acc["done"] + m["hit"]["t"] * m["size"]).otherwise(acc["at"]).alias("at"),
            (acc["done"] + m["size"]).alias("done"))

    def finish(acc):
        total = F.coalesce(F.nullif(length.cast("double"), F.lit(0.0)), acc["done"])
        f = F.when(total > 0, acc["at"] / total).otherwise(F.lit(0.0))
        return F.struct(acc["d"].alias("distance"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)).alias("fraction"))

    n = F.coalesce(F.size(p), F.lit(0))
    first = F.try_element_at(p, F.lit(1))
    return (F.when(p.isNull() | (n < 1), F.struct(F.lit(float("inf")).alias("distance"),
                                                  F.lit(0.0).alias("fraction")))
            .when(n < 2, F.struct(haversine_m(la, lo, first["lat"], first["lon"]).alias("distance"),
                                  F.lit(0.0).alias("fraction")))
            .otherwise(F.aggregate(F.transform(segments(p), measured), start, nearer, finish)))


def slice_path(path, start_f, end_f) -> Column:
    """The part of a path between two fractions of its length, cut exactly on the line."""
    p, s, e = map(_c, (path, start_f, end_f))
    lo = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    hi = F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))
    nothing = F.slice(p, F.lit(1), F.lit(0))

    lengths = F.transform(segments(p), lambda g: haversine_m(
        g["a"]["lat"], g["a"]["lon"], g["b"]["lat"], g["b"]["lon"]))

    def cut(ms):
        total = F.aggregate(ms, F.lit(0.0), lambda acc, m: acc + m)
        return _bind(total, lambda whole: F.when(whole > 0, _bind(
            F.aggregate(ms, _uncut(), lambda acc, m: _walk(acc, m, lo * whole, hi * whole)), ridden))
            .otherwise(F.slice(p, F.lit(1), F.lit(1))))

    def ridden(w):
        """From the cut in segment ``first`` over the points between to that in ``last``."""
        points = F.concat(
            F.array(_on_segment(p, w["first"], F.when(lo > 0, w["first_t"]).otherwise(0.0))),
            F.slice(p, w["first"] + 1, w["last"] - w["first"]),
            F.array(_on_segment(p, w["last"], F.when(hi < 1, w["last_t"]).otherwise(1.0))))
        return _bind(points, lambda pts: F.filter(
            pts, lambda q, i: (i == 0) | (q != F.try_element_at(pts, F.greatest(i, F.lit(1))))))

    return (F.when(p.isNull(), F.lit(None))
            .when(F.size(p) < 2, p)
            .when((s <= 0) & (e >= 1), p)
            .when(hi <= lo, nothing)
            .otherwise(_bind(lengths, cut)))


def _uncut() -> Column:
    """Metres and segments walked, and the segments that hold the two cuts (0: not met yet)."""
    return F.struct(F.lit(0.0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("first"),
                    F.lit(0.0).alias("first_t"), F.lit(0).alias("last"), F.lit(0.0).alias("last_t"))


def _walk(acc: Column, m: Column, low: Column, high: Column) -> Column:
    """One segment of ``m`` metres further: is it the first that reaches ``low``, is it the
    last that begins by ``high``?"""
    at, n = acc["at"], acc["n"] + 1
    opens = (m > 0) & (acc["first"] == 0) & (at + m >= low)
    closes = (m > 0) & (at <= high)
    return F.struct(
        (at + m).alias("at"), n.alias("n"),
        F.when(opens, n).otherwise(acc["first"]).alias("first"),
        F.when(opens, (low - at) / m).otherwise(acc["first_t"]).alias("first_t"),
        F.when(closes, n).otherwise(acc["last"]).alias("last"),
        F.when(closes, (high - at) / m).otherwise(acc["last_t"]).alias("last_t"))


def _on_segment(p: Column, n: Column, t: Column) -> Column:
    """The point at ``t`` of segment ``n``; its own ends at 0 and below, 1 and above."""
    a, b = F.element_at(p, n), F.element_at(p, n + 1)
    return F.when(t <= 0, a).when(t >= 1, b).otherwise(along(a, b, t))


def join_paths(paths) -> Column:
    """One path from an array of paths, without repeating the shared joints."""
    ps = _c(paths)
    empty = F.slice(F.element_at(ps, 1), F.lit(1), F.lit(0))

    def add(acc, p):
        same = (F.size(acc) > 0) & (F.size(p) > 0) & (
            F.try_element_at(acc, F.lit(-1)) == F.try_element_at(p, F.lit(1)))
        tail = F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
        return F.concat(acc, F.when(same, tail).otherwise(p))

    return F.when(F.size(ps) > 0, F.aggregate(ps, empty, add))
