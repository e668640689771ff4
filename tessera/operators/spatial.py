"""Plane geometry on struct<x, y> points and array<struct<x, y>> rings, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10
EARTH_M = 6_371_000.0
RING = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    as_ = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_(x).cast("double").alias("x"), as_(y).cast("double").alias("y"))


def parse_point(wkt: Column) -> Column:
    """POINT(x y); NULL for anything else."""
    n = r"(-?\d+(?:\.\d+)?)"
    rx = rf"(?i)^\s*POINT\s*\(\s*{n}\s+{n}\s*\)\s*$"
    return F.when(wkt.rlike(rx), point(F.regexp_extract(wkt, rx, 1).try_cast("double"), F.regexp_extract(wkt, rx, 2).try_cast("double")))


def parse_polygon(wkt: Column) -> Column:
    """The outer ring of POLYGON((x y, ...)); NULL for anything else."""
    body = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)", 1)
    pairs = F.transform(F.split(body, ","), lambda p: F.split(F.trim(p), r"\s+"))
    ring = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    return F.when((body != "") & F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), ring)


def st_distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def _sides(ring: Column) -> Column:
    """Each corner with the next, the last with the first."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def in_box(p: Column, ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda c: c["x"]), F.transform(ring, lambda c: c["y"])
    return p["x"].between(F.array_min(xs), F.array_max(xs)) & p["y"].between(F.array_min(ys), F.array_max(ys))


def st_within(p: Column, ring: Column) -> Column:
    """Whether p lies in the ring: bounding box first, then ray casting. False for fewer than three corners, NULL for a NULL."""
    crosses = F.filter(_sides(ring), lambda s: ((s["p"]["y"] > p["y"]) != (s["q"]["y"] > p["y"])) & (p["x"] < (s["q"]["x"] - s["p"]["x"]) * (p["y"] - s["p"]["y"]) / F.nullif(s["q"]["y"] - s["p"]["y"], F.lit(0.0)) + s["p"]["x"]))
    inside = F.when(F.size(ring) < 3, False).when(~in_box(p, ring), False).otherwise(F.pmod(F.size(crosses), F.lit(2)) == 1)
    return F.when(p.isNotNull() & ring.isNotNull(), inside)


def st_contains(ring: Column, p: Column) -> Column:
    return st_within(p, ring)


def st_intersects_points(a: Column, b: Column) -> Column:
    return (F.abs(a["x"] - b["x"]) < EPS) & (F.abs(a["y"] - b["y"]) < EPS)


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def st_intersects(a: Column, b: Column) -> Column:
    """Whether two rings share a point: a side crosses a side, or one holds a corner of the other."""
    cross = F.exists(_sides(a), lambda s: F.exists(_sides(b), lambda t: (_turn(s["p"], s["q"], t["p"]) * _turn(s["p"], s["q"], t["q"]) <= 0) & (_turn(t["p"], t["q"], s["p"]) * _turn(t["p"], t["q"], s["q"]) <= 0) & _boxes_meet(s, t)))
    return F.when(a.isNotNull() & b.isNotNull(), cross | st_within(F.get(b, F.lit(0)), a) | st_within(F.get(a, F.lit(0)), b))


def _boxes_meet(s: Column, t: Column) -> Column:
    lo, hi = lambda u, c: F.least(u["p"][c], u["q"][c]), lambda u, c: F.greatest(u["p"][c], u["q"][c])
    return (lo(s, "x") <= hi(t, "x")) & (lo(t, "x") <= hi(s, "x")) & (lo(s, "y") <= hi(t, "y")) & (lo(t, "y") <= hi(s, "y"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
