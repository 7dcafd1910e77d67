"""Geometry as column expressions: distances, an equal-area projection, WKT, and polygon predicates.

A geometry is a column of rings, array<array<struct<x double, y double>>>, with its
type beside it; the first ring of a part winds around it and holes follow the
even-odd rule, so multi-part shapes are one list of rings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088
EARTH_KM_NRT = 6371.0
RINGS = "array<array<struct<x:double,y:double>>>"

# WGS84 and the Albers parameters of the working projection.
_A, _E2 = 6378137.0, 0.00669437999014
_E = math.sqrt(_E2)
_PHI1, _PHI2, _PHI0, _LAM0 = (math.radians(d) for d in (8.0, 37.0, 22.0, 82.0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


_N = (_m(_PHI1) ** 2 - _m(_PHI2) ** 2) / (_q(_PHI2) - _q(_PHI1))
_C = _m(_PHI1) ** 2 + _N * _q(_PHI1)
_RHO0 = _A * math.sqrt(_C - _N * _q(_PHI0)) / _N


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of the projection's origin."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = _A * F.sqrt(_C - _N * q) / _N
    theta = _N * (F.radians(lon) - _LAM0)
    return rho * F.sin(theta), F.lit(_RHO0) - rho * F.cos(theta)


def projected(rings: Column) -> Column:
    def one(p: Column) -> Column:
        x, y = albers(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, one))


def point_rings(lon: Column, lat: Column) -> Column:
    return F.array(F.array(F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))))


def box_rings(west: Column, south: Column, east: Column, north: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south)))


def wkt_type(wkt: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.trim(wkt), r"^\s*([A-Za-z]+)", 1)), F.lit(""))


def parse_wkt(wkt: Column) -> Column:
    """Rings of a POINT, MULTIPOINT, LINESTRING, POLYGON or MULTIPOLYGON; NULL otherwise."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    pair = lambda t: F.split(F.trim(t), r"\s+")
    point = lambda t: F.struct(F.get(pair(t), F.lit(0)).try_cast("double").alias("x"), F.get(pair(t), F.lit(1)).try_cast("double").alias("y"))
    parsed = F.transform(rings, lambda r: F.transform(F.split(r, ","), point))
    sound = (F.size(parsed) > 0) & F.forall(parsed, lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.when(wkt_type(wkt).isin("POINT", "MULTIPOINT", "LINESTRING", "POLYGON", "MULTIPOLYGON") & sound, parsed)


def areal_type(kind: Column) -> Column:
    """Whether a geometry type is that of polygons. Not by upper(): Spark tries all code points (3.5 GB of garbage) where that is first met, which for a constant is the driver."""
    return kind.rlike(r"(?i)\A(multi)?polygon\z")


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def emit_wkt(kind: Column, rings: Column) -> Column:
    text = F.transform(rings, lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit(")")))
    return F.when(kind == "POLYGON", F.concat(F.lit("POLYGON ("), F.array_join(text, ", "), F.lit(")"))).otherwise(F.concat(kind, F.lit(" "), F.get(text, F.lit(0))))


def edges(rings: Column) -> Column:
    """All edges, as structs of both ends; a ring of one point gives a point edge."""
    per_ring = F.transform(rings, lambda r: F.when(F.size(r) == 1, F.array(_edge(F.get(r, F.lit(0)), F.get(r, F.lit(0))))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))), lambda i: _edge(F.get(r, i), F.get(r, i + 1)))))
    return F.flatten(per_ring)


def _edge(a: Column, b: Column) -> Column:
    return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def point_edge_distance(px: Column, py: Column, e: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["ax"]) * dx + (py - e["ay"]) * dy) / F.when(n == 0, F.lit(1.0)).otherwise(n))))
    return F.sqrt(F.pow(px - e["ax"] - t * dx, F.lit(2)) + F.pow(py - e["ay"] - t * dy, F.lit(2)))


def inside(px: Column, py: Column, es: Column, areal: Column) -> Column:
    """Even-odd rule over edges; boundary points are decided separately by their distance."""
    crosses = lambda e: ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.when(e["by"] == e["ay"], F.lit(1.0)).otherwise(e["by"] - e["ay"]) + e["ax"])
    return areal & (F.pmod(F.size(F.filter(es, crosses)), F.lit(2)) == 1)


def distance(px: Column, py: Column, es: Column, areal: Column) -> Column:
    """From a point to a geometry; 0 inside it."""
    return F.when(inside(px, py, es, areal), F.lit(0.0)).otherwise(F.array_min(F.transform(es, lambda e: point_edge_distance(px, py, e))))


def edges_cross(e: Column, f: Column) -> Column:
    side = lambda ax, ay, bx, by, cx, cy: F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    d1 = side(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"])
    d2 = side(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    d3 = side(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"])
    d4 = side(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
    touch = (point_edge_distance(e["ax"], e["ay"], f) == 0) | (point_edge_distance(e["bx"], e["by"], f) == 0) | (point_edge_distance(f["ax"], f["ay"], e) == 0) | (point_edge_distance(f["bx"], f["by"], e) == 0)
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | touch


def intersects(es: Column, e_areal: Column, fs: Column, f_areal: Column) -> Column:
    """Whether two geometries share a point: edges that meet, or one inside the other."""
    first = lambda a: F.get(a, F.lit(0))
    return F.exists(es, lambda e: F.exists(fs, lambda f: edges_cross(e, f))) | inside(first(es)["ax"], first(es)["ay"], fs, f_areal) | inside(first(fs)["ax"], first(fs)["ay"], es, e_areal)


def area(es: Column) -> Column:
    """Shoelace area of the rings behind the edges (holes wound against their shell subtract)."""
    return F.abs(F.aggregate(es, F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2))


def centroid(es: Column, areal: Column) -> tuple[Column, Column]:
    """Area centroid of polygons; mean of edge starts otherwise."""
    twice = F.aggregate(es, F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])
    sum_of = lambda k: F.aggregate(es, F.lit(0.0), lambda s, e: s + (e[f"a{k}"] + e[f"b{k}"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"]))
    mean = lambda k: F.aggregate(es, F.lit(0.0), lambda s, e: s + e[f"a{k}"]) / F.size(es)
    use = areal & (twice != 0)
    safe = F.when(twice == 0, F.lit(1.0)).otherwise(twice)
    return F.when(use, sum_of("x") / (3 * safe)).otherwise(mean("x")), F.when(use, sum_of("y") / (3 * safe)).otherwise(mean("y"))


def cells(west: Column, south: Column, east: Column, north: Column, size: float) -> Column:
    """Grid cells (struct cx, cy) that a box covers."""
    to = lambda v: F.floor(v / size).cast("long")
    return F.flatten(F.transform(F.sequence(to(west), to(east)), lambda x: F.transform(F.sequence(to(south), to(north)), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def raster_cell(x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Row and column of a north-up raster with its upper left corner at (x0, y0)."""
    return F.floor((F.lit(y0) - y) / dy).cast("int"), F.floor((x - x0) / dx).cast("int")


def degrees_for_km(km: float, lat: Column) -> tuple[Column, Column]:
    """(latitude, longitude) half-widths of a search box."""
    return F.lit(km / 111.0), km / (111.0 * F.greatest(F.cos(F.radians(lat)), F.lit(0.2)))
