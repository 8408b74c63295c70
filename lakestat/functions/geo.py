"""Vector geometry on rings, arrays of (lon, lat) points in degrees on WGS84, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 spheroid and the standard parallel of the equal-area projection.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
UTM_SCALE, UTM_EASTING, UTM_NORTHING_SOUTH = 0.9996, 500000.0, 10000000.0


def valid_ring(ring: Column, in_range: bool = True) -> Column:
    """At least 4 points, closed, and (unless switched off) within longitude and latitude."""
    closed = F.element_at(ring, 1) == F.element_at(ring, -1)
    ok = (F.size(ring) >= 4) & F.when(F.size(ring) > 0, closed)
    if in_range:
        ok = ok & F.forall(ring, lambda p: p["lon"].between(-180, 180) & p["lat"].between(-90, 90))
    return F.coalesce(ok, F.lit(False))


def valid_polygon(rings: Column, in_range: bool = True) -> Column:
    """One valid ring and no other."""
    return F.coalesce((F.size(rings) == 1) & F.when(F.size(rings) > 0, valid_ring(F.element_at(rings, 1), in_range)), F.lit(False))


def _equal_area_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E))
    return A * q / (2 * K0)


def shoelace(points: Column) -> Column:
    """Signed area of a closed ring of (x, y) points, relative to its first point."""
    x0, y0 = points[0]["x"], points[0]["y"]
    at = F.when(F.size(points) >= 2, F.sequence(F.lit(0), F.size(points) - 2))
    each = F.transform(at, lambda i: (F.get(points, i)["x"] - x0) * (F.get(points, i + 1)["y"] - y0) - (F.get(points, i + 1)["x"] - x0) * (F.get(points, i)["y"] - y0))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2


def area_km2(ring: Column) -> Column:
    """Area on the spheroid, by a cylindrical equal-area projection."""
    flat = F.transform(ring, lambda p: F.struct((A * K0 * F.radians(p["lon"])).alias("x"), _equal_area_y(p["lat"]).alias("y")))
    return F.abs(shoelace(flat)) / 1e6


def area_deg2(ring: Column) -> Column:
    """Planar area in square degrees."""
    return F.abs(shoelace(F.transform(ring, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))))


def bounds(ring: Column) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax."""
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return {"xmin": F.array_min(lon), "ymin": F.array_min(lat), "xmax": F.array_max(lon), "ymax": F.array_max(lat)}


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether the point is inside: an odd number of edges to its right."""
    at = F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2))

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        edge_x = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < edge_x), F.lit(False))

    return F.coalesce(F.size(F.filter(at, crosses)) % 2 == 1, F.lit(False))


def touches(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a box shares a point with a polygon: its middle is inside, or an edge passes through it.

    An edge is held against the box's two slabs: the parts of it within each must overlap.
    """
    at = F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2))

    def span(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = F.nullif(b - a, F.lit(0.0))
        enter, leave = F.least((low - a) / d, (high - a) / d), F.greatest((low - a) / d, (high - a) / d)
        flat_in = a.between(low, high)
        return F.coalesce(enter, F.when(flat_in, 0.0).otherwise(2.0)), F.coalesce(leave, F.when(flat_in, 1.0).otherwise(-1.0))

    def meets(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        (in_x, out_x), (in_y, out_y) = span(a["lon"], b["lon"], x0, x1), span(a["lat"], b["lat"], y0, y1)
        return F.greatest(in_x, in_y, F.lit(0.0)) <= F.least(out_x, out_y, F.lit(1.0))

    return contains(ring, (x0 + x1) / 2, (y0 + y1) / 2) | F.coalesce(F.exists(at, meets), F.lit(False))


def _radii(lat: Column) -> tuple[Column, Column]:
    """Metres per radian of latitude and of longitude."""
    s = F.sin(F.radians(lat))
    w = 1 - E2 * s * s
    return A * (1 - E2) / F.pow(w, F.lit(1.5)), A / F.sqrt(w) * F.cos(F.radians(lat))


def point_distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between near points, with the spheroid's radii at the middle latitude."""
    north, east = _radii((lat1 + lat2) / 2)
    return F.hypot(F.radians(lat2 - lat1) * north, F.radians(lon2 - lon1) * east)


def distance_m(ring: Column, lon: Column, lat: Column) -> Column:
    """Metres from a point to a polygon, 0 inside: the nearest point of each edge in the local plane, measured again.

    In steps over arrays of structs, so that nothing is worked out twice: an expression that is used several times
    within a lambda is evaluated as often.
    """
    at = F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2))

    def edges(p: Column) -> Column:
        def in_plane(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, i + 1)
            flat = {"ax": F.radians(a["lon"] - p["lon"]) * p["east"], "ay": F.radians(a["lat"] - p["lat"]) * p["north"], "dx": F.radians(b["lon"] - a["lon"]) * p["east"], "dy": F.radians(b["lat"] - a["lat"]) * p["north"]}
            return F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), a.alias("a"), b.alias("b"), *[c.alias(k) for k, c in flat.items()])

        return F.transform(at, in_plane)

    def along(e: Column) -> Column:
        t = F.coalesce(-(e["ax"] * e["dx"] + e["ay"] * e["dy"]) / F.nullif(e["dx"] * e["dx"] + e["dy"] * e["dy"], F.lit(0.0)), F.lit(0.0))
        return F.struct(e["lon"].alias("lon"), e["lat"].alias("lat"), e["a"].alias("a"), e["b"].alias("b"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)).alias("t"))

    def foot(e: Column) -> Column:
        on = {c: e["a"][c] + e["t"] * (e["b"][c] - e["a"][c]) for c in ("lon", "lat")}
        return F.struct(e["lon"].alias("lon"), e["lat"].alias("lat"), on["lon"].alias("x"), on["lat"].alias("y"))

    def curved(q: Column) -> Column:
        middle = (q["lat"] + q["y"]) / 2
        return F.struct(F.radians(q["y"] - q["lat"]).alias("up"), F.radians(q["x"] - q["lon"]).alias("across"), F.sin(F.radians(middle)).alias("s"), F.cos(F.radians(middle)).alias("c"))

    def metres(q: Column) -> Column:
        w = 1 - E2 * q["s"] * q["s"]
        return F.hypot(q["up"] * (A * (1 - E2) / F.pow(w, F.lit(1.5))), q["across"] * (A / F.sqrt(w) * q["c"]))

    north, east = _radii(lat)
    point = F.array(F.struct(lon.alias("lon"), lat.alias("lat"), north.alias("north"), east.alias("east")))
    found = F.flatten(F.transform(point, edges))
    for step in (along, foot, curved, metres):
        found = F.transform(found, step)
    return F.when(contains(ring, lon, lat), 0.0).otherwise(F.array_min(found))


def wkt(ring: Column) -> Column:
    """POLYGON text, ``lon lat`` points separated by commas."""
    points = F.transform(ring, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(points, ", "), F.lit("))"))


def geojson(ring: Column) -> Column:
    """GeoJSON text of a polygon with one ring."""
    points = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")))


def largest_part(parts: Column) -> Column:
    """Of the rings of a multipolygon that with the largest equal-area extent; the first of equal ones."""
    sized = F.transform(parts, lambda r, i: F.struct(area_km2(r).alias("area"), (-i).alias("place"), r.alias("ring")))
    return F.array_max(sized)["ring"]


# Coefficients of the transverse Mercator series, in the third flattening.
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def utm_zone(lon: Column) -> Column:
    """Number of the zone of a longitude."""
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    s = F.sin(F.radians(lat))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    lam = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return UTM_EASTING + UTM_SCALE * _RECTIFYING * x, UTM_SCALE * _RECTIFYING * y + F.when(south, UTM_NORTHING_SOUTH).otherwise(0.0)


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi0 = (y - F.when(south, UTM_NORTHING_SOUTH).otherwise(0.0)) / (UTM_SCALE * _RECTIFYING)
    eta0 = (x - UTM_EASTING) / (UTM_SCALE * _RECTIFYING)
    xi, eta = xi0, eta0
    for k, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - b * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for k, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * k * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)
