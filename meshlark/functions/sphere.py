"""Spherical measures and map projections as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6371008.8


def wrap(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return (((lon + 180) % 360) + 360) % 360 - 180


def vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def central_angle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    u, v = vector(lon1, lat1), vector(lon2, lat2)
    cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    dot = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    return F.atan2(F.sqrt(cross[0] ** 2 + cross[1] ** 2 + cross[2] ** 2), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = RADIUS) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.sin((q - p) / 2) ** 2 + F.cos(p) * F.cos(q) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


#: Robinson's published control values at every five degrees (fixed values).
ROBINSON_X = (1, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322)
ROBINSON_Y = (0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1)
MERCATOR_LIMIT = 85.05112878
#: Coefficients of the Equal Earth and Natural Earth polynomials (fixed published values), by ascending power.
EQUAL_EARTH = {1: 1.340264, 3: -0.081106, 7: 0.000893, 9: 0.003796}
NATURAL_X = {0: 0.8707, 2: -0.131979, 4: -0.013791, 10: 0.003971, 12: -0.001529}
NATURAL_Y = {1: 1.007226, 3: 0.015085, 7: -0.044475, 9: 0.028874, 11: -0.005916}

Pair = tuple[Column, Column]


def _polynomial(terms: dict[int, float], x: Column) -> Column:
    """Sum of terms[power] * x**power, from the highest power down."""
    out, last = F.lit(0.0), None
    for power in sorted(terms, reverse=True):
        if last is not None:
            out = out * F.pow(x, F.lit(float(last - power)))
        out, last = out + terms[power], power
    return out * F.pow(x, F.lit(float(last))) if last else out


def _pieces(values: tuple[float, ...]) -> list[list[float]]:
    """Coefficients (constant first) of a cubic for each step between control values: that through the four nearest, the step's own two in the middle where there are such."""
    out = []
    for band in range(len(values) - 1):
        first = min(max(band - 1, 0), len(values) - 4)
        places = np.arange(first, first + 4, dtype=float) - band
        out.append(np.linalg.solve(np.vander(places, increasing=True), np.array(values[first : first + 4], dtype=float)).tolist())
    return out


def _along(values: tuple[float, ...], at: Column) -> Column:
    """The control curve at a place between 0 and its last node."""
    table = _pieces(values)
    band = F.least(F.floor(at), F.lit(len(table) - 1)).cast("int")
    t, out = at - band, F.lit(0.0)
    for power in (3, 2, 1, 0):
        out = out * t + F.element_at(F.array(*[F.lit(c[power]) for c in table]), band + 1)
    return out


def _mollweide_angle(lat: Column) -> Column:
    """w with w + sin w = pi sin(lat): from the cube-root form near the poles or half the right side elsewhere, by Newton steps until they no longer move."""
    want = F.abs(math.pi * F.sin(F.radians(lat)))
    start = F.when(want > 2.5, math.pi - F.cbrt(6 * (math.pi - want))).otherwise(want / 2)
    better = lambda w: F.least(F.lit(math.pi), w + (want - w - F.sin(w)) / (1 + F.cos(w)))
    w = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, lambda w, _: F.when((1 + F.cos(w) < 1e-12) | (F.abs(want - w - F.sin(w)) < 1e-15), w).otherwise(better(w)))
    return F.signum(lat) * w


def _equirectangular(lon: Column, lat: Column) -> Pair:
    return F.radians(lon), F.radians(lat)


def _mercator(lon: Column, lat: Column) -> Pair:
    s = F.sin(F.radians(F.greatest(F.lit(-MERCATOR_LIMIT), F.least(F.lit(MERCATOR_LIMIT), lat))))
    return F.radians(lon), F.log((1 + s) / (1 - s)) / 2


def _mollweide(lon: Column, lat: Column) -> Pair:
    half = _mollweide_angle(lat) / 2
    return F.radians(lon) * F.cos(half) * math.sqrt(8) / math.pi, F.sin(half) * math.sqrt(2)


def _sinusoidal(lon: Column, lat: Column) -> Pair:
    return F.cos(F.radians(lat)) * F.radians(lon), F.radians(lat)


def _gall_peters(lon: Column, lat: Column) -> Pair:
    return F.radians(lon) * math.cos(math.pi / 4), F.sin(F.radians(lat)) / math.cos(math.pi / 4)


def _equal_earth(lon: Column, lat: Column) -> Pair:
    parametric = F.asin(F.sin(F.radians(lat)) * math.sqrt(0.75))
    slope = {power - 1: power * c for power, c in EQUAL_EARTH.items()}
    return F.radians(lon) * F.cos(parametric) / (math.sqrt(0.75) * _polynomial(slope, parametric)), _polynomial(EQUAL_EARTH, parametric)


def _natural_earth(lon: Column, lat: Column) -> Pair:
    return F.radians(lon) * _polynomial(NATURAL_X, F.radians(lat)), _polynomial(NATURAL_Y, F.radians(lat))


def _aitoff(lon: Column, lat: Column) -> Pair:
    """The equidistant hemisphere of half the longitudes, drawn out to double width."""
    x, y, z = vector(lon / 2, lat)
    off = F.sqrt(y * y + z * z)
    scale = F.when(off < 1e-15, 1.0).otherwise(F.atan2(off, x) / off)
    return 2 * scale * y, scale * z


def _cylinder(lon: Column, lat: Column) -> Pair:
    """Equirectangular with the standard parallel acos(2 / pi)."""
    return F.radians(lon) * (2 / math.pi), F.radians(lat)


def _winkel(lon: Column, lat: Column) -> Pair:
    return tuple((a + b) / 2 for a, b in zip(_aitoff(lon, lat), _cylinder(lon, lat), strict=True))


def _robinson(lon: Column, lat: Column) -> Pair:
    at = F.least(F.lit(18.0), F.abs(lat) / 5)
    return F.radians(lon) * 0.8487 * _along(ROBINSON_X, at), F.signum(lat) * 1.3523 * _along(ROBINSON_Y, at)


def _seen_from(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column, Column]:
    """East, north and outward parts of a place's unit vector at the centre of the view."""
    x, y, z = vector(lon - lon0, lat)
    up, across = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    return y, z * across - x * up, x * across + z * up


def _azimuthal(scale):
    """A projection that stretches the tangent plane's directions by scale(distance from the axis, outward part); the opposite point lies on the centre."""

    def of(lon: Column, lat: Column, lon0: float = 0.0, lat0: float = 0.0) -> Pair:
        east, north, out = _seen_from(lon, lat, lon0, lat0)
        k = F.when(out < -1 + 1e-10, 0.0).otherwise(scale(F.sqrt(east * east + north * north), out))
        return east * k, north * k

    return of


def _orthographic(lon: Column, lat: Column, lon0: float = 0.0, lat0: float = 0.0) -> Pair:
    return _seen_from(lon, lat, lon0, lat0)[:2]


_CENTRED = {
    "globe": _orthographic,
    "orthographic": _orthographic,
    "laea": _azimuthal(lambda off, out: F.sqrt(2 / F.greatest(F.lit(1e-15), 1 + out))),
    "aeqd": _azimuthal(lambda off, out: F.when(off < 1e-12, 1.0).otherwise(F.atan2(off, out) / off)),
}
_PLANE = {
    "equirectangular": _equirectangular, "mercator": _mercator, "mollweide": _mollweide, "sinusoidal": _sinusoidal, "gall-peters": _gall_peters, "equal-earth": _equal_earth,
    "natural-earth": _natural_earth, "winkel-tripel": _winkel, "robinson": _robinson,
}
PROJECTIONS = (*_PLANE, *_CENTRED)


def project(name: str, lon: Column, lat: Column, lon0: float = 0.0, lat0: float = 0.0) -> Pair:
    """Plane coordinates on the unit sphere; the centre counts for the azimuthal projections."""
    if name in _PLANE:
        return _PLANE[name](lon, lat)
    if name in _CENTRED:
        return _CENTRED[name](lon, lat, lon0, lat0)
    raise ValueError(f"no projection {name}")


def to_geographic(x: Column, z: Column, width: float, height: float) -> tuple[Column, Column]:
    """Longitude and latitude of map positions: x runs around once, z from north to south on a Mercator strip."""
    return wrap(x / width * 360 - 180), F.degrees(F.atan(F.sinh(isometric_latitude(z, height))))


def isometric_latitude(z: Column, height: float) -> Column:
    """The latitude as the Mercator projection stretches it; it tells places near a pole apart whose latitudes are the same double."""
    return math.pi * (1 - 2 * z / height)


def from_geographic(lon: Column, lat: Column, width: float, height: float, isometric: Column | None = None) -> tuple[Column, Column]:
    """Map positions of coordinates; a latitude alone is inverted as far as a double holds it, the isometric one at any distance."""
    t = F.tan(F.radians(lat))
    # by the absolute value, as asinh of a large negative number is minus infinity
    stretched = F.signum(t) * F.asinh(F.abs(t)) if isometric is None else isometric
    return (wrap(lon) + 180) / 360 * width, (1 - stretched / math.pi) / 2 * height


def triangle_area(a: tuple[Column, ...], b: tuple[Column, ...], c: tuple[Column, ...], radius: float = RADIUS) -> Column:
    """Area of a spherical triangle from the solid angle of three unit vectors."""
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    triple = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return 2 * F.atan2(F.abs(triple), 1 + dot(a, b) + dot(b, c) + dot(c, a)) * radius * radius


def samples(lon1: Column, lat1: Column, lon2: Column, lat2: Column, step: float) -> Column:
    """Points (i, lon, lat) along a great circle at most step degrees apart; null between opposite points."""
    angle = central_angle(lon1, lat1, lon2, lat2)
    n = F.greatest(F.lit(1), F.least(F.lit(3600), F.ceil(F.degrees(angle) / step))).cast("int")
    u, v = vector(lon1, lat1), vector(lon2, lat2)

    def at(i: Column) -> Column:
        t = i / n
        p, q = F.when(F.sin(angle) < 1e-12, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle)), F.when(F.sin(angle) < 1e-12, t).otherwise(F.sin(t * angle) / F.sin(angle))
        x, y, z = (p * a + q * b for a, b in zip(u, v, strict=True))
        return F.struct(i.alias("i"), F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))

    return F.when(angle < math.pi - 1e-9, F.transform(F.sequence(F.lit(0), n), at))


def distortion(name: str, lon: Column, lat: Column) -> dict[str, Column]:
    """Scales of a projection by central differences: area, largest, smallest, and the angular deformation in degrees."""
    e = 1e-5
    step = math.degrees(e)
    east, west, north, south = project(name, lon + step, lat), project(name, lon - step, lat), project(name, lon, lat + step), project(name, lon, lat - step)
    k = F.cos(F.radians(lat))
    a, c = ((p - q) / (2 * e) / k for p, q in zip(east, west, strict=True))
    b, d = ((p - q) / (2 * e) for p, q in zip(north, south, strict=True))
    area = F.abs(a * d - b * c)
    total = a * a + b * b + c * c + d * d
    plus, minus = F.sqrt(total + 2 * area), F.sqrt(F.greatest(F.lit(0.0), total - 2 * area))
    return {"area": area, "largest": (plus + minus) / 2, "smallest": (plus - minus) / 2, "deformation": F.degrees(2 * F.asin(F.least(F.lit(1.0), minus / plus)))}


def solved(name: str, x: Column, y: Column, rounds: int = 12) -> tuple[Column, Column]:
    """Longitude and latitude of plane coordinates by Newton steps from a start near the equirectangular one; null where they don't come back to the point."""
    e = 1e-6
    start = F.struct(F.greatest(F.lit(-179.0), F.least(F.lit(179.0), F.degrees(x))).alias("lon"), F.greatest(F.lit(-85.0), F.least(F.lit(85.0), F.degrees(y))).alias("lat"))

    def step(at: Column, _: Column) -> Column:
        lon, lat = at["lon"], at["lat"]
        around = zip(("f", "e", "n"), (project(name, lon, lat), project(name, lon + e, lat), project(name, lon, lat + e)), strict=True)
        values = F.struct(lon.alias("lon"), lat.alias("lat"), *[v.alias(k + a) for k, p in around for a, v in zip("xy", p, strict=True)])
        return _once(values, moved)

    def moved(v: Column) -> Column:
        a, b, c, d = (v["ex"] - v["fx"]) / e, (v["nx"] - v["fx"]) / e, (v["ey"] - v["fy"]) / e, (v["ny"] - v["fy"]) / e
        dx, dy, det = x - v["fx"], y - v["fy"], a * d - b * c
        return F.struct(F.greatest(F.lit(-180.0), F.least(F.lit(180.0), v["lon"] + (d * dx - b * dy) / det)).alias("lon"), F.greatest(F.lit(-89.9), F.least(F.lit(89.9), v["lat"] + (a * dy - c * dx) / det)).alias("lat"))

    def checked(at: Column) -> Column:
        px, py = project(name, at["lon"], at["lat"])
        return F.when(F.abs(px - x) + F.abs(py - y) < 1e-7, at)

    found = _once(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step), checked)
    return found["lon"], found["lat"]


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_at_antimeridian(points: Column) -> Column:
    """Parts (part, points) of a line of (lon, lat) whose steps are less than half a turn: a step over 180 degrees ends a part there and begins the next on the other side."""
    empty = F.array().cast("array<struct<lon:double,lat:double>>")
    start = F.struct(F.array().cast("array<array<struct<lon:double,lat:double>>>").alias("done"), empty.alias("open"))
    point = lambda lon, lat: F.array(F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")))

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc["open"], -1)
        turn = p["lon"] - last["lon"]
        side = F.when(turn < -180, 180.0).otherwise(-180.0)
        t = (side - last["lon"]) / (turn + 2 * side)
        lat = last["lat"] + t * (p["lat"] - last["lat"])
        crossed = F.struct(F.concat(acc["done"], F.array(F.concat(acc["open"], point(side, lat)))).alias("done"), F.concat(point(-side, lat), point(p["lon"], p["lat"])).alias("open"))
        kept = F.struct(acc["done"].alias("done"), F.concat(acc["open"], point(p["lon"], p["lat"])).alias("open"))
        return F.when((F.size(acc["open"]) > 0) & (F.abs(turn) > 180), crossed).otherwise(kept)

    return F.aggregate(points, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def polygon(ring: Column, radius: float = RADIUS, hemisphere: bool = False) -> Column:
    """status and area of a simple polygon of (lon, lat) on the sphere.

    The first reason against it wins: vertex_count (3 to 512), repeated_vertex,
    antipodal_edge, self_intersecting, and, if asked, no_hemisphere (corners that don't lie
    within less than half the sphere around their middle); the area is then 0.  The area is
    the sum of the solid angles towards the middle direction of the corners, the smaller of
    both sides.
    """
    vectors = F.transform(ring, lambda p: F.struct(*[c.alias(n) for n, c in zip("xyz", vector(p["lon"], p["lat"]), strict=True)]))
    dot = lambda a, b: a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
    triple = lambda a, b, c: a["x"] * (b["y"] * c["z"] - b["z"] * c["y"]) + a["y"] * (b["z"] * c["x"] - b["x"] * c["z"]) + a["z"] * (b["x"] * c["y"] - b["y"] * c["x"])
    apart = lambda a, b, s: (a["x"] + s * b["x"]) ** 2 + (a["y"] + s * b["y"]) ** 2 + (a["z"] + s * b["z"]) ** 2

    def of(v: Column) -> Column:
        n = F.size(v)
        at = lambda i: F.get(v, i % n)
        after = lambda i, step, end: F.when(i + step <= end, F.sequence(i + step, end)).otherwise(F.array().cast("array<int>"))
        every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        repeated = F.exists(every, lambda i: F.exists(after(i, 1, n - 1), lambda j: apart(at(i), at(j), -1) < 1e-20))
        opposite = F.exists(every, lambda i: apart(at(i), at(i + 1), 1) < 1e-14)

        def cross(i: Column, j: Column) -> Column:
            a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
            turns = [triple(a, c, b), triple(c, b, d), triple(b, d, a), triple(d, a, c)]
            return (F.least(*turns) > 1e-15) | (F.greatest(*turns) < -1e-15)

        crossed = F.exists(every, lambda i: F.exists(after(i, 2, n - 1), lambda j: ~((i == 0) & (j == n - 1)) & cross(i, j)))
        sum_of = lambda f: F.aggregate(v, F.lit(0.0), lambda s, p: s + p[f])
        total = {f: sum_of(f) for f in "xyz"}
        length = F.sqrt(total["x"] ** 2 + total["y"] ** 2 + total["z"] ** 2)
        middle = F.struct(*[(total[f] / F.when(length > 1e-12, length)).alias(f) for f in "xyz"])
        wedge = lambda m: F.aggregate(every, F.lit(0.0), lambda s, i: s + 2 * F.atan2(triple(m, at(i), at(i + 1)), 1 + dot(m, at(i)) + dot(at(i), at(i + 1)) + dot(at(i + 1), m)))
        excess = _once(middle, wedge)
        angle = F.abs(F.pmod(excess + 2 * math.pi, F.lit(4 * math.pi)) - 2 * math.pi)
        wide = F.lit(hemisphere) & ((length <= 1e-12) | F.exists(v, lambda p: dot(p, middle) <= 1e-6))
        status = F.when((n < 3) | (n > 512), "vertex_count").when(repeated, "repeated_vertex").when(opposite, "antipodal_edge").when(crossed, "self_intersecting").when(wide, "no_hemisphere").otherwise("ok")
        return _once(status, lambda s: F.struct(s.alias("status"), F.when(s == "ok", angle * radius * radius).otherwise(0.0).alias("area")))

    return _once(vectors, of)


def visibility(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Cosine of a place's angle from the centre of the view: 0 on the horizon."""
    return _seen_from(lon, lat, lon0, lat0)[2]


def clipped_to_horizon(ring: Column, lon0: float, lat0: float) -> Column:
    """The visible part of a small ring of (lon, lat) as points (lon, lat, added); fewer than three points are none.

    Sides are straight in longitude and latitude; where one crosses the horizon a point is found by halving.
    """
    sees = lambda p: visibility(p["lon"], p["lat"], lon0, lat0) >= 0
    empty = F.array().cast("array<struct<lon:double,lat:double,added:boolean>>")

    def side(i: Column) -> Column:
        b, a = F.get(ring, i), F.get(ring, F.when(i == 0, F.size(ring) - 1).otherwise(i - 1))
        along = lambda t: F.struct((a["lon"] + t * (b["lon"] - a["lon"])).alias("lon"), (a["lat"] + t * (b["lat"] - a["lat"])).alias("lat"))
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        halve = lambda s, _: _once((s["lo"] + s["hi"]) / 2, lambda t: F.when(sees(along(t)) == sees(a), F.struct(t.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), t.alias("hi"))))
        t = F.aggregate(F.sequence(F.lit(1), F.lit(54)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
        cut = _once(along(t), lambda p: F.array(F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), F.lit(True).alias("added"))))
        own = F.array(F.struct(b["lon"].alias("lon"), b["lat"].alias("lat"), F.lit(False).alias("added")))
        return F.concat(F.when(sees(a) != sees(b), cut).otherwise(empty), F.when(sees(b), own).otherwise(empty))

    made = F.when(F.size(ring) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), side))).otherwise(empty)
    return _once(made, lambda c: F.when(F.size(c) >= 3, c).otherwise(empty))


#: Intervals of a graticule in degrees, and how many pixels apart its lines should be (fixed values).
INTERVALS = (90.0, 60.0, 45.0, 30.0, 20.0, 15.0, 10.0, 5.0, 2.0, 1.0, 0.5, 0.25, 0.1)
NEAREST, LEAST_APART, MOST_APART = 120, 60, 190


def interval(pixels: Column, current: float) -> Column:
    """The graticule's interval at so many pixels a degree: the current one while it suits, else that nearest to the target by ratio (the wider of two)."""
    cost = F.array_min(F.array(*[F.struct(F.round(F.abs(F.log(pixels * step / NEAREST)), 12).alias("cost"), F.lit(-step).alias("minus")) for step in INTERVALS]))
    return F.when((pixels * current).between(LEAST_APART, MOST_APART), current).otherwise(-cost["minus"])
