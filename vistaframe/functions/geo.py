"""Geodesy on a sphere, Web Mercator and the pinhole camera, as column expressions. Angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
EARTH_M = 6_371_000.0
REFRACTION = 0.13
EQUATOR_M = 40_075_016.686
DEGREE_M = 111_195.0

_rad, _deg = F.radians, F.degrees


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def normalize_deg(x) -> Column:
    """[0, 360)"""
    return F.pmod(_c(x), F.lit(360.0))


def delta_deg(a, b) -> Column:
    """a - b in (-180, 180]."""
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def round_half_up(x) -> Column:
    """Nearest integer, halves towards +infinity."""
    return F.floor(_c(x) + 0.5)


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance by haversine."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(_rad(lat2 - lat1) / 2), 2) + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * F.pow(F.sin(_rad(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    d = _rad(lon2 - lon1)
    y = F.sin(d) * F.cos(_rad(lat2))
    x = F.cos(_rad(lat1)) * F.sin(_rad(lat2)) - F.sin(_rad(lat1)) * F.cos(_rad(lat2)) * F.cos(d)
    return normalize_deg(_deg(F.atan2(y, x)))


def destination(lat, lon, azimuth, distance) -> tuple[Column, Column]:
    """(lat, lon) at a distance along a great circle; lon in [-180, 180)."""
    lat, lon, azimuth, distance = map(_c, (lat, lon, azimuth, distance))
    d = distance / EARTH_M
    sin2 = F.sin(_rad(lat)) * F.cos(d) + F.cos(_rad(lat)) * F.sin(d) * F.cos(_rad(azimuth))
    to_lon = lon + _deg(F.atan2(F.sin(_rad(azimuth)) * F.sin(d) * F.cos(_rad(lat)), F.cos(d) - F.sin(_rad(lat)) * sin2))
    return _deg(F.asin(sin2)), F.pmod(to_lon + 540, F.lit(360.0)) - 180


def curvature_drop(d) -> Column:
    """How far the ground falls below the tangent at distance d, refraction taken off."""
    d = _c(d)
    return d * d / (2 * EARTH_M) * (1 - REFRACTION)


def elevation_angle(h0, h, d) -> Column:
    h0, h, d = map(_c, (h0, h, d))
    return _deg(F.atan2(h - h0 - curvature_drop(d), d))


def flat_metres(lat1, lon1, lat2, lon2) -> Column:
    """Local approximation with the first point's latitude, so not symmetric."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    return F.hypot((lat2 - lat1) * DEGREE_M, (lon2 - lon1) * DEGREE_M * F.cos(_rad(lat1)))


def to_mercator(lat, lon) -> tuple[Column, Column]:
    """(x, y) in the unit square, y downwards."""
    lat, lon = _c(lat), _c(lon)
    s = F.sin(_rad(lat))
    return (lon + 180) / 360, 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def lonlat_to_pixel(lat, lon, zoom: int) -> tuple[Column, Column]:
    """Global pixel of a zoom level with 256-pixel tiles."""
    x, y = to_mercator(lat, lon)
    return x * 256 * 2**zoom, y * 256 * 2**zoom


def tile_corner(z, x, y) -> tuple[Column, Column]:
    """(lat, lon) of a tile's upper left corner; fractions name points within."""
    z, x, y = map(_c, (z, x, y))
    n = F.pow(F.lit(2.0), z)
    return _deg(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n)))), x / n * 360 - 180


def tile_corners(z, x, y) -> Column:
    """Array of (lat, lon): the four corners clockwise from the upper left, then the centre."""
    points = []
    for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)):
        lat, lon = tile_corner(z, _c(x) + dx, _c(y) + dy)
        points.append(F.struct(lat.alias("lat"), lon.alias("lon")))
    return F.array(*points)


def meters_per_pixel(lat, zoom) -> Column:
    return EQUATOR_M * F.cos(_rad(_c(lat))) / (256 * F.pow(F.lit(2.0), _c(zoom)))


def tile_key(lat, lon) -> Column:
    """Key of the one-degree tile, as in 46_-8."""
    return F.concat_ws("_", F.floor(_c(lat)).cast("string"), F.floor(_c(lon)).cast("string"))


def tiles_for(lat, lon, radius) -> Column:
    """Array of (dist, lat, lon) of the one-degree tiles within `radius` metres, nearest first.

    The distance is from the point to the nearest point of the tile, on a flat map at the point's latitude.
    No wrap at the antimeridian.
    """
    lat, lon, radius = map(_c, (lat, lon, radius))
    cos = F.greatest(F.lit(0.01), F.cos(_rad(lat)))
    dy, dx = radius / DEGREE_M, radius / (DEGREE_M * cos)

    def span(low, high):
        return F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int"))

    def cell(y, x):
        near_y = F.greatest(F.lit(0.0), y - lat, lat - (y + 1))
        near_x = F.greatest(F.lit(0.0), x - lon, lon - (x + 1))
        dist = F.hypot(near_y * DEGREE_M, near_x * DEGREE_M * cos)
        return F.struct(dist.alias("dist"), y.alias("lat"), x.alias("lon"))

    grid = F.flatten(F.transform(span(lat - dy, lat + dy), lambda y: F.transform(span(lon - dx, lon + dx), lambda x: cell(y, x))))
    return F.array_sort(F.filter(grid, lambda t: t["dist"] <= radius))


def tiles_covering(lat, lon, radius, zoom: int) -> Column:
    """Array of (x, y) raster tiles that cover the box of the points N, E, S and W at `radius`; x wraps."""
    n = 2**zoom
    north, south = (destination(lat, lon, az, radius)[0] for az in (0, 180))
    west, east = (destination(lat, lon, az, radius)[1] for az in (270, 90))
    x0, y0 = (F.floor(v / 256).cast("int") for v in lonlat_to_pixel(north, west, zoom))
    x1, y1 = (F.floor(v / 256).cast("int") for v in lonlat_to_pixel(south, east, zoom))
    rows = F.sequence(F.greatest(F.lit(0), y0), F.least(F.lit(n - 1), y1))
    return F.flatten(F.transform(rows, lambda y: F.transform(F.sequence(x0, x1), lambda x: F.struct(F.pmod(x, F.lit(n)).alias("x"), y.alias("y")))))


def camera_basis(heading, pitch, roll) -> dict[str, tuple[Column, Column, Column]]:
    """Unit vectors (east, north, up) of a camera: forward, right and up."""
    h, p, r = (_rad(_c(x)) for x in (heading, pitch, roll))
    zero = F.lit(0.0)
    forward = (F.sin(h) * F.cos(p), F.cos(h) * F.cos(p), F.sin(p))
    level_right = (F.cos(h), -F.sin(h), zero)
    level_up = (-F.sin(h) * F.sin(p), -F.cos(h) * F.sin(p), F.cos(p))
    right = tuple(a * F.cos(r) + b * F.sin(r) for a, b in zip(level_right, level_up))
    up = tuple(b * F.cos(r) - a * F.sin(r) for a, b in zip(level_right, level_up))
    return {"forward": forward, "right": right, "up": up}


def _direction(az, alt):
    az, alt = _rad(_c(az)), _rad(_c(alt))
    return F.sin(az) * F.cos(alt), F.cos(az) * F.cos(alt), F.sin(alt)


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def project(az, alt, heading, pitch, roll, hfov, width, height) -> Column:
    """Struct (x, y) of a direction's pixel; null behind the camera (depth under 0.05)."""
    basis, v = camera_basis(heading, pitch, roll), _direction(az, alt)
    depth = _dot(v, basis["forward"])
    focal = _c(width) / 2 / F.tan(_rad(_c(hfov)) / 2)
    x = _c(width) / 2 + focal * _dot(v, basis["right"]) / depth
    y = _c(height) / 2 - focal * _dot(v, basis["up"]) / depth
    return F.when(depth >= 0.05, F.struct(x.alias("x"), y.alias("y")))


def screen_to_dir(x, y, heading, pitch, roll, hfov, width, height) -> Column:
    """Struct (az, alt) of the direction through a pixel."""
    basis = camera_basis(heading, pitch, roll)
    focal = _c(width) / 2 / F.tan(_rad(_c(hfov)) / 2)
    a, b = (_c(x) - _c(width) / 2) / focal, (_c(height) / 2 - _c(y)) / focal
    v = [f + a * r + b * u for f, r, u in zip(basis["forward"], basis["right"], basis["up"])]
    return F.struct(normalize_deg(_deg(F.atan2(v[0], v[1]))).alias("az"), _deg(F.atan2(v[2], F.hypot(v[0], v[1]))).alias("alt"))


def azimuth_in_view(az, heading, pitch, roll, hfov, width, height, margin) -> Column:
    """Whether an azimuth can be in the picture: half the field of view (half the diagonal if rolled), a
    margin and half the pitch."""
    half = _c(hfov) / 2
    diagonal = _deg(F.atan(F.tan(_rad(half)) * F.hypot(_c(width), _c(height)) / _c(width)))
    reach = F.when(_c(roll) == 0, half).otherwise(diagonal) + _c(margin) + F.abs(_c(pitch)) / 2
    return F.abs(delta_deg(az, heading)) <= F.least(F.lit(89.0), reach)


def display_hfov(fov_long, video_width, video_height, width, height) -> Column:
    """Horizontal field of view shown when a video fills a screen and its overhang is cut off; fov_long
    belongs to the video's long side."""
    vw, vh, w, h = map(_c, (video_width, video_height, width, height))
    focal = F.greatest(vw, vh) / 2 / F.tan(_rad(_c(fov_long)) / 2)
    scale = F.greatest(w / vw, h / vh)
    return _deg(2 * F.atan(w / 2 / (focal * scale)))


def fov_long_from_display(hfov, video_width, video_height, width, height) -> Column:
    """The inverse of display_hfov."""
    vw, vh, w, h = map(_c, (video_width, video_height, width, height))
    scale = F.greatest(w / vw, h / vh)
    focal = w / 2 / F.tan(_rad(_c(hfov)) / 2) / scale
    return _deg(2 * F.atan(F.greatest(vw, vh) / 2 / focal))


def horizon_bins(az, step: float = 0.1) -> tuple[Column, Column, Column]:
    """(lower bin, upper bin, weight of the upper) for interpolation on a ring of bins."""
    n = round(360 / step)
    at = F.pmod(_c(az), F.lit(360.0)) / step
    low = F.floor(at)
    return F.pmod(low, F.lit(n)).cast("int"), F.pmod(low + 1, F.lit(n)).cast("int"), at - low


def nearest_bin(az, step: float = 0.1) -> Column:
    return F.pmod(round_half_up(_c(az) / step), F.lit(round(360 / step))).cast("int")
