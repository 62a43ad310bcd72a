"""Coordinates: grids, point transforms, laser geometry and geodesy (WGS84)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.scalar import C, col, sinc

EARTH_A, EARTH_B = 6378137.0, 6356752.314245
E2 = 1 - (EARTH_B / EARTH_A) ** 2
#: The period of Jupiter's second rotation system, in seconds.
JUPITER_PERIOD = 9 * 3600 + 55 * 60 + 40.632


def crop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The rectangle, with its corner at the origin."""
    inside = (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)
    return df.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def flip(df: DataFrame, width: int, height: int, horizontal: bool = True, vertical: bool = False) -> DataFrame:
    return df.withColumns({"x": width - 1 - F.col("x") if horizontal else F.col("x"), "y": height - 1 - F.col("y") if vertical else F.col("y")})


def transpose(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("y"), "y": F.col("x")})


def rotate90(df: DataFrame, width: int, height: int, clockwise: bool = True) -> DataFrame:
    return df.withColumns({"x": height - 1 - F.col("y"), "y": F.col("x")} if clockwise else {"x": F.col("y"), "y": width - 1 - F.col("x")})


def transform_points(kind: str, x: C = "x", y: C = "y", *, tx: C | float = 0.0, ty: C | float = 0.0, angle: C | float = 0.0, scale: C | float = 1.0, a: tuple = ()) -> tuple[Column, Column]:
    """translation, euclidean, scaled_euclidean or affine (a: a00, a01, a02, a10, a11, a12)."""
    x, y, tx, ty = col(x), col(y), col(tx), col(ty)
    if kind == "translation":
        return x + tx, y + ty
    if kind == "affine":
        m = [col(v) for v in a]
        return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]
    s = col(scale) if kind == "scaled_euclidean" else F.lit(1.0)
    c, d = F.cos(col(angle)), F.sin(col(angle))
    return s * (c * x - d * y) + tx, s * (d * x + c * y) + ty


def polar_coords(x: C, y: C, cx: float, cy: float) -> tuple[Column, Column]:
    return F.hypot(col(x) - cx, col(y) - cy), F.atan2(col(y) - cy, col(x) - cx)


def downstrike(df: DataFrame, odd: bool = True) -> DataFrame:
    """Every second row and column, the odd ones or the even ones; the grid halves."""
    k = 1 if odd else 0
    return df.where((F.col("x") % 2 == k) & (F.col("y") % 2 == k)).withColumns({"x": F.expr("x div 2"), "y": F.expr("y div 2")})


def grid_downsample(df: DataFrame, k: int, value: str = "v") -> DataFrame:
    keys = [F.col("frame"), F.expr(f"y div {k}").alias("y"), F.expr(f"x div {k}").alias("x")]
    return df.groupBy(*keys).agg((F.sum(value).cast("double") / F.count(value)).alias(value), F.count(value).alias("n"))


def derotation_longitude(seconds: C, period: float = JUPITER_PERIOD) -> Column:
    return col(seconds) * (2 * math.pi / period)


def lidar_to_cartesian(distance: C = "distance", azimuth: C = "azimuth", elevation: C = "elevation") -> tuple[Column, Column, Column]:
    """x, y, z; null without a return."""
    d = F.when(col(distance) > 0, col(distance))
    flat = d * F.cos(col(elevation))
    return flat * F.sin(col(azimuth)), flat * F.cos(col(azimuth)), d * F.sin(col(elevation))


def lidar_depth(distance: C = "distance", elevation: C = "elevation") -> Column:
    return col(distance) * F.cos(col(elevation))


def lidar_height(distance: C = "distance", elevation: C = "elevation") -> Column:
    return col(distance) * F.sin(col(elevation))


def depth_to_cartesian(depth: C, azimuth: C, elevation: C) -> tuple[Column, Column, Column]:
    return col(depth) * F.sin(col(azimuth)), col(depth) * F.cos(col(azimuth)), col(depth) * F.tan(col(elevation))


def range_bin(df: DataFrame, resolution: float, start: float = 0.0, azimuth: str = "azimuth", ring: str = "laser_ring", rings: int = 128) -> DataFrame:
    """Adds r (azimuth bin) and c (ring); points outside are dropped. A hair below a bin's edge counts as the edge."""
    bins = round(2 * math.pi / resolution)
    r = F.floor(F.pmod(F.col(azimuth) - start, F.lit(2 * math.pi)) / resolution + 1e-9).cast("int")
    return df.withColumns({"r": r % bins, "c": F.col(ring)}).where((F.col("c") >= 0) & (F.col("c") < rings))


def gps_to_ecef(lat: C, lon: C, alt: C) -> tuple[Column, Column, Column]:
    n = EARTH_A / F.sqrt(1 - E2 * F.sin(col(lat)) * F.sin(col(lat)))
    flat = (n + col(alt)) * F.cos(col(lat))
    return flat * F.cos(col(lon)), flat * F.sin(col(lon)), (n * (1 - E2) + col(alt)) * F.sin(col(lat))


def ecef_to_gps(x: C, y: C, z: C) -> tuple[Column, Column, Column]:
    """Closed form of Zhu (1994)."""
    x, y, z = col(x), col(y), col(z)
    a2, b2 = EARTH_A**2, EARTH_B**2
    ep2 = (a2 - b2) / b2
    p = F.hypot(x, y)
    big_f = 54 * b2 * z * z
    g = p * p + (1 - E2) * z * z - E2 * (a2 - b2)
    c = E2 * E2 * big_f * p * p / (g * g * g)
    s = F.cbrt(1 + c + F.sqrt(c * c + 2 * c))
    k = s + 1 + 1 / s
    big_p = big_f / (3 * k * k * g * g)
    q = F.sqrt(1 + 2 * E2 * E2 * big_p)
    r0 = -big_p * E2 * p / (1 + q) + F.sqrt(F.greatest(a2 / 2 * (1 + 1 / q) - big_p * (1 - E2) * z * z / (q * (1 + q)) - big_p * p * p / 2, F.lit(0.0)))
    u = F.hypot(p - E2 * r0, z)
    v = F.sqrt((p - E2 * r0) * (p - E2 * r0) + (1 - E2) * z * z)
    z0 = b2 * z / (EARTH_A * v)
    return F.atan2(z + ep2 * z0, p), F.atan2(y, x), u * (1 - b2 / (EARTH_A * v))


Vector = tuple[Column, Column, Column]


def _apply(m: list[list[Column]], v: tuple[C, C, C]) -> Vector:
    return tuple(row[0] * col(v[0]) + row[1] * col(v[1]) + row[2] * col(v[2]) for row in m)


def enu_axes(lat: C, lon: C) -> list[list[Column]]:
    """Rows: east, north and up in earth-centred coordinates."""
    (sa, ca), (so, co) = ((F.sin(col(a)), F.cos(col(a))) for a in (lat, lon))
    return [[-so, co, F.lit(0.0)], [-sa * co, -sa * so, ca], [ca * co, ca * so, sa]]


def ecef_to_enu(point: tuple[C, C, C], origin: tuple[C, C, C], lat: C, lon: C) -> Vector:
    return _apply(enu_axes(lat, lon), tuple(col(p) - col(o) for p, o in zip(point, origin, strict=True)))


def enu_to_ecef(v: tuple[C, C, C], origin: tuple[C, C, C], lat: C, lon: C) -> Vector:
    m = enu_axes(lat, lon)
    moved = _apply([list(row) for row in zip(*m, strict=True)], v)
    return tuple(a + col(o) for a, o in zip(moved, origin, strict=True))


def vehicle_axes(roll: C, pitch: C, yaw: C) -> list[list[Column]]:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    (sr, cr), (sp, cp), (sy, cy) = ((F.sin(col(a)), F.cos(col(a))) for a in (roll, pitch, yaw))
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def vehicle_to_enu(v: tuple[C, C, C], roll: C, pitch: C, yaw: C) -> Vector:
    return _apply(vehicle_axes(roll, pitch, yaw), v)


def enu_to_vehicle(v: tuple[C, C, C], roll: C, pitch: C, yaw: C) -> Vector:
    return _apply([list(row) for row in zip(*vehicle_axes(roll, pitch, yaw), strict=True)], v)


def vehicle_to_ecef(v: tuple[C, C, C], lat: C, lon: C, alt: C, roll: C, pitch: C, yaw: C) -> Vector:
    return enu_to_ecef(vehicle_to_enu(v, roll, pitch, yaw), gps_to_ecef(lat, lon, alt), lat, lon)


def ecef_to_vehicle(p: tuple[C, C, C], lat: C, lon: C, alt: C, roll: C, pitch: C, yaw: C) -> Vector:
    return enu_to_vehicle(ecef_to_enu(p, gps_to_ecef(lat, lon, alt), lat, lon), roll, pitch, yaw)


def web_mercator(lat: C, lon: C) -> tuple[Column, Column]:
    """Metres from degrees; latitude is cut at 85 degrees north only."""
    return F.radians(col(lon)) * EARTH_A, EARTH_A * F.log(F.tan(math.pi / 4 + F.radians(F.least(col(lat), F.lit(85.0))) / 2))


def web_mercator_inverse(x: C, y: C) -> tuple[Column, Column]:
    return F.degrees(2 * F.atan(F.exp(col(y) / EARTH_A)) - math.pi / 2), F.degrees(col(x) / EARTH_A)


def geodesic_meters(lat0: C, lon0: C, lat1: C, lon1: C) -> Column:
    """Haversine, angles in radians."""
    a, b = F.sin((col(lat1) - col(lat0)) / 2), F.sin((col(lon1) - col(lon0)) / 2)
    h = a * a + F.cos(col(lat0)) * F.cos(col(lat1)) * b * b
    return 2 * EARTH_A * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geo_tile(lat: C, lon: C, zoom: int) -> tuple[Column, Column]:
    """Tile numbers of degrees."""
    n, a = 1 << zoom, F.radians(col(lat))
    x, y = (col(lon) + 180) / 360 * n, (1 - F.log(F.tan(a) + 1 / F.cos(a)) / math.pi) / 2 * n
    return tuple(F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("long") for v in (x, y))


def tile_parent(x: C, y: C, up: int = 1) -> tuple[Column, Column]:
    return F.shiftright(col(x), up), F.shiftright(col(y), up)


def tile_contains(zoom: int, x: C, y: C, zoom2: int, x2: C, y2: C) -> Column:
    if zoom2 < zoom:
        return F.lit(False)
    px, py = tile_parent(x2, y2, zoom2 - zoom)
    return (px == col(x)) & (py == col(y))


def tile_bounds(x: C, y: C, zoom: int) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north in degrees."""
    n = float(1 << zoom)
    lon = lambda v: v / n * 360 - 180
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return lon(col(x)), lat(col(y) + 1), lon(col(x) + 1), lat(col(y))


def quadkey(x: C, y: C, zoom: int) -> Column:
    parts = [(F.shiftright(col(x), i).bitwiseAND(F.lit(1)) + 2 * F.shiftright(col(y), i).bitwiseAND(F.lit(1))).cast("string") for i in reversed(range(zoom))]
    return F.concat(*parts) if parts else F.lit("")


def point_line_distance(x: C, y: C, x0: C, y0: C, x1: C, y1: C) -> Column:
    """To the line through two points."""
    dx, dy = col(x1) - col(x0), col(y1) - col(y0)
    size = F.hypot(dx, dy)
    across = F.abs(dy * (col(x) - col(x0)) - dx * (col(y) - col(y0)))
    return F.when(size > 0, across / size).otherwise(F.hypot(col(x) - col(x0), col(y) - col(y0)))


def pad_grid(df: DataFrame, width: int, height: int, border: int, mode: str = "replicate", fill: float = 0.0, value: str = "v") -> DataFrame:
    """Every frame with a border; places of the new grid take their value from the old one. constant, replicate, reflect (edge not repeated) or wrap."""
    side = lambda n: F.explode(F.sequence(F.lit(-border), F.lit(n - 1 + border)))
    grid = df.select("frame").distinct().select("frame", side(height).alias("__y")).select("frame", "__y", side(width).alias("__x"))

    def source(v: str, n: int) -> Column:
        c = F.col(v)
        if mode == "replicate":
            return F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
        if mode == "reflect":
            k = F.pmod(c, F.lit(2 * (n - 1)))
            return F.when(k < n, k).otherwise(2 * (n - 1) - k)
        return F.pmod(c, F.lit(n)) if mode == "wrap" else c

    old = df.select(F.col("frame").alias("__f"), F.col("y").alias("__sy"), F.col("x").alias("__sx"), F.col(value).cast("double").alias(value))
    joined = grid.withColumns({"__ty": source("__y", height), "__tx": source("__x", width)}).join(old, (F.col("frame") == F.col("__f")) & (F.col("__ty") == F.col("__sy")) & (F.col("__tx") == F.col("__sx")), "left")
    inside = (F.col("__y") >= 0) & (F.col("__y") < height) & (F.col("__x") >= 0) & (F.col("__x") < width)
    v = F.when(~inside, F.lit(fill)).otherwise(F.col(value)) if mode == "constant" else F.col(value)
    return joined.select("frame", (F.col("__y") + border).alias("y"), (F.col("__x") + border).alias("x"), v.alias(value))


def aitoff(lon: C, lat: C) -> tuple[Column, Column]:
    s = sinc(F.acos(F.cos(col(lat)) * F.cos(col(lon) / 2)))
    return 2 * F.cos(col(lat)) * F.sin(col(lon) / 2) / s, F.sin(col(lat)) / s
