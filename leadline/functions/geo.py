"""Sphere, Web Mercator and the hexagonal grid, as Column expressions; tile arithmetic for the driver.

Cells are pointy-top hexagons in Mercator metres under axial coordinates. A cell's width is in Mercator
metres; its width on the ground is that times the cosine of the latitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadline.functions.numbers import ColumnOrName, bound, c, half_up, of

# Mean Earth radius, Mercator radius, and the Mercator limit of latitude.
EARTH_RADIUS_M = 6371008.8
MERCATOR_RADIUS_M = 6378137.0
MAX_LATITUDE = 85.05112878
CIRCUMFERENCE_M = 2 * math.pi * MERCATOR_RADIUS_M
#: Axial offsets of a cell's six neighbours.
NEIGHBOURS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
ROOT3 = math.sqrt(3.0)


def haversine_m(lat1: ColumnOrName, lon1: ColumnOrName, lat2: ColumnOrName, lon2: ColumnOrName) -> Column:
    """Great-circle metres between positions in degrees."""
    a, b = F.radians(c(lat1)), F.radians(c(lat2))
    dlat, dlon = F.radians(c(lat2) - c(lat1)), F.radians(c(lon2) - c(lon1))
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def mercator_x(lon: ColumnOrName) -> Column:
    return F.radians(c(lon)) * MERCATOR_RADIUS_M


def mercator_y(lat: ColumnOrName) -> Column:
    held = F.least(F.greatest(c(lat), F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))
    return F.lit(MERCATOR_RADIUS_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(held) / 2))


def longitude_of(x: ColumnOrName) -> Column:
    return F.degrees(c(x) / MERCATOR_RADIUS_M)


def latitude_of(y: ColumnOrName) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(c(y) / MERCATOR_RADIUS_M)) - F.lit(math.pi / 2))


def hex_cell(x: ColumnOrName, y: ColumnOrName, width_m: float) -> tuple[Column, Column]:
    """Axial (x, y) of the hexagon that holds a Mercator point: cube rounding, the worst axis follows the others."""
    q = c(x) / F.lit(float(width_m)) - c(y) / F.lit(ROOT3 * width_m)
    r = c(y) * F.lit(2.0) / F.lit(ROOT3 * width_m)

    def rounded(p: Column) -> Column:
        s = -p["q"] - p["r"]
        rq, rr, rs = half_up(p["q"]), half_up(p["r"]), half_up(s)
        dq, dr, ds = F.abs(rq - p["q"]), F.abs(rr - p["r"]), F.abs(rs - s)
        q_worst = (dq > ds) & (dq > dr)
        return F.struct(F.when(q_worst, -rs - rr).otherwise(rq).alias("x"), F.when(q_worst | (ds > dr), rr).otherwise(-rq - rs).alias("y"))

    # worked out once: written out, the two columns name the point some twenty times, beyond what the JVM compiles
    cell = bound(F.struct(q.alias("q"), r.alias("r")), rounded)
    return cell["x"], cell["y"]


def hex_centre(cell_x: ColumnOrName, cell_y: ColumnOrName, width_m: float | Column) -> tuple[Column, Column]:
    m = width_m if isinstance(width_m, Column) else F.lit(float(width_m))
    return m * (c(cell_x) + c(cell_y) / F.lit(2.0)), m * F.lit(ROOT3) / F.lit(2.0) * c(cell_y)


def hex_vertices(cell_x: ColumnOrName, cell_y: ColumnOrName, width_m: float | Column) -> Column:
    """The six corners as an array of (x, y) in Mercator metres, from 30 degrees on."""
    x, y = hex_centre(cell_x, cell_y, width_m)
    radius = (width_m if isinstance(width_m, Column) else F.lit(float(width_m))) / F.lit(ROOT3)
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct((x + radius * F.cos(F.radians(k * 60 + 30))).alias("x"), (y + radius * F.sin(F.radians(k * 60 + 30))).alias("y")))


def destination(lat: ColumnOrName, lon: ColumnOrName, east_m: ColumnOrName, north_m: ColumnOrName, m=F) -> tuple[Column, Column]:
    """Latitude and longitude after going so far east and north along a great circle; longitude in [-180, 180). ``m``: F, or Plain for numbers."""
    east, north = of(m, east_m), of(m, north_m)
    distance = m.sqrt(east * east + north * north) / m.lit(EARTH_RADIUS_M)
    bearing = m.atan2(east, north)
    a = m.radians(of(m, lat))
    out = m.asin(m.least(m.lit(1.0), m.greatest(m.lit(-1.0), m.sin(a) * m.cos(distance) + m.cos(a) * m.sin(distance) * m.cos(bearing))))
    lon2 = m.radians(of(m, lon)) + m.atan2(m.sin(bearing) * m.sin(distance) * m.cos(a), m.cos(distance) - m.sin(a) * m.sin(out))
    return m.degrees(out), wrap_degrees(m.degrees(lon2))


def wrap_degrees(d):
    return ((d + 540.0) % 360.0) - 180.0


def neighbour_cells(cell_x: ColumnOrName, cell_y: ColumnOrName) -> Column:
    """The six adjacent cells as an array of (x, y)."""
    return F.array(*[F.struct((c(cell_x) + dx).alias("x"), (c(cell_y) + dy).alias("y")) for dx, dy in NEIGHBOURS])


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """(min x, min y, max x, max y) of a tile in Mercator metres."""
    span, edge = CIRCUMFERENCE_M / 2**z, CIRCUMFERENCE_M / 2
    return -edge + x * span, edge - (y + 1) * span, -edge + (x + 1) * span, edge - y * span


def tile_bounds_columns(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName) -> tuple[Column, Column, Column, Column]:
    span, edge = F.lit(CIRCUMFERENCE_M) / F.pow(F.lit(2.0), c(z)), F.lit(CIRCUMFERENCE_M / 2)
    return -edge + c(x) * span, edge - (c(y) + 1) * span, -edge + (c(x) + 1) * span, edge - c(y) * span


def tiles_around(z: ColumnOrName, x_m: ColumnOrName, y_m: ColumnOrName, margin_m: ColumnOrName) -> Column:
    """The tiles (x, y) of a zoom that hold a Mercator point when they are widened by a margin; none beyond the world's edge."""
    n = F.pow(F.lit(2.0), c(z))
    span, edge, m = F.lit(CIRCUMFERENCE_M) / n, F.lit(CIRCUMFERENCE_M / 2), c(margin_m)

    def between(low: Column, high: Column) -> Column:
        first, last = F.greatest(F.floor(low / span), F.lit(0).cast("long")), F.least(F.floor(high / span), n.cast("long") - 1)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    xs, ys = between(c(x_m) - m + edge, c(x_m) + m + edge), between(edge - c(y_m) - m, edge - c(y_m) + m)
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("x"), j.alias("y")))))


def parent_tile(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName, zoom: int = 12) -> tuple[Column, Column, Column]:
    """The tile at a coarser zoom that holds a tile; a tile at or above that zoom is its own."""
    up = F.greatest(c(z) - zoom, F.lit(0)).cast("int")
    by = F.pow(F.lit(2.0), up).cast("long")
    return F.least(c(z).cast("long"), F.lit(zoom).cast("long")), F.floor(c(x) / by).cast("long"), F.floor(c(y) / by).cast("long")


def mercator_point(lat: float, lon: float) -> tuple[float, float]:
    held = min(MAX_LATITUDE, max(-MAX_LATITUDE, lat))
    return math.radians(lon) * MERCATOR_RADIUS_M, MERCATOR_RADIUS_M * math.log(math.tan(math.pi / 4 + math.radians(held) / 2))


def lon_lat(x: float, y: float) -> tuple[float, float]:
    return math.degrees(x / MERCATOR_RADIUS_M), math.degrees(2 * math.atan(math.exp(y / MERCATOR_RADIUS_M)) - math.pi / 2)


def cell_of(lat: float, lon: float, width_m: float) -> tuple[int, int]:
    """The cell of a position, on the driver."""
    return cell_at(*mercator_point(lat, lon), width_m)


def cell_at(x: float, y: float, width_m: float) -> tuple[int, int]:
    q, r = x / width_m - y / (ROOT3 * width_m), 2 * y / (ROOT3 * width_m)
    s = -q - r
    rq, rr, rs = (math.floor(v + 0.5) for v in (q, r, s))
    dq, dr, ds = abs(rq - q), abs(rr - r), abs(rs - s)
    if dq > ds and dq > dr:
        return -rs - rr, rr
    return (rq, rr) if ds > dr else (rq, -rq - rs)


def cell_range(bounds: tuple[float, float, float, float], width_m: float, margin: int = 2) -> tuple[int, int, int, int]:
    """(min x, max x, min y, max y) of axial cells that cover Mercator bounds (min x, min y, max x, max y), with a margin."""
    corners = [(x / width_m - y / (ROOT3 * width_m), 2 * y / (ROOT3 * width_m)) for x in bounds[::2] for y in bounds[1::2]]
    xs, ys = zip(*corners, strict=True)
    return math.floor(min(xs)) - margin, math.ceil(max(xs)) + margin, math.floor(min(ys)) - margin, math.ceil(max(ys)) + margin


def bbox_bounds(bbox: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """Mercator bounds of (west, south, east, north) in degrees."""
    return (*mercator_point(bbox[1], bbox[0]), *mercator_point(bbox[3], bbox[2]))


def overview_width_m(base_m: float, zoom: float, scale: float = 0.5, most_m: float = 640.0) -> float:
    """Display width of cells at a zoom: doubles with each level under 20, held between the base and 640 m."""
    return max(base_m, min(most_m, base_m * 2 ** max(0, 20 - math.floor(zoom)) * min(0.75, max(0.25, scale))))


def overview_widths_m(base_m: float, from_zoom: int, to_zoom: int) -> list[float]:
    """The different widths over the base of a range of zooms, the widest first."""
    return sorted({overview_width_m(base_m, z) for z in range(from_zoom, to_zoom + 1)} - {base_m}, reverse=True)


def overview_width(base_m: float, zoom: ColumnOrName, scale: float = 0.5, most_m: float = 640.0) -> Column:
    """``overview_width_m`` of a column of zooms."""
    doubled = F.lit(base_m) * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.lit(20.0) - F.floor(c(zoom)))) * F.lit(min(0.75, max(0.25, scale)))
    return F.greatest(F.lit(base_m), F.least(F.lit(most_m), doubled))
