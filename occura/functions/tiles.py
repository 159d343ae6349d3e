"""Web Mercator tile arithmetic as Column expressions; y runs down."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels along a tile's side.
EXTENT = 4096


def tile_bbox(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in degrees."""
    n = F.pow(F.lit(2.0), z)
    lon = lambda c: c / n * 360.0 - 180.0
    lat = lambda c: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * c / n))))
    return lon(x), lat(y + 1), lon(x + 1), lat(y)


def tile_fractions(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A point's place on the whole map, from 0 to 1, for its tiles' columns, for their rows, and for its pixel's row; times a zoom's tiles, which are a power of two, nothing is rounded."""
    angle = F.radians(lat)
    return (lon + 180.0) / 360.0, (1 - F.asinh(F.tan(angle)) / math.pi) / 2, (1 - F.ln(F.tan(angle) + 1 / F.cos(angle)) / math.pi) / 2


def tile_xy(lat: Column, lon: Column, z: Column) -> tuple[Column, Column]:
    """Tile of a point, kept within the map."""
    across, down, _ = tile_fractions(lat, lon)
    n = F.pow(F.lit(2.0), z)
    inside = lambda c: F.greatest(F.lit(0), F.least(F.floor(c), n.cast("bigint") - 1)).cast("int")
    return inside(across * n), inside(down * n)


def tile_pixel(lat: Column, lon: Column, z: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel of a point in a tile, kept within it."""
    across, _, down = tile_fractions(lat, lon)
    return pixel_at(across, down, z, x, y)


def pixel_at(across: Column, down: Column, z: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel in a tile of a place on the whole map."""
    n = F.call_function("shiftleft", F.lit(1), z.cast("int")).cast("double")
    inside = lambda c: F.round(F.greatest(F.lit(0.0), F.least(c * EXTENT, F.lit(EXTENT - 1.0)))).cast("int")
    return inside(across * n - x), inside(down * n - y)


def grid_size(zoom: int) -> float | None:
    """Degrees of a thinning cell; none from zoom 9 on."""
    # Cell sizes by zoom.
    return 1.0 if zoom <= 2 else 0.1 if zoom <= 5 else 0.01 if zoom <= 8 else None
