"""Web-Mercator tiles, elevation decoding and cell geometry."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Box:
    """Bounding box in degrees."""

    south: float
    north: float
    west: float
    east: float


def tile_x(lon, zoom: int) -> Column:
    return F.floor((_c(lon) + 180) / 360 * float(2 ** zoom))


def _asinh(x: Column) -> Column:
    """By the size of x and its sign: Spark's works out log(x + sqrt(x * x + 1)), which loses digits below 0 and is infinite from about -1e8 down."""
    return F.signum(x) * F.asinh(F.abs(x))


def tile_y(lat, zoom: int) -> Column:
    return F.floor((1 - _asinh(F.tan(F.radians(_c(lat)))) / math.pi) / 2 * float(2 ** zoom))


def tile_lon(x, zoom: int) -> Column:
    """Western edge of a tile."""
    return _c(x) / float(2 ** zoom) * 360 - 180


def tile_lat(y, zoom: int) -> Column:
    """Northern edge of a tile."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2.0 * _c(y) / float(2 ** zoom)))))


def terrain_metres(r, g, b) -> Column:
    """Elevation from the red-green-blue encoding with 1/256 m steps."""
    return _c(r) * 256.0 + _c(g) + _c(b) / 256.0 - 32768.0


def packed_height(r, g, b) -> Column:
    """Height in tenths of a metre from a packed 24-bit number; null where there is no data."""
    h = _c(r) * 65536.0 + _c(g) * 256.0 + _c(b) - 1000.0
    return F.when(h > -900, h)


def cell_row(lat, box: Box, rows: int) -> Column:
    """Row counted from the north; truncates toward zero."""
    return ((F.lit(box.north) - _c(lat)) / (box.north - box.south) * rows).cast("int")


def cell_col(lon, box: Box, cols: int) -> Column:
    return ((_c(lon) - box.west) / (box.east - box.west) * cols).cast("int")


def hectares_per_cell(rows, cols, box: Box) -> Column:
    """Area of one cell with the cosine of the middle latitude."""
    km_lon = KM_PER_DEGREE * math.cos(math.radians((box.north + box.south) / 2))
    return ((box.north - box.south) / _c(rows) * KM_PER_DEGREE) * ((box.east - box.west) / _c(cols) * km_lon) * 100


def wrap_longitude(lon) -> Column:
    """0..360 to -180..180."""
    return F.when(_c(lon) > 180, _c(lon) - 360).otherwise(_c(lon))


def inside(lat, lon, box: Box, open_bounds: bool = True) -> Column:
    la, lo = _c(lat), _c(lon)
    if open_bounds:
        return (lo > box.west) & (lo < box.east) & (la > box.south) & (la < box.north)
    return lo.between(box.west, box.east) & la.between(box.south, box.north)


def snap_level(cm, step: int = 10, low: int = 10, high: int = 250) -> Column:
    """Nearest published water level."""
    nearest = (F.floor(_c(cm) / float(step) + 0.5) * step).cast("int")
    return F.when(nearest.isNotNull(), F.least(F.greatest(nearest, F.lit(low)), F.lit(high)))
