"""Points in the boxes of a zone table.

A range join without a nested loop: each box is filed in cells of about its own size, two along each axis at most, and a point
asks the one cell of each size that occurs.  Boxes and points of a cell meet by equality, and the true bounds decide.  Sizes
are powers of four, chosen per axis, so a thin box lies in thin cells, and a cell is at most four times its box.

Edge cases: a point without a coordinate and a box without a bound, or with bounds the wrong way round, match nothing; boxes may
overlap, and a point gives one row per box; a box of no extent holds the points on it when bounds are closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cell sizes are 4 ** k for k in this range; smaller boxes lie in the smallest cells, larger ones in more cells.
SMALLEST, LARGEST = -15, 30


def _size(extent: Column) -> Column:
    """Least k with 4 ** k at or above the extent."""
    k = F.ceil(F.log2(F.greatest(extent, F.lit(4.0 ** SMALLEST))) / 2)
    return F.least(F.greatest(k, F.lit(SMALLEST)), F.lit(LARGEST)).cast("int")


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / F.pow(F.lit(4.0), size))


def zone_join(points: DataFrame, zones: DataFrame, x: str, y: str, bounds: tuple[str, str, str, str] = ("west", "east", "south", "north"),
              closed: bool = True) -> DataFrame:
    """Each point with each zone whose box holds it; all columns of both tables (their names must differ).

    ``bounds`` names the columns of least and greatest x and least and greatest y.
    """
    west, east, south, north = (F.col(c).cast("double") for c in bounds)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    filed = zones.filter((west <= east) & (south <= north)).withColumns({"_kx": _size(east - west), "_ky": _size(north - south)})
    sizes = sorted((r["_kx"], r["_ky"]) for r in filed.select("_kx", "_ky").distinct().collect())  # few: powers of four
    along = lambda low, high, k: F.explode(F.sequence(_cell(low, F.col(k)), _cell(high, F.col(k))))
    filed = filed.withColumn("_cx", along(west, east, "_kx")).withColumn("_cy", along(south, north, "_ky"))
    asked = F.array(*[F.struct(F.lit(a).alias("kx"), F.lit(b).alias("ky")) for a, b in sizes]).cast("array<struct<kx:int,ky:int>>")
    placed = points.filter(px.isNotNull() & py.isNotNull()).withColumn("_k", F.explode(asked)).select(
        *points.columns, F.col("_k.kx").alias("_kx"), F.col("_k.ky").alias("_ky"))
    placed = placed.withColumns({"_cx": _cell(px, F.col("_kx")), "_cy": _cell(py, F.col("_ky"))})
    if closed:
        holds = (px >= west) & (px <= east) & (py >= south) & (py <= north)
    else:
        holds = (px > west) & (px < east) & (py > south) & (py < north)
    return placed.join(filed, ["_kx", "_ky", "_cx", "_cy"]).filter(holds).select(*points.columns, *zones.columns)
