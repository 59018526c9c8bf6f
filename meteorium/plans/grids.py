"""Gridded temperature tables and flood statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import flood, grids


def historical_grids(cells: DataFrame, period: tuple[int, int] = (1961, 1990), size: int = 10) -> dict[str, DataFrame]:
    """Country and map tables from monthly cells (year, month, x, y, value), rows counted from the top.

    No-data cells are masked before the country mean; the map keeps each unmasked cell's running mean and its
    difference to the overall and to the period mean.
    """
    flipped = grids.flip_rows(cells, [], "y")
    yearly = flipped.groupBy("x", "y", "year").agg(F.avg("value").alias("value"))
    valid = grids.mask_below(yearly, "value")
    country = valid.groupBy("year").agg(F.avg("value").alias("temperature_average"))
    everything = F.col("year").isNotNull()
    special = country.agg(F.avg(F.when(F.col("year").between(*period), F.col("temperature_average"))).alias("_p"),
                          F.avg("temperature_average").alias("_a"), F.min("year").alias("_lo"), F.max("year").alias("_hi"))
    rows = F.explode(F.array(
        F.struct(F.lit(period[0]).alias("year_start"), F.lit(period[1]).alias("year_end"), F.col("_p").alias("temperature_average")),
        F.struct(F.col("_lo").alias("year_start"), F.col("_hi").alias("year_end"), F.col("_a").alias("temperature_average"))))
    run = grids.running_anomalies(valid, ["x", "y"], "year", "value",
                                  {"temperature_difference_to_average": (-9999, 9999),
                                   "temperature_difference_to_average_until_1990": period}, size)
    maps = run.select((F.col("year") - (size - 1)).alias("year_start"), F.col("year").alias("year_end"), "x", "y",
                      F.col("running").alias("temperature_average"), "temperature_difference_to_average",
                      "temperature_difference_to_average_until_1990")
    by_window = maps.groupBy("year_start", "year_end").agg(F.avg("temperature_average").alias("temperature_average"))
    return {"yearly": country.filter(everything), "special": special.select(rows.alias("_r")).select("_r.*"),
            "running": by_window, "map": maps}


def model_map(cells: DataFrame, first_year: int, box: geo.Box, factor: int, variables: list[str],
              method: str = "bicubic", around: int | None = None, step: float = 1.0, south: float = 0.0) -> DataFrame:
    """Decade means of model grids on a finer grid, one column per variable.

    ``cells``: (variable, year, x, y, value) in kelvin on a grid of ``step`` degrees; x counts from 0 degrees east, y from ``south``.
    The published map refines each slice by the interpolating bicubic spline.  ``around`` is the number of cells of a full circle:
    the refined column at 0 degrees is then repeated at 360 degrees, and the two fall together where longitudes are wrapped.
    """
    celsius = cells.withColumn("value", F.col("value") - 273.15)
    running = grids.centred_mean(celsius, ["variable", "x", "y"], "year", "value", "mean")
    decades = grids.decade_samples(running, ["variable", "x", "y"], "year", first_year)
    slim = decades.select("variable", "year_start", "year_end", "x", "y", F.col("mean").alias("value"))
    regrid = grids.regrid_bilinear if method == "bilinear" else grids.regrid_bicubic
    fine = regrid(slim, ["variable", "year_start", "year_end"], "x", "y", "value", factor)
    if around is not None:
        fine = grids.close_longitude(fine, "fx", float(around * factor))
    placed = fine.withColumns({"longitude": geo.wrap_longitude(F.col("fx") * step / factor), "latitude": F.col("fy") * step / factor + south})
    inside = placed.filter(geo.inside("latitude", "longitude", box))
    return inside.groupBy("year_start", "year_end", "latitude", "longitude").agg(
        *[F.round(F.avg(F.when(F.col("variable") == v, F.col("value"))), 2).alias(v) for v in variables])


def flood_statistics(cells: DataFrame, points: DataFrame, levels_cm: list[int], hectares: float,
                     size: int = 256) -> DataFrame:
    """Cells, hectares and buildings newly flooded per level.

    ``cells``: (x, y, elevation); ``points``: (x, y), one row per building.  Buildings are counted per cell first, so a
    cell with very many buildings is one row in the join.
    """
    connected = flood.connect_levels(cells, size=size)
    per_cell = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_b"))
    joined = connected.join(per_cell, ["x", "y"], "left")
    return (flood.level_counts(joined, levels_cm, {"buildings": F.sum(F.coalesce("_b", F.lit(0)))})
            .withColumn("ha", F.round(F.col("px") * hectares, 1)))


def running_country(yearly: DataFrame, size: int = 10) -> DataFrame:
    """Country running mean over complete windows (a table of one row per year)."""
    w = Window.orderBy("year").rowsBetween(-(size - 1), 0)
    return (yearly.withColumns({"temperature_average": F.avg("temperature_average").over(w), "_n": F.count(F.lit(1)).over(w)})
            .filter(F.col("_n") == size).select((F.col("year") - size + 1).alias("year_start"), F.col("year").alias("year_end"),
                                                "temperature_average"))
