"""A station network out of the given tables: nations are stations, shipments are daily readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteorium.plans import climatology
from meteorium.plans.climatology import Settings
from meteorium.sources import readers

from .inputs import OBS, observations, table

# A lapse rate that is a binary fraction keeps the readings exact, so sums do not depend on their order and published
# roundings agree between engines even on ties.
RATE = 1 / 128
SETTINGS = Settings(baseline=(1996, 1999), drought_baseline=(1995, 1999), trend_start=1995, projection_end=2050, min_years_percentiles=5,
                    min_samples_window=50, min_years_trend=5, min_series_years=5, min_count_years=5, min_count_nonzero=5)


def stations(spark: SparkSession, d: str) -> DataFrame:
    """Every nation with a supplier; two thirds have an id."""
    n = table(spark, d, "nation")
    used = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return n.join(used, "n_nationkey", "left_semi").select(
        F.col("n_name").alias("era5_name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("station_id"),
        (45 + F.col("n_nationkey") / 64).alias("lat"), (13 + F.col("n_nationkey") / 64).alias("lon"),
        (F.col("n_nationkey") * 16).alias("elevation"), (F.col("n_nationkey") * 20).alias("elevation_era5_m"))


def raw(spark: SparkSession, d: str) -> DataFrame:
    """One reading per station and day."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("location"), (F.col("n_nationkey") * 4.0).alias("elevation_diff_m"))
    return observations(spark, d).join(s, "l_suppkey").groupBy("location", "elevation_diff_m", F.col("day").alias("date")).agg(
        F.max("value").alias("temperature_max"), F.min("value").alias("temperature_min"), F.avg("value").alias("temperature_mean"),
        (F.sum("qty") / 64).alias("precipitation_sum"), (F.sum("disc") / 16).alias("et0_evapotranspiration")).withColumn("source", F.lit("era5"))


def data(spark: SparkSession, d: str) -> DataFrame:
    return readers.station_rows(raw(spark, d), ["era5", "era5t"], F.to_date(F.lit("2030-01-01")), rate=RATE)


def days(spark: SparkSession, d: str) -> DataFrame:
    return climatology.days(data(spark, d))


NETWORK = OBS + """, net AS (SELECT n_name AS location, n_nationkey * 4.0::DOUBLE AS diff, n_nationkey AS nk, day, max(value) AS mx, min(value) AS mn, avg(value) AS me,
   sum(qty) / 64 AS p, sum(disc) / 16 AS e FROM obs JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
 stn AS (SELECT location, CASE WHEN nk % 3 <> 0 THEN nk END AS station_id, day, mx + diff * 0.0078125::DOUBLE AS tmax, mn + diff * 0.0078125::DOUBLE AS tmin, me + diff * 0.0078125::DOUBLE AS tmean, p, e FROM net)"""
