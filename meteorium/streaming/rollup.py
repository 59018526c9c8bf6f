"""Sub-hourly measurements to daily rows, and live rows against a climatology.

Every function works on a batch or a streaming DataFrame; tests run both and compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions import categories as cat
from ..functions import curves

# The declared columns of the sub-hourly measurements.
MEASUREMENTS = T.StructType([T.StructField("station_id", T.IntegerType()), T.StructField("timestamp", T.TimestampType())] + [
    T.StructField(c, T.DoubleType()) for c in ("year", "month", "day", "temperature_interval_2m", "temperature_average_2m", "temperature_min_2m", "temperature_max_2m")])


def read_measurements(spark: SparkSession, path: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """Measurements in their declared columns and types; ``columns`` says how to find a column that the files name otherwise.

    A declared column that is not there, or has another type than declared and can't be cast, fails the query.
    """
    rows = spark.read.parquet(path)
    return rows.select(*[(columns or {}).get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in MEASUREMENTS.fields])


def valid_records(rows: DataFrame, year: str, value: str, years: tuple[int, int] = (1800, 2100)) -> DataFrame:
    """Rows with a finite value in a year inside bounds."""
    v = F.col(value)
    return rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.col(year).between(*years))


def daily_extremes(rows: DataFrame, entity: list[str], ts: str, value: str, zone: str = "UTC",
                   late: str = "2 days") -> DataFrame:
    """Minimum, mean and maximum per entity and local calendar day; late rows are accepted up to ``late``.

    Days are tumbling one-day windows of the local wall-clock time.  In a stream a day is emitted once the watermark has
    passed its end (append mode).
    """
    local = rows.withColumn("_local", F.from_utc_timestamp(ts, zone))
    timed = local.withWatermark("_local", late) if rows.isStreaming else local
    agg = timed.groupBy(*entity, F.window("_local", "1 day").alias("_w")).agg(
        F.min(value).alias(f"{value}_min"), F.avg(value).alias(f"{value}_mean"), F.max(value).alias(f"{value}_max"),
        F.count(value).alias("n"))
    return agg.select(*entity, F.to_date(F.col("_w")["start"]).alias("date"), f"{value}_min", f"{value}_mean", f"{value}_max", "n")


def classify_live(rows: DataFrame, climatology: DataFrame, entity: list[str], ts: str, value: str,
                  zone: str = "UTC") -> DataFrame:
    """Live rows joined with the static climatology row of their local month and day (29 February uses 28 February).

    ``climatology``: entity, month_day, p10, p20, p80, p95 and optionally ``distribution``.
    """
    local = rows.withColumn("month_day", cal.month_day_no_leap(cal.date_in_zone(ts, zone)))
    with_curve = "distribution" in climatology.columns
    known = climatology.withColumn("_curve", curves.prepared("distribution")) if with_curve else climatology
    out = local.join(known, [*entity, "month_day"]).withColumn("category_key", cat.temperature_category(value, "p95", "p80", "p20", "p10"))
    return out.withColumn("percentile", curves.cdf_percent("_curve", value)).drop("_curve") if with_curve else out


def valid_measurements(rows: DataFrame, ts: str, value: str) -> DataFrame:
    """Rows with a time after the epoch and a finite value."""
    v = F.col(value)
    return rows.filter((F.col(ts) > F.timestamp_seconds(F.lit(0))) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def quarantined(rows: DataFrame, ts: str, value: str) -> DataFrame:
    """The rows ``valid_measurements`` leaves out."""
    v = F.col(value)
    good = (F.col(ts) > F.timestamp_seconds(F.lit(0))) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return rows.filter(~F.coalesce(good, F.lit(False)))


def start_daily_extremes(rows: DataFrame, entity: list[str], ts: str, value: str, path: str, checkpoint: str,
                         zone: str = "UTC", late: str = "2 days"):
    """Run the daily roll-up over all available input into a Parquet folder."""
    out = daily_extremes(rows, entity, ts, value, zone, late)
    return (out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
