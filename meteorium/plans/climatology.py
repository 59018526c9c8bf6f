"""The derived tables of a station network, from lapse-corrected daily rows.

``data`` is the output of ``sources.readers.station_rows``.  ``days(data)`` reduces it to one row per station and day, so
repeated rows of a day or a hot station are combined before anything is ordered; the builders start from that small table.
``all_tables`` writes it to the shared checkpoint folder once, so the raw rows are read once for all tables.  Station lookups
join against the station dimension; Spark broadcasts it while its measured size is below the session's threshold and
shuffles otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import categories as cat
from ..functions import numeric as num
from ..functions import text as txt
from ..session import materialize
from ..operators import counts, density, drought, quantiles, seasons, series, trends, windows

# Measured variables, how each one accumulates over a window, and the percentile cut-offs.
VARIABLES = {"temperature_mean": "avg", "temperature_max": "avg", "temperature_min": "avg",
             "precipitation_sum": "sum", "et0_evapotranspiration": "sum"}
MEAN_CUTS = {"p05": 0.05, "p20": 0.2, "p40": 0.4, "p60": 0.6, "p80": 0.8, "p95": 0.95}
WINDOW_CUTS = {"p5": 0.05, "p10": 0.1, "p20": 0.2, "p50": 0.5, "p80": 0.8, "p95": 0.95}
DAY_THRESHOLDS = list(range(25, 36))
NIGHT_THRESHOLDS = list(range(15, 26))
STREAKS = [1, 2, 3]


@dataclass(frozen=True)
class Settings:
    """Parameters of the derived tables."""

    baseline: tuple[int, int] = (1991, 2020)
    drought_baseline: tuple[int, int] = (1950, 1980)
    trend_start: int = 1950
    projection_end: int = 2050
    window_half: int = 7
    exploration_halves: tuple[int, ...] = (3, 15, 45)
    min_years_percentiles: int = 20
    min_samples_window: int = 50
    min_years_trend: int = 10
    min_season_days: int = 30
    min_month_days: int = 20
    min_series_years: int = 10
    min_count_years: int = 10
    min_count_nonzero: int = 10


def station_table(config: DataFrame, ids: DataFrame, details: DataFrame) -> DataFrame:
    """Config left-joined with ids and details; names fall back to the display form of the entity name."""
    shown = txt.display_name("era5_name")
    return (config.join(ids, "era5_name", "left").join(details, "era5_name", "left")
            .select("era5_name", shown.alias("name"), F.coalesce("official_name", shown).alias("official_name"),
                    F.coalesce("name_locative", F.concat(F.lit("v "), shown)).alias("name_locative"),
                    "station_id", "xml_id", "lat", "lon", "elevation", "elevation_era5_m"))


def metadata_gaps(config: DataFrame, details: DataFrame) -> DataFrame:
    """Stations without details and details without a station."""
    a = config.select("era5_name").join(details.select("era5_name"), "era5_name", "left_anti").withColumn("problem", F.lit("missing"))
    b = details.select("era5_name").join(config.select("era5_name"), "era5_name", "left_anti").withColumn("problem", F.lit("orphan"))
    return a.unionByName(b)


def _ids(stations: DataFrame) -> DataFrame:
    return stations.select(F.col("era5_name").alias("location"), "station_id")


def days(data: DataFrame) -> DataFrame:
    """One row per station and day; duplicates of a day are averaged (maximum for the window table's sample)."""
    return series.daily_rollup(data, ["location"], "date", {
        "temperature_mean": F.avg("temperature_mean_corr"), "temperature_max": F.avg("temperature_max_corr"),
        "temperature_top": F.max("temperature_max_corr"), "temperature_min": F.avg("temperature_min_corr"),
        "precipitation_sum": F.avg("precipitation_sum"), "et0_evapotranspiration": F.avg("et0_evapotranspiration")})


def daily(data: DataFrame, stations: DataFrame) -> DataFrame:
    r = lambda c: num.round_to(f"temperature_{c}_corr", 3)
    d = F.col("date")
    return data.join(_ids(stations), "location", "left").select(
        "station_id", F.col("location").alias("era5_name"), F.date_format(d, "yyyy-MM-dd").alias("date"),
        F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
        r("max").alias("temperature_max_2m"), r("mean").alias("temperature_average_2m"), r("min").alias("temperature_min_2m"))


def daily_percentiles(per_day: DataFrame, stations: DataFrame, s: Settings = Settings(), label_year: int = 2025) -> DataFrame:
    """Percentiles over years of the window mean, per mapped station and slot."""
    mapped = _ids(stations).filter(F.col("station_id").isNotNull())
    years = windows.window_years(per_day.join(mapped, "location"), ["station_id"], "date", {"temperature_mean": "avg"}, [s.window_half])
    cut = quantiles.yearly_percentiles(years, ["station_id", "slot"], "temperature_mean", MEAN_CUTS, s.min_years_percentiles)
    return cut.select(F.date_format(cal.slot_date("slot", label_year), "yyyy-MM-dd").alias("date"), "station_id",
                      *[num.round_to(c, 2).alias(c) for c in MEAN_CUTS])


def daily_window(per_day: DataFrame, stations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Percentiles and density curve of the pooled daily maxima around each slot."""
    pooled = windows.pooled_samples(per_day.filter(F.col("temperature_top").isNotNull()), ["location"], "date",
                                    "temperature_top", s.window_half)
    kept = pooled.filter(F.size("samples") >= s.min_samples_window)
    curves = density.with_cutoffs(density.gaussian_curve(kept), WINDOW_CUTS)
    span = per_day.groupBy("location").agg(F.min(F.year("date")).alias("year_min"), F.max(F.year("date")).alias("year_max"))
    rounded = F.transform("distribution", lambda p: F.struct(num.round_to(p["x"], 3).alias("x"), num.round_to(p["d"], 6).alias("d")))
    return (curves.join(span, "location").join(_ids(stations), "location", "left")
            .select(F.col("location").alias("era5_name"), "station_id", cal.slot_month("slot").alias("month"),
                    cal.slot_day("slot").alias("day"), *[num.round_to(c, 2).alias(c) for c in WINDOW_CUTS],
                    "n_samples", "year_min", "year_max", rounded.alias("distribution")))


def annual_trends(per_day: DataFrame, stations: DataFrame, halves: list[int], s: Settings = Settings()) -> DataFrame:
    """Robust trend of the yearly window value, per station, variable, half-width and slot.

    All variables and half-widths come from one windowed pass over the daily rows.
    """
    years = windows.window_years(per_day, ["location"], "date", VARIABLES, halves)
    recent = years.filter(F.col("window_year") >= s.trend_start)
    long = recent.unpivot(["location", "half", "slot", "window_year"], list(VARIABLES), "variable", "value")
    group = ["location", "variable", "half", "slot"]
    fits = trends.robust_trend(trends.yearly_series(long, group, "window_year", "value"), s.min_years_trend)
    r = num.round_to
    scatter = F.zip_with("xs", "ys", lambda x, y: F.struct(x.cast("int").alias("x"), r(y, 2).alias("y")))
    month, day = cal.slot_month("slot"), cal.slot_day("slot")
    return (fits.join(_ids(stations), "location", "left")
            .select(F.col("location").alias("era5_name"), "station_id", "variable", month.alias("month"), day.alias("day"),
                    cal.day_label(month, day).alias("day_label"), F.col("x_min").cast("int").alias("year_min"),
                    F.col("x_max").cast("int").alias("year_max"), r(F.col("slope") * 10, 3).alias("trend10"),
                    r("p_yw", 5).alias("p_val"), r("tau", 3).alias("tau"), F.col("n").alias("n_years"),
                    F.lit(s.projection_end).alias("proj_end_year"), r("slope", 6).alias("slope"),
                    r("intercept", 4).alias("intercept"), r("slope_hi", 6).alias("slope_hi"),
                    r("intercept_hi", 4).alias("intercept_hi"), r("slope_lo", 6).alias("slope_lo"),
                    r("intercept_lo", 4).alias("intercept_lo"), scatter.alias("scatter"), F.col("half").alias("window")))


def annual_trend(per_day: DataFrame, stations: DataFrame, s: Settings = Settings()) -> DataFrame:
    return annual_trends(per_day, stations, [s.window_half], s).drop("window")


def annual_trend_windows(per_day: DataFrame, stations: DataFrame, s: Settings = Settings()) -> DataFrame:
    return annual_trends(per_day, stations, list(s.exploration_halves), s)


def season_heatmap(per_day: DataFrame, stations: DataFrame, s: Settings = Settings()) -> DataFrame:
    per = seasons.season_aggregate(per_day, ["location"], "date", F.avg("temperature_max"), "avg", s.min_season_days)
    ranked = seasons.rank_seasons(per.withColumn("avg", num.round_to("avg", 2)), ["location", "x"], "avg",
                                  F.col("y").between(*s.baseline))
    return (seasons.with_season_category(ranked).join(_ids(stations), "location", "left")
            .select(F.col("location").alias("era5_name"), "station_id", "x", "y", "season", "avg",
                    num.round_to("percentile", 1).alias("percentile"), "cat", "rank", "total", "color", "n_days"))


def tropical(per_day: DataFrame, stations: DataFrame, s: Settings = Settings(), exclude_year: int | None = None) -> DataFrame:
    """Threshold days and nights per year with their count regression."""
    kinds = {"days": ("temperature_max", DAY_THRESHOLDS), "nights": ("temperature_min", NIGHT_THRESHOLDS)}
    per_year = counts.threshold_counts(per_day, ["location"], "date", kinds, STREAKS)
    group = ["location", "kind", "threshold", "streak"]
    packed = (per_year.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("year", "count"))).alias("_s"))
              .select(*group, F.transform("_s", lambda p: p["year"]).alias("years"),
                      F.transform("_s", lambda p: p["count"].cast("int")).alias("counts")))
    fitted = counts.count_trend(packed, exclude_year, s.min_count_years, s.min_count_nonzero)
    return (fitted.join(_ids(stations), "location", "left")
            .select(F.col("location").alias("era5_name"), "station_id", "kind", F.col("threshold").cast("int").alias("threshold"),
                    "streak", "years", "counts", F.size(F.filter("counts", lambda c: c > 0)).alias("nonzero_count"),
                    "trend", "fit_ok"))


def drought_heatmap(per_day: DataFrame, s: Settings = Settings()) -> DataFrame:
    """National seasonal drought index of the mean water balance over all stations."""
    national = per_day.groupBy("date").agg((F.avg("precipitation_sum") - F.avg("et0_evapotranspiration")).alias("balance"))
    per = seasons.season_aggregate(national, [], "date", F.sum("balance"), "balance", s.min_season_days)
    rounded = per.withColumn("balance", num.round_to("balance", 1))
    base = F.col("y").between(*s.drought_baseline)
    indexed = drought.standardise(rounded, ["x"], "balance", base)
    ranked = seasons.rank_seasons(indexed, ["x"], "balance", F.lit(True), highest_first=False)
    return (ranked.withColumn("cat", cat.drought_category("spei")).withColumn("color", cat.drought_color("cat"))
            .select("x", "y", num.round_to("spei", 2).alias("spei"), "balance", "cat", "rank", "total", "color", "season", "n_days"))


def drought_series(per_day: DataFrame, stations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per station: four seasonal, one annual and twelve monthly index series with their trend."""
    balance = F.col("precipitation_sum") - F.col("et0_evapotranspiration")
    months = per_day.groupBy("location", F.year("date").alias("_y"), F.month("date").alias("_m")).agg(
        F.coalesce(F.sum(balance), F.lit(0.0)).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max("date").alias("_max"))
    last = months.agg(F.max("_max")).scalar()
    # every month belongs to its own series and to a season; seasons add up three of these rows
    month_name = F.element_at(F.array(*[F.lit(m) for m in cal.MONTHS]), F.col("_m"))
    season = cal.season_index("_m")
    season_year = (F.col("_y") + F.when(F.col("_m") == 12, 1).otherwise(0)).cast("int")
    kinds = F.explode(F.array(
        F.struct(month_name.alias("series"), F.col("_y").alias("y"), cal.month_end("_y", "_m").alias("end"), F.lit(s.min_month_days).alias("least")),
        F.struct(cal.season_name(season).alias("series"), season_year.alias("y"), cal.season_end(season_year, season).alias("end"),
                 F.lit(s.min_season_days).alias("least"))))
    group = ["location", "series"]
    rows = (months.withColumn("_k", kinds).select("location", "_k.*", "_sum", "_n")
            .groupBy(*group, "y", "end", "least").agg(F.sum("_sum").alias("balance"), F.sum("_n").alias("n_days"))
            .filter((F.col("n_days") >= F.col("least")) & (F.col("end") <= last))
            .withColumn("_years", F.count(F.lit(1)).over(Window.partitionBy(*group)))
            .filter(F.col("_years") >= s.min_series_years).select(*group, "y", "balance"))
    indexed = drought.standardise(rows, group, "balance", F.col("y").between(*s.drought_baseline))
    rounded = indexed.select("location", "y", "series", num.round_to("spei", 2).alias("spei"))
    # a seasonal value also counts for the year's mean; every other series has one value per year
    both = F.explode(F.when(F.col("series").isin(cal.SEASONS), F.array(F.col("series"), F.lit("Annual"))).otherwise(F.array("series")))
    values = (rounded.select("location", "y", both.alias("series"), "spei").groupBy(*group, "y")
              .agg(F.sum(F.rint(F.col("spei") * 100).cast("long")).alias("_s"), F.count("spei").alias("_n"))  # whole hundredths: no order of addition, exact ties
              .filter((F.col("series") != "Annual") | (F.col("_n") >= 2))
              .select(*group, "y", (F.floor(F.col("_s") / F.col("_n") + 0.5) / 100).alias("spei")))
    fitted = trends.robust_trend(trends.yearly_series(values, group, "y", "spei"), s.min_series_years, drop_short=False)
    trend = F.when(F.col("slope").isNotNull(), F.struct(
        num.round_to(F.col("slope") * 10, 3).alias("slope_per_decade"), num.round_to("p_mk", 3).alias("p_value"),
        F.col("verdict").alias("mk_trend"), num.round_to("intercept", 3).alias("intercept")))
    return (fitted.join(_ids(stations), "location", "left")
            .select(F.col("location").alias("era5_name"), "station_id", "series",
                    F.transform("xs", lambda x: x.cast("int")).alias("years"), F.col("ys").alias("spei"), trend.alias("trend")))


def all_tables(data: DataFrame, stations: DataFrame, s: Settings = Settings(), exclude_year: int | None = None) -> dict[str, DataFrame]:
    """All derived tables by name, from one reading of the raw rows."""
    per_day = materialize(days(data))
    return {"stations": stations, "daily": daily(data, stations), "daily_percentiles": daily_percentiles(per_day, stations, s),
            "daily_window": daily_window(per_day, stations, s), "annual_trend": annual_trend(per_day, stations, s),
            "annual_trend_windows": annual_trend_windows(per_day, stations, s), "season_heatmap": season_heatmap(per_day, stations, s),
            "tropical": tropical(per_day, stations, s, exclude_year), "spei": drought_heatmap(per_day, s),
            "spei_station": drought_series(per_day, stations, s)}
