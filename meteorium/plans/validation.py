"""Rule sets of the raw rows and of the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions import categories as cat
from ..functions import text as txt
from ..operators import quality as q
from .climatology import VARIABLES

# Physical bounds.
TEMPERATURE = (-50.0, 45.0)
LATITUDE, LONGITUDE, ELEVATION = (45.0, 47.0), (13.0, 17.0), (0.0, 3000.0)
PRECIPITATION, EVAPORATION = (0.0, 500.0), (0.0, 25.0)
SOURCES = ["era5", "era5t"]
# The columns of a raw station file, none of which may be null, and the derived columns that may be.
RAW_COLUMNS = ["location", "latitude", "longitude", "elevation_station_m", "elevation_era5_m", "elevation_diff_m", "date", "temperature_max",
               "temperature_min", "temperature_mean", "precipitation_sum", "et0_evapotranspiration", "source"]
NULLABLE = {"station_id", "xml_id", "trend"}
TABLES = ["stations", "daily", "daily_percentiles", "daily_window", "annual_trend", "annual_trend_windows",
          "season_heatmap", "tropical", "spei", "spei_station"]


# The number columns of the raw rows and of the derived tables, as declared.
RAW_TYPES = {**dict.fromkeys(["latitude", "longitude", "elevation_era5_m", "elevation_diff_m", "temperature_max", "temperature_min", "temperature_mean", "precipitation_sum",
                              "et0_evapotranspiration"], "double"), "elevation_station_m": "int"}
WHOLE = ["station_id", "year", "month", "day", "n_samples", "year_min", "year_max", "n_years", "proj_end_year", "window", "x", "y", "rank", "total", "n_days", "threshold", "streak",
         "nonzero_count", "elevation", "elevation_era5_m"]
REAL = ["lat", "lon", "temperature_max_2m", "temperature_average_2m", "temperature_min_2m", "p05", "p5", "p10", "p20", "p40", "p50", "p60", "p80", "p95", "trend10", "p_val", "tau", "slope", "intercept",
        "slope_hi", "intercept_hi", "slope_lo", "intercept_lo", "avg", "percentile", "balance", "spei"]
TABLE_TYPES = {**dict.fromkeys(WHOLE, "int"), **dict.fromkeys(REAL, "double")}


def _as_type(text: Column, dtype: str) -> Column:
    """Text as a number, null where it is none; a whole number may be written with a fraction of zero."""
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.cast("int")) if dtype == "int" else number


def typed(df: DataFrame, table: str, key: list[str], declared: dict[str, str]) -> tuple[DataFrame, DataFrame | None]:
    """The table with its text columns as declared, the texts beside them, and the texts that are not of their declared type as violations."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and declared.get(f.name, "string") != "string"]
    if not texts:
        return df, None
    rules = [q.RowRule("castable", c, F.col(c).isNotNull() & _as_type(F.col(c), declared[c]).isNull()) for c in texts]
    out = df.withColumns({f"{TEXT}{c}": F.col(c) for c in texts}).withColumns({c: _as_type(F.col(c), declared[c]) for c in texts})
    return out, q.row_violations(df, table, key, rules)


def _on_text(df: DataFrame, rules: list[q.RowRule]) -> list[q.RowRule]:
    """Null rules look at the text where there is one, so that a text that is no number is reported once, as such."""
    return [q.RowRule(r.name, r.column, F.col(f"{TEXT}{r.column}").isNull(), (f"{TEXT}{r.column}",)) if r.name == "not_null" and f"{TEXT}{r.column}" in df.columns else r for r in rules]


TEXT = "_text_"


def raw_violations(raw: DataFrame, config: DataFrame, declared: list[str] | None = None) -> DataFrame:
    """Every rule of the raw station rows.  ``raw`` has one ``sequence`` number per row in file order.

    Where ``raw`` has a ``file_name``, its stem must be the location of every row of the file.
    """
    t = "raw"
    given = raw
    raw, untyped = typed(raw, t, ["location", "date"], RAW_TYPES)
    temps = ["temperature_max", "temperature_min", "temperature_mean"]
    rules = [*[q.not_null(c) for c in RAW_COLUMNS if c != "date"], q.parseable_date("date"),
             q.in_range("latitude", *LATITUDE), q.in_range("longitude", *LONGITUDE),
             q.in_range("elevation_station_m", *ELEVATION), q.in_range("elevation_era5_m", *ELEVATION),
             *[q.in_range(c, *TEMPERATURE) for c in temps], q.in_range("precipitation_sum", *PRECIPITATION),
             q.in_range("et0_evapotranspiration", *EVAPORATION), q.one_of("source", SOURCES),
             q.non_decreasing(["temperature_min", "temperature_mean", "temperature_max"])]
    dated = raw.withColumn("date", F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")))).filter("date is not null")
    want = config.select(F.col("era5_name").alias("location"),
                         (F.col("elevation_era5_m") - F.col("elevation")).cast("double").alias("elevation_diff_m"))
    have = raw.groupBy("location").agg(F.min("elevation_diff_m").alias("elevation_diff_m"), F.max("elevation_diff_m").alias("_high"))
    off = have.join(want.withColumnRenamed("elevation_diff_m", "_w"), "location").filter(
        (F.abs(F.col("elevation_diff_m") - F.col("_w")) > 1e-6) | (F.abs(F.col("_high") - F.col("_w")) > 1e-6))
    reports = [q.row_violations(raw, t, ["location", "date"], _on_text(raw, rules)), *([untyped] if untyped is not None else []),
               q.expected_entities(raw, t, "location", want, "location"),
               q.daily_continuity(dated, t, ["location"], "date"),
               q.increasing_dates(dated, t, ["location"], "sequence", "date"),
               q.constant_per_group(raw, t, ["location"], "elevation_diff_m"),
               q.report(off, t, "elevation_matches_config", F.col("location"), "elevation_diff_m", F.col("elevation_diff_m"))]
    if "file_name" in raw.columns:
        stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
        reports.append(q.row_violations(raw, t, ["file_name", "sequence"], [
            q.RowRule("location_is_file", "location", ~F.col("location").eqNullSafe(stem), ("file_name",))]))
    reports.append(q.column_set(given.drop("sequence", "file_name"), t, RAW_COLUMNS if declared is None else declared))
    return q.all_of(reports)


def _rules(names: list[str], years: tuple[int, int]) -> dict[str, list[q.RowRule]]:
    year = lambda c: q.in_range(c, *years)
    temps = lambda cols: [r for c in cols for r in (q.not_null(c), q.in_range(c, *TEMPERATURE))]
    month_day = [q.in_range("month", 1, 12), q.in_range("day", 1, 31)]
    window_cuts = ["p5", "p10", "p20", "p50", "p80", "p95"]
    mean_cuts = ["p05", "p20", "p40", "p60", "p80", "p95"]
    trend = [q.one_of("era5_name", names), q.one_of("variable", list(VARIABLES)), *month_day, year("year_min"), year("year_max"),
             q.in_range("p_val", 0, 1), q.in_range("tau", -1, 1), q.at_least("n_years", 10),
             q.holds("year_order", "year_min", F.col("year_min") <= F.col("year_max"), ("year_max",)),
             q.holds("year_span", "n_years", F.col("n_years") == F.col("year_max") - F.col("year_min") + 1, ("year_min", "year_max"))]
    heat = [q.in_range("x", 0, 3), year("y"), q.one_of("season", cal.SEASONS), q.at_least("rank", 1),
            q.holds("rank_total", "rank", F.col("rank") <= F.col("total"), ("total",)), q.at_least("n_days", 30)]
    return {
        "stations": [q.one_of("era5_name", names), q.in_range("lat", *LATITUDE), q.in_range("lon", *LONGITUDE),
                     q.in_range("elevation", *ELEVATION), q.in_range("elevation_era5_m", *ELEVATION)],
        "daily": [q.one_of("era5_name", names), year("year"), *month_day,
                  *temps(["temperature_max_2m", "temperature_average_2m", "temperature_min_2m"]),
                  q.non_decreasing(["temperature_min_2m", "temperature_average_2m", "temperature_max_2m"])],
        "daily_percentiles": [q.not_null("station_id"), *temps(mean_cuts), q.non_decreasing(mean_cuts)],
        "daily_window": [q.one_of("era5_name", names), *month_day, *temps(window_cuts), q.non_decreasing(window_cuts),
                         q.at_least("n_samples", 50), year("year_min"), year("year_max"),
                         q.holds("year_order", "year_min", F.col("year_min") <= F.col("year_max"), ("year_max",))],
        "annual_trend": trend,
        "annual_trend_windows": [*trend, q.one_of("window", [3, 15, 45])],
        "season_heatmap": [q.one_of("era5_name", names), *heat, *temps(["avg"]), q.in_range("percentile", 0, 100),
                           q.one_of("cat", list(cat.SEASON_COLORS)), q.maps_to("cat", "color", cat.SEASON_COLORS)],
        "tropical": [q.one_of("era5_name", names), q.one_of("kind", ["days", "nights"]), q.in_range("threshold", 15, 35),
                     q.one_of("streak", [1, 2, 3]), q.at_least("nonzero_count", 0),
                     q.implies_range(F.col("kind") == "days", "threshold", 25, 35, ("kind",)),
                     q.implies_range(F.col("kind") == "nights", "threshold", 15, 25, ("kind",)),
                     q.holds("nonzero_count", "nonzero_count",
                             F.col("nonzero_count") == F.size(F.filter("counts", lambda c: c > 0)), ("counts",))],
        "spei": [*heat, q.in_range("spei", -3, 3), q.one_of("cat", list(cat.DROUGHT_COLORS)),
                 q.maps_to("cat", "color", cat.DROUGHT_COLORS)],
        "spei_station": [q.one_of("era5_name", names)],
    }


KEYS = {"stations": ["era5_name"], "daily": ["era5_name", "date"], "daily_percentiles": ["station_id", "date"],
        "daily_window": ["era5_name", "month", "day"], "annual_trend": ["era5_name", "variable", "month", "day"],
        "annual_trend_windows": ["era5_name", "variable", "month", "day", "window"], "season_heatmap": ["era5_name", "x", "y"],
        "tropical": ["era5_name", "kind", "threshold", "streak"], "spei": ["x", "y"], "spei_station": ["era5_name", "series"]}
UNIQUE = ["stations", "daily_window", "annual_trend", "annual_trend_windows"]


def table_violations(tables: dict[str, DataFrame], config: DataFrame, names: list[str], years: tuple[int, int],
                     declared: dict[str, list[str]] | None = None) -> DataFrame:
    """Every rule of the derived tables, in one report.  ``names`` are the configured entities.

    Tables may come as text (as read from CSV): number columns are then read as declared, and what is no number is reported.  Where both
    the stations and the config have a ``position``, the order of the stations is compared too.
    """
    spark = config.sparkSession
    reports = [q.missing_tables(spark, list(tables), TABLES)]
    rules = _rules(names, years)
    tables, given = dict(tables), tables
    for name, df in given.items():
        df, untyped = typed(df, name, [c for c in KEYS[name] if c in df.columns], TABLE_TYPES)
        tables[name] = df
        reports += [untyped] if untyped is not None else []
        filled = [q.not_null(c) for c in given[name].columns if c not in NULLABLE and not any(r.name == "not_null" and r.column == c for r in rules[name])]
        shown = [q.holds("display_name", "name", F.col("name") == txt.display_name("era5_name"), ("era5_name",))] if name == "stations" and "name" in df.columns else []
        reports.append(q.row_violations(df, name, KEYS[name], _on_text(df, [*rules[name], *filled, *shown])))
        if declared is not None:
            reports.append(q.column_set(given[name], name, declared[name]))
        if name in UNIQUE and set(KEYS[name]) <= set(df.columns):
            reports.append(q.unique_key(df, name, KEYS[name]))
    has = lambda name, *columns: name in tables and set(columns) <= set(tables[name].columns)  # noqa: E731  a lost column is reported above
    t = tables
    if has("stations", "era5_name", "lat", "lon", "elevation", "elevation_era5_m"):
        reports.append(q.equals_config(t["stations"], "stations", "era5_name", config,
                                       ["lat", "lon", "elevation", "elevation_era5_m", *(["position"] if has("stations", "position") and "position" in config.columns else [])]))
    if has("daily", "era5_name", "date"):
        dated = t["daily"].withColumn("date", F.to_date("date"))
        reports += [q.entity_count(dated, "daily", "era5_name", len(names)), q.daily_continuity(dated, "daily", ["era5_name"], "date")]
    if has("daily_window", "era5_name"):
        reports.append(q.group_size(t["daily_window"], "daily_window", ["era5_name"], 365))
    if has("daily_percentiles", "station_id"):
        reports.append(q.group_size(t["daily_percentiles"], "daily_percentiles", ["station_id"], 365))
    if has("daily", "era5_name", "year") and has("daily_window", "era5_name", "year_min", "year_max"):
        reports.append(q.same_bounds(t["daily_window"], "daily_window", "era5_name", "year_min", "year_max", t["daily"], "year"))
    if has("daily_percentiles", "station_id") and has("stations", "station_id"):
        reports.append(q.subset_of(t["daily_percentiles"], "daily_percentiles", "station_id", t["stations"], "station_id"))
    if has("spei", "x", "balance", "spei"):
        reports += [q.monotone(t["spei"], "spei", ["x"], "balance", "spei"), q.not_collapsed(t["spei"], "spei", ["x"], "spei")]
    if has("spei_station", *KEYS["spei_station"], "years", "spei"):
        reports.append(q.array_series(t["spei_station"], "spei_station", KEYS["spei_station"], "years", "spei"))
    if has("tropical", *KEYS["tropical"], "trend", "fit_ok"):
        reports.append(q.untrusted_published(t["tropical"], "tropical", KEYS["tropical"]))
    return q.all_of(reports)
