"""Read-outs: a table of requests is answered by one join plan, not by one read per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import categories as cat
from ..functions import curves
from ..functions import numeric as num
from ..operators import density, quality, series

CUTS = ["p5", "p10", "p20", "p50", "p80", "p95"]


def _classify(df: DataFrame, temp: str, climatology: DataFrame, slot: list[str]) -> DataFrame:
    """Rows with their climatology, percentile and category; each climatology row's curve is prepared once, below the join."""
    ready = climatology.withColumn("_curve", curves.prepared("distribution"))
    return df.join(ready, slot).withColumns({
        "percentile": curves.cdf_percent("_curve", temp),
        "category_key": cat.temperature_category(temp, "p95", "p80", "p20", "p10"),
        "day_label": cal.day_label("month", "day")}).drop("_curve")


def today_status(requests: DataFrame, daily: DataFrame, climatology: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Temperature, percentile and category of each request (era5_name, date).

    The archive has priority; a live value (era5_name, date, temperature) fills in and marks the row preliminary.
    Requests without a value or a climatology row are left out.
    """
    base = requests.join(daily.select("era5_name", "date", "temperature_max_2m"), ["era5_name", "date"], "left")
    if live is not None:
        base = base.join(live.select("era5_name", "date", F.col("temperature").alias("_live")), ["era5_name", "date"], "left")
    else:
        base = base.withColumn("_live", F.lit(None).cast("double"))
    d = F.to_date("date")
    valued = base.select("era5_name", "date", F.coalesce("temperature_max_2m", "_live").alias("today_temp"),
                         F.col("temperature_max_2m").isNull().alias("is_preliminary"),
                         F.month(d).alias("month"), F.dayofmonth(d).alias("day")).filter(F.col("today_temp").isNotNull())
    return _classify(valued, "today_temp", climatology, ["era5_name", "month", "day"])


def last_days(requests: DataFrame, daily: DataFrame, climatology: DataFrame, n: int = 7) -> DataFrame:
    """The last ``n`` archived days up to each request date, classified; ``recency`` 1 is the newest.

    Archived days are numbered per station and each request is placed on that numbering, so a request meets ``n`` days, not the
    station's whole history.
    """
    days = daily.select("era5_name", "date", "temperature_max_2m", "month", "day").withColumn(
        "_pos", F.row_number().over(Window.partitionBy("era5_name").orderBy("date")))
    wanted = requests.select("era5_name", "date", F.col("date").alias("request_date")).distinct()
    marks = days.select("era5_name", "date", "_pos").unionByName(wanted, allowMissingColumns=True)
    newest = F.last("_pos", ignorenulls=True).over(Window.partitionBy("era5_name").orderBy("date", F.col("request_date").isNotNull())
                                                   .rowsBetween(Window.unboundedPreceding, 0))
    placed = marks.withColumn("_newest", newest).filter(F.col("request_date").isNotNull() & F.col("_newest").isNotNull())
    asked = placed.select("era5_name", "request_date", "_newest", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_newest") - n + 1), "_newest")).alias("_pos"))
    last = (asked.join(days, ["era5_name", "_pos"]).withColumn("recency", F.col("_newest") - F.col("_pos") + 1).drop("_pos", "_newest")
            .filter(F.col("temperature_max_2m").isNotNull()))
    return _classify(last, "temperature_max_2m", climatology, ["era5_name", "month", "day"])


def national_window(climatology: DataFrame, stations: DataFrame) -> DataFrame:
    """Pooled climatology per day slot: mixture curve, cut-offs read off the curve, summed samples."""
    slot = ["month", "day"]
    pooled = climatology.groupBy(*slot).agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum("n_samples").alias("n_samples"),
        F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"))
    marked = quality.all_or_nothing(pooled, slot, stations)
    curve = density.mixture(climatology, slot, "distribution")
    cuts = {c: curves.quantile("_curve", float(c[1:])) for c in CUTS}
    return marked.join(curve.withColumn("_curve", curves.prepared("distribution")), slot).withColumns(cuts).drop("_curve")


def national_daily(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """Unweighted station mean per date with the pool mark."""
    per = daily.groupBy("date").agg(F.count(F.lit(1)).alias("n_entities"), F.avg("temperature_max_2m").alias("today_temp"))
    return quality.all_or_nothing(per, ["date"], stations)


def national_status(requests: DataFrame, daily: DataFrame, climatology: DataFrame, stations: DataFrame) -> DataFrame:
    """National value, percentile and category per requested date; a partial pool fails the query."""
    d = F.to_date("date")
    mean = quality.require_complete_pool(national_daily(daily.join(requests.select("date").distinct(), "date", "left_semi"), stations))
    valued = mean.select("date", "today_temp", F.month(d).alias("month"), F.dayofmonth(d).alias("day"))
    return _classify(valued, "today_temp", quality.require_complete_pool(national_window(climatology, stations)), ["month", "day"])


def regression_points(trends: DataFrame, baseline: tuple[int, int], key: list[str], more_than: int = 5) -> DataFrame:
    """Scatter points with their anomaly against the baseline mean (all years when too few) and its sign colour."""
    inside = F.filter("scatter", lambda p: p["x"].between(*baseline))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, p: acc + p["y"]) / F.size(a)
    base = F.when(F.size(inside) > more_than, mean(inside)).otherwise(mean(F.col("scatter")))
    points = trends.withColumn("baseline", base).select(*key, "baseline", F.explode("scatter").alias("_p"))
    anomaly = F.col("_p")["y"] - F.col("baseline")
    return points.select(*key, "baseline", F.col("_p")["x"].alias("x"), F.col("_p")["y"].alias("y"), anomaly.alias("anomaly"),
                         F.when(anomaly >= 0, "#c25a2c").otherwise("#3a5a8a").alias("color"))


def trend_lines(trends: DataFrame, key: list[str]) -> DataFrame:
    """Fitted line and interval at the ends of the record and of the projection."""
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col(a).cast("int").alias("x0"), F.col(b).cast("int").alias("x1"))
                               for n, a, b in (("history", "year_min", "year_max"), ("projection", "year_max", "proj_end_year"))]))
    at = lambda s, x: num.line_at(f"slope{s}", f"intercept{s}", F.col("_e")[x])
    return trends.withColumn("_e", ends).select(
        *key, F.col("_e")["part"].alias("part"), F.col("_e")["x0"].alias("x0"), F.col("_e")["x1"].alias("x1"),
        at("", "x0").alias("y0"), at("", "x1").alias("y1"), at("_hi", "x0").alias("upper0"), at("_hi", "x1").alias("upper1"),
        at("_lo", "x0").alias("lower0"), at("_lo", "x1").alias("lower1"))


def milestones(trends: DataFrame, key: list[str], years: tuple[int, ...] = (2030, 2040, 2050)) -> DataFrame:
    """Values of the fitted line at milestone years after the record."""
    return (trends.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years]))).filter(F.col("year") > F.col("year_max"))
            .select(*key, "year", num.line_at("slope", "intercept", "year").alias("value")))


def national_trend(trends: DataFrame, stations: DataFrame, variable: str = "temperature_max") -> DataFrame:
    """Mean line parameters per slot over all stations with the scatter averaged per year."""
    slot = ["month", "day", "day_label"]
    rows = trends.filter(F.col("variable") == variable)
    means = ["p_val", "slope", "intercept", "slope_hi", "intercept_hi", "slope_lo", "intercept_lo"]
    lines = rows.groupBy(*slot).agg(
        F.count(F.lit(1)).alias("n_entities"), num.round_to(F.avg("trend10"), 3).alias("trend10"), num.round_to(F.avg("tau"), 3).alias("tau"),
        *[F.avg(c).alias(c) for c in means], F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        F.max("n_years").alias("n_years"), F.max("proj_end_year").alias("proj_end_year"))
    per_year = (rows.select(*slot, F.explode("scatter").alias("_p")).groupBy(*slot, F.col("_p")["x"].alias("x"))
                .agg(num.round_to(F.avg(F.col("_p")["y"]), 2).alias("y")))
    scatter = per_year.groupBy(*slot).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("scatter"))
    return quality.all_or_nothing(lines.join(scatter, slot), slot, stations)


def trend_calendar(trends: DataFrame, window: int | None = None) -> DataFrame:
    """Trend, significance and strength of every slot of the year."""
    rows = trends if window is None else trends.filter(F.col("window") == window)
    return rows.select("era5_name", "variable", cal.slot_of("month", "day").alias("slot"), "month", "day", "trend10", "p_val",
                       cat.trend_band("trend10").alias("band"), cat.significance_mark("p_val").alias("mark"),
                       cat.variable_unit("variable").alias("unit"))


def count_series(counts: DataFrame) -> DataFrame:
    """Threshold-day series with the empty trend's defaults where no trend was published."""
    t = F.col("trend")
    return counts.select(
        "era5_name", "kind", "threshold", "streak", "years", "counts", "nonzero_count",
        t.isNotNull().alias("has_trend"), F.coalesce(t["rate_per_year"], F.lit(0.0)).alias("rate_per_year"),
        F.coalesce(t["days_per_decade"], F.lit(0.0)).alias("days_per_decade"), F.coalesce(t["p_value"], F.lit(1.0)).alias("p_value"),
        F.coalesce(t["fit_year_max"], F.element_at("years", -1)).alias("fit_year_max"),
        F.coalesce(t["alpha"], F.lit(0.0)).alias("alpha"), F.coalesce(t["aic"], F.lit(0.0)).alias("aic"),
        F.coalesce(t["x_line"], F.array().cast("array<double>")).alias("x_line"),
        F.coalesce(t["y_line"], F.array().cast("array<double>")).alias("y_line"))


def drought_by_station(series_rows: DataFrame) -> DataFrame:
    """One row per station: series name -> (years, spei, trend); a station has at most 17 series."""
    entry = F.struct(F.col("series"), F.struct("years", "spei", "trend"))
    return series_rows.groupBy("era5_name").agg(
        F.map_from_entries(F.collect_list(entry)).alias("series"), F.min(F.element_at("years", 1)).alias("year_min"),
        F.max(F.element_at("years", -1)).alias("year_max"))


def drought_lines(series_rows: DataFrame) -> DataFrame:
    """Fitted end points of every series that has a trend."""
    at = lambda x: F.col("trend")["intercept"] + F.col("trend")["slope_per_decade"] / 10 * x
    first, last = F.element_at("years", 1), F.element_at("years", -1)
    return series_rows.filter(F.col("trend").isNotNull() & (F.size("years") > 0)).select(
        "era5_name", "series", first.alias("x0"), last.alias("x1"), at(first).alias("y0"), at(last).alias("y1"))


def last_data_day(daily: DataFrame) -> DataFrame:
    return daily.agg(F.max("date").alias("date"))


def page(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows; a table that holds more than ``n`` fails instead of being cut silently."""
    got = df.orderBy(*order).limit(n + 1)
    over = got.agg(F.count(F.lit(1)) > n).scalar()
    return got.filter(F.when(over, F.raise_error(F.lit(f"more than {n} rows: the page is truncated"))).cast("boolean").isNull())


def sorted_names(df: DataFrame, name: str, locale: str = "sl") -> DataFrame:
    """Names in the order of a locale, with their place in it (``rank``, from 1)."""
    return series.numbered(df, [F.collate(F.col(name), locale), F.col(name)], "rank")
