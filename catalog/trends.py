"""Trends of yearly series per entity and slot."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.functions import categories as cat
from meteorium.functions import numeric as num
from meteorium.operators import counts, drought, seasons, trends, windows

from .aggregates import SEASON_SQL, THRESHOLD_SQL, threshold_days
from .fits import count_fit_sql, drought_sql
from .inputs import DAILY, OBS, daily, observations, window_sql
from .polynomials import p_sql


def _series(spark, d, half=7):
    years = windows.window_years(daily(spark, d), ["entity"], "day", {"v_mean": "avg"}, [half])
    return trends.yearly_series(years, ["entity", "slot"], "window_year", "v_mean")


def _fits(spark, d):
    return trends.robust_trend(_series(spark, d), 5)


def pair_slopes(spark, d):
    """Number and extremes of the pair slopes behind each fitted line, counted from the series length."""
    f = _fits(spark, d)
    return f.select("entity", "slot", F.col("n").cast("bigint").alias("n"), (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), "slope")


def theil_sen(spark, d):
    return _fits(spark, d).select("entity", "slot", "slope", "intercept", "x_min", "x_max")


def theil_sen_interval(spark, d):
    return _fits(spark, d).select("entity", "slot", "slope_lo", "slope_hi", "intercept_lo", "intercept_hi")


def mann_kendall(spark, d):
    return _fits(spark, d).select("entity", "slot", "s", "var_s", "tau", "z_mk", "p_mk")


def yue_wang(spark, d):
    return _fits(spark, d).select("entity", "slot", "correction", "z_yw", "p_yw")


def trend_verdicts(spark, d):
    return _fits(spark, d).groupBy("entity", "verdict").agg(F.count(F.lit(1)).alias("n"))


def least_squares(spark, d):
    o = observations(spark, d).select("entity", F.month("day").alias("month"), F.year("day").alias("year"), "value")
    return trends.least_squares(o, ["entity", "month"], "year", "value")


def count_regression(spark, d):
    """Count regression of the threshold-day series, one fit per series (limits loosened to the length of the data)."""
    c = threshold_days(spark, d)
    packed = (c.groupBy("entity", "kind", "threshold", "streak").agg(F.sort_array(F.collect_list(F.struct("year", "count"))).alias("s"))
              .select("entity", "kind", "threshold", "streak", F.transform("s", lambda p: p["year"]).alias("years"),
                      F.transform("s", lambda p: p["count"].cast("int")).alias("counts")))
    fit = counts.count_trend(packed, 2001, min_years=5, min_nonzero=5)
    return fit.select("entity", "kind", "threshold", "streak", "fit_ok", F.col("trend.rate_per_year").alias("rate"),
                      F.col("trend.days_per_decade").alias("per_decade"), F.col("trend.p_value").alias("p_value"))


def drought_index(spark, d):
    """Seasonal drought index of each entity's water balance."""
    s = seasons.season_aggregate(daily(spark, d), ["entity"], "day", F.sum(F.col("wet") - F.col("dry")), "balance", 30)
    return drought.standardise(s, ["entity", "x"], "balance", F.col("y").between(1995, 1999), "spei").select(
        "entity", "x", "y", "balance", num.round_to("spei", 4).alias("spei"))


def clipped_statistics(spark, d):
    """p-values and rates held inside their published limits and rounded."""
    f = _fits(spark, d)
    return f.select("entity", "slot", num.round_to(num.clamp("p_mk", 0.0001, 0.9999), 3).alias("p"),
                    num.round_to(num.clamp(F.col("slope") * 10, -50.0, 50.0), 2).alias("per_decade"))


def trend_bands(spark, d):
    """Strength band, significance mark, total change and years per unit of each fitted line."""
    f = _fits(spark, d)
    return f.select("entity", "slot", cat.trend_band(F.col("slope") * 10).alias("band"), cat.significance_mark("p_mk").alias("mark"),
                    (F.col("slope") * (F.col("x_max") - F.col("x_min"))).alias("total_change"), F.abs(1 / F.col("slope")).alias("years_per_unit"),
                    (F.col("slope") * 100).alias("per_century"))


def fitted_line_ends(spark, d):
    """Line and interval at the ends of the record and at a projection year."""
    f = _fits(spark, d)
    at = lambda s, x: num.line_at(f"slope{s}", f"intercept{s}", x)
    return f.select("entity", "slot", at("", "x_min").alias("start"), at("", "x_max").alias("end"), at("", F.lit(2050)).alias("projected"),
                    at("_lo", "x_max").alias("end_lo"), at("_hi", "x_max").alias("end_hi"))


SERIES = window_sql(7) + """, ser AS (SELECT entity, CAST(target AS INTEGER) AS slot, wy AS x, avg(v_mean) AS y FROM win GROUP BY ALL),
 idx AS (SELECT *, row_number() OVER (PARTITION BY entity, slot ORDER BY x) AS i, count(*) OVER (PARTITION BY entity, slot) AS n FROM ser),
 good AS (SELECT * FROM idx WHERE n >= 5),
 pairs AS (SELECT a.entity, a.slot, a.n, a.i AS i, b.i AS j, (b.y - a.y) / (b.x - a.x) AS slope, (b.y - a.y) / (b.i - a.i) AS step, sign(b.y - a.y) AS sg
   FROM good a JOIN good b ON a.entity = b.entity AND a.slot = b.slot AND a.x < b.x),
 med AS (SELECT entity, slot, quantile_cont(x, 0.5) AS xm, quantile_cont(y, 0.5) AS ym, min(x)::DOUBLE AS x_min, max(x)::DOUBLE AS x_max, any_value(n) AS n FROM good GROUP BY ALL),
 ties AS (SELECT entity, slot, sum(t * (t - 1) * (2 * t + 5)) AS tt FROM (SELECT entity, slot, y, count(*) AS t FROM good GROUP BY ALL) GROUP BY ALL),
 fit AS (SELECT p.entity, p.slot, any_value(p.n) AS n, count(*) AS m, quantile_cont(p.slope, 0.5) AS slope, quantile_cont(p.step, 0.5) AS step, sum(sg) AS s,
   list_sort(list(p.slope)) AS sl FROM pairs p GROUP BY ALL),
 mk AS (SELECT f.*, med.xm, med.ym, med.x_min, med.x_max, (f.n * (f.n - 1) * (2 * f.n + 5) - tt) / 18 AS var_s, f.s / (f.n * (f.n - 1) / 2) AS tau
   FROM fit f JOIN med USING (entity, slot) JOIN ties USING (entity, slot)),
 sc AS (SELECT *, CASE WHEN var_s > 0 THEN (CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END) / sqrt(var_s) END AS z_mk,
   least(round_even((m + 1.959963984540054::DOUBLE * sqrt(var_s)) / 2, 0)::BIGINT, m - 1) AS ru,
   greatest(round_even((m - 1.959963984540054::DOUBLE * sqrt(var_s)) / 2, 0)::BIGINT - 1, 0) AS rl FROM mk),
 ci AS (SELECT *, sl[rl + 1] AS slope_lo, sl[ru + 1] AS slope_hi, ym - slope * xm AS intercept FROM sc),
 det AS (SELECT g.entity, g.slot, g.i, g.y - f.step * g.i AS e FROM good g JOIN fit f USING (entity, slot)),
 dev AS (SELECT *, e - avg(e) OVER (PARTITION BY entity, slot) AS dv FROM det),
 cross_terms AS (SELECT a.entity, a.slot, sum((1 - (b.i - a.i) / f.n) * a.dv * b.dv) AS cr FROM dev a JOIN dev b ON a.entity = b.entity AND a.slot = b.slot AND a.i < b.i
   JOIN fit f ON f.entity = a.entity AND f.slot = a.slot GROUP BY ALL),
 power AS (SELECT entity, slot, sum(dv * dv) AS pw FROM dev GROUP BY ALL),
 yw AS (SELECT sc.*, 1 + 2 * cr / pw AS correction FROM sc JOIN cross_terms USING (entity, slot) JOIN power USING (entity, slot))"""
ZYW = "CASE WHEN var_s * correction > 0 THEN (CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END) / sqrt(var_s * correction) END"

QUERIES = {
    "pair_slopes": (pair_slopes, f"WITH {SERIES} SELECT entity, slot, n, m AS pairs, slope FROM fit"),
    "theil_sen": (theil_sen, f"WITH {SERIES} SELECT entity, slot, slope, intercept, x_min, x_max FROM ci"),
    "theil_sen_interval": (theil_sen_interval, f"WITH {SERIES} SELECT entity, slot, slope_lo, slope_hi, ym - slope_lo * xm AS intercept_lo, ym - slope_hi * xm AS intercept_hi FROM ci"),
    "mann_kendall": (mann_kendall, f"WITH {SERIES} SELECT entity, slot, s::DOUBLE AS s, var_s::DOUBLE AS var_s, tau, z_mk, {p_sql('z_mk')} AS p_mk FROM sc"),
    "yue_wang": (yue_wang, f"WITH {SERIES}, z AS (SELECT *, {ZYW} AS z_yw FROM yw) SELECT entity, slot, correction, z_yw, CASE WHEN z_yw IS NOT NULL THEN {p_sql('z_yw')} END AS p_yw FROM z"),
    "trend_verdicts": (trend_verdicts, f"""WITH {SERIES}, p AS (SELECT *, {p_sql('z_mk')} AS p_mk FROM sc)
      SELECT entity, CASE WHEN p_mk < 0.05 AND z_mk > 0 THEN 'increasing' WHEN p_mk < 0.05 AND z_mk < 0 THEN 'decreasing' ELSE 'no trend' END AS verdict, count(*) AS n
      FROM p GROUP BY ALL"""),
    "least_squares": (least_squares, f"""WITH {OBS}, o AS (SELECT entity, month(day)::INTEGER AS month, year(day) AS x, value AS y FROM obs)
      SELECT entity, month, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, 100 * regr_slope(y, x) AS per_century,
      min(x)::INTEGER AS x_min, max(x)::INTEGER AS x_max FROM o GROUP BY ALL"""),
    "count_regression": (count_regression, f"""WITH RECURSIVE tc AS (SELECT * FROM ({THRESHOLD_SQL})), {count_fit_sql("tc", ["entity", "kind", "threshold", "streak"], 5, 5, "year = 2001")},
      ks AS (SELECT DISTINCT entity, kind, threshold, streak FROM tc)
      SELECT ks.*, coalesce(fit_ok, true) AS fit_ok, rate, per_decade, p_value FROM ks LEFT JOIN fits USING (entity, kind, threshold, streak)"""),
    "drought_index": (drought_index, f"""WITH RECURSIVE {DAILY}, {SEASON_SQL}, {drought_sql("complete", ["entity", "x"], "bal", "y BETWEEN 1995 AND 1999")}
      SELECT entity, x, y, bal AS balance, floor(spei * 10000 + 0.5) / 10000 AS spei FROM dry"""),
    "clipped_statistics": (clipped_statistics, f"""WITH {SERIES} SELECT entity, slot, floor(least(greatest({p_sql('z_mk')}, 0.0001), 0.9999) * 1000 + 0.5) / 1000 AS p,
      floor(least(greatest(slope * 10, -50), 50) * 100 + 0.5) / 100 AS per_decade FROM sc"""),
    "trend_bands": (trend_bands, f"""WITH {SERIES}, p AS (SELECT *, {p_sql('z_mk')} AS p_mk FROM sc) SELECT entity, slot,
      CASE WHEN slope * 10 >= 0.3 THEN 'catastrophic' WHEN slope * 10 >= 0.2 THEN 'extreme' WHEN slope * 10 >= 0.1 THEN 'bad' WHEN slope * 10 >= 0.05 THEN 'moderate' ELSE 'baseline' END AS band,
      CASE WHEN p_mk < 0.001 THEN '***' WHEN p_mk < 0.01 THEN '**' WHEN p_mk < 0.05 THEN '*' ELSE 'ns' END AS mark,
      slope * (x_max - x_min) AS total_change, abs(1 / slope) AS years_per_unit, slope * 100 AS per_century FROM p"""),
    "fitted_line_ends": (fitted_line_ends, f"""WITH {SERIES} SELECT entity, slot, slope * x_min + intercept AS start, slope * x_max + intercept AS "end",
      slope * 2050 + intercept AS projected, slope_lo * x_max + (ym - slope_lo * xm) AS end_lo, slope_hi * x_max + (ym - slope_hi * xm) AS end_hi FROM ci"""),
}
