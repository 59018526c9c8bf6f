"""Read-outs: request tables answered against the climatology and the trend rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.functions import calendar as cal
from meteorium.functions import numeric as num
from meteorium.operators import counts, density, quantiles, trends, windows
from meteorium.plans import serve
from meteorium.sources import sinks

from . import tables
from .aggregates import THRESHOLD_SQL, threshold_days
from .curves import SEG
from .fits import count_fit_sql
from .inputs import DAILY, daily, day_text, observations
from .polynomials import p_sql
from .trends import SERIES, _fits


def _daily(spark, d):
    x = daily(spark, d)
    return x.select(F.col("entity").alias("era5_name"), day_text("day").alias("date"), F.col("v_max").alias("temperature_max_2m"),
                    F.month("day").alias("month"), F.dayofmonth("day").alias("day"))


def _climatology(spark, d):
    s = windows.pooled_samples(daily(spark, d), ["entity"], "day", "v_max", 7)
    c = density.with_cutoffs(density.gaussian_curve(s), {"p5": 0.05, "p10": 0.1, "p20": 0.2, "p50": 0.5, "p80": 0.8, "p95": 0.95}).drop("samples")
    span = observations(spark, d).groupBy("entity").agg(F.min(F.year("day")).alias("year_min"), F.max(F.year("day")).alias("year_max"))
    return c.join(span, "entity").select(F.col("entity").alias("era5_name"), cal.slot_month("slot").alias("month"), cal.slot_day("slot").alias("day"),
                                         "p5", "p10", "p20", "p50", "p80", "p95", "n_samples", "year_min", "year_max", "distribution")


def _entities(spark, d):
    return observations(spark, d).select(F.col("entity").alias("era5_name")).distinct()


def today_status(spark, d):
    """Every day of 2000 as a request; the archive misses each fifth day and a live value fills in."""
    x = _daily(spark, d)
    req = x.filter("date like '2000%'").select("era5_name", "date")
    archive = x.filter("day % 5 <> 0")
    live = x.select("era5_name", "date", (F.col("temperature_max_2m") - 1).alias("temperature"))
    return serve.today_status(req, archive, _climatology(spark, d), live).select(
        "era5_name", "date", "today_temp", F.col("is_preliminary").cast("int").alias("is_preliminary"), "category_key", "percentile", "day_label")


def last_week(spark, d):
    """The seven days before the 15th of every month of 1999."""
    x = _daily(spark, d)
    req = x.filter("date like '1999-%-15'").select("era5_name", "date")
    return serve.last_days(req, x, _climatology(spark, d)).select("era5_name", "request_date", "date", "temperature_max_2m", "category_key", "percentile", "recency")


def national_windows(spark, d):
    """Pooled climatology of every slot with its cut-offs off the mean curve."""
    n = serve.national_window(sinks.stage({"daily_window": _climatology(spark, d)})["daily_window"], _entities(spark, d))
    return n.select("month", "day", "n_entities", F.col("n_samples").cast("bigint").alias("n_samples"), "pool", F.size("distribution").alias("points"), *serve.CUTS)


def national_status(spark, d):
    """National value, percentile and category of every complete day of 2000."""
    x = _daily(spark, d)
    full = x.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter("n = 3 and date like '2000%'").select("date")
    climatology = sinks.stage({"daily_window": _climatology(spark, d)})["daily_window"]
    return serve.national_status(full, x, climatology, _entities(spark, d)).select("date", "today_temp", "day_label", "category_key", "percentile")


def _trend_rows(spark, d):
    """Trend rows of the three entities in the served form, unrounded."""
    f = _fits(spark, d)
    m, dd = cal.slot_month("slot"), cal.slot_day("slot")
    return f.select(F.col("entity").alias("era5_name"), F.lit("temperature_max").alias("variable"), m.alias("month"), dd.alias("day"), cal.day_label(m, dd).alias("day_label"),
                    F.zip_with("xs", "ys", lambda x, y: F.struct(x.cast("int").alias("x"), y.alias("y"))).alias("scatter"), F.col("x_min").cast("int").alias("year_min"),
                    F.col("x_max").cast("int").alias("year_max"), (F.col("slope") * 10).alias("trend10"), F.col("p_mk").alias("p_val"), "tau", F.col("n").alias("n_years"),
                    F.lit(2050).alias("proj_end_year"), "slope", "intercept", "slope_hi", "intercept_hi", "slope_lo", "intercept_lo")


def regression_points(spark, d):
    return serve.regression_points(_trend_rows(spark, d), (1996, 2000), ["era5_name", "month", "day"], more_than=4)


def trend_lines(spark, d):
    return serve.trend_lines(_trend_rows(spark, d), ["era5_name", "month", "day"])


def national_trends(spark, d):
    t = serve.national_trend(_trend_rows(spark, d), _entities(spark, d))
    return t.select("month", "day", "n_entities", "pool", "slope", "intercept", "p_val", "n_years", F.size("scatter").alias("points"), F.element_at("scatter", 1)["y"].alias("first_y"))


def trend_calendar(spark, d):
    return serve.trend_calendar(_trend_rows(spark, d)).select("era5_name", "slot", "trend10", "p_val", "band", "mark", "unit")


def trend_milestones(spark, d):
    return serve.milestones(_trend_rows(spark, d), ["era5_name", "month", "day"])


def count_series(spark, d):
    """Threshold-day series with their trends; a series without a fit shows the empty trend's defaults."""
    c = threshold_days(spark, d)
    packed = (c.groupBy("entity", "kind", "threshold", "streak").agg(F.sort_array(F.collect_list(F.struct("year", "count"))).alias("s"))
              .select(F.col("entity").alias("era5_name"), "kind", "threshold", "streak", F.transform("s", lambda p: p["year"]).alias("years"),
                      F.transform("s", lambda p: p["count"].cast("int")).alias("counts"), F.size(F.filter("s", lambda p: p["count"] > 0)).alias("nonzero_count")))
    s = serve.count_series(counts.count_trend(packed, 2001, 5, 5))
    return s.select("era5_name", "kind", "threshold", "streak", F.size("years").alias("n_years"), F.aggregate("counts", F.lit(0), lambda a, b: a + b).alias("days"),
                    F.col("has_trend").cast("int").alias("has_trend"), "rate_per_year", "days_per_decade", "p_value", "fit_year_max", "alpha", "aic", F.size("y_line").alias("line"))


def drought_by_station(spark, d):
    """Drought series nested per station, read back series by series."""
    s = serve.drought_by_station(tables.drought_rows(spark, d))
    one = s.select("era5_name", F.size("series").alias("n_series"), "year_min", "year_max", F.explode("series").alias("series", "v"))
    return one.select("era5_name", "n_series", "year_min", "year_max", "series", F.size("v.years").alias("n_years"), F.aggregate("v.spei", F.lit(0.0), lambda a, b: a + b).alias("total"),
                      F.col("v.trend.mk_trend").alias("mk_trend"))


def drought_lines(spark, d):
    return serve.drought_lines(tables.drought_rows(spark, d))


def seasonal_scatter(spark, d):
    """Days around 15 July over all years: line per century and anomalies to the overall median."""
    x = daily(spark, d).select("entity", "day", "v_max")
    near = windows.rows_in_window(x, "day", "07-15", 15).withColumn("year", F.year("day"))
    line = trends.least_squares(near, ["entity"], "year", "v_max")
    mid = quantiles.yearly_percentiles(near, ["entity"], "v_max", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    j = near.join(mid, "entity").groupBy("entity").agg(F.min(F.col("v_max") - F.col("median")).alias("low"), F.max(F.col("v_max") - F.col("median")).alias("high"),
                                                       F.max("p05").alias("p05"), F.max("p95").alias("p95"))
    return line.join(j, "entity").select("entity", "n", "slope", "intercept", "per_century", "low", "high", "p05", "p95")


def seasonal_histogram(spark, d):
    """Count-scaled curve of the days around 15 July and its mass inside the middle 90 percent."""
    x = windows.rows_in_window(daily(spark, d).select("entity", "day", "v_max"), "day", "07-15", 15)
    s = x.groupBy("entity").agg(F.sort_array(F.collect_list("v_max")).alias("samples"))
    h = density.histogram_curve(s).withColumns({"p05": num.sorted_percentile("samples", 0.05), "p95": num.sorted_percentile("samples", 0.95)})
    p = h.select("entity", "p05", "p95", F.explode("distribution").alias("p"))
    mid = F.when(F.col("p")["x"].between(F.col("p05"), F.col("p95")), F.col("p")["d"]).otherwise(0.0)
    return p.groupBy("entity").agg(F.count(F.lit(1)).alias("points"), F.sum(F.col("p")["d"]).alias("total"), F.sum(mid).alias("middle"), F.max(F.col("p")["d"]).alias("peak"))


def last_data_day(spark, d):
    return serve.last_data_day(_daily(spark, d))


CUTS = ", ".join(f"quantile_cont(v_max, {p}) AS {n}" for n, p in (("p10", 0.1), ("p20", 0.2), ("p80", 0.8), ("p95", 0.95)))
CATEGORY = "CASE WHEN t >= p95 THEN 'hell' WHEN t >= p80 THEN 'hot' WHEN t >= p20 THEN 'nope' WHEN t >= p10 THEN 'cold' ELSE 'freezing' END"
STATUS = f"""cut AS (SELECT entity, target AS slot, {CUTS} FROM win GROUP BY ALL),
  part AS (SELECT rq.entity, rq.day, any_value(rq.slot) AS slot, rq.ref, sum(CASE WHEN t >= x1 THEN area WHEN t > x0 THEN (y0 + y0 + (y1 - y0) * (t - x0) / (x1 - x0)) / 2 * (t - x0) ELSE 0 END) AS pt, any_value(t) AS t
    FROM rq JOIN sg ON sg.entity = rq.entity AND sg.slot = rq.slot GROUP BY rq.entity, rq.day, rq.ref),
  st2 AS (SELECT part.*, least(greatest(pt / total * 100, 0), 100) AS percentile, p10, p20, p80, p95 FROM part JOIN tot ON tot.entity = part.entity AND tot.slot = part.slot
    JOIN cut ON cut.entity = part.entity AND cut.slot = part.slot)"""
FIT = f"""WITH {SERIES}, fr AS (SELECT ci.*, ym - slope_lo * xm AS intercept_lo, ym - slope_hi * xm AS intercept_hi, DATE '2001-01-01' + (slot - 1)::INTEGER AS sd FROM ci)"""
MD = "month(sd)::INTEGER AS month, day(sd)::INTEGER AS day"


def _line(part, a, b):
    cols = ", ".join(f"slope{s} * {x} + intercept{s} AS {n}{i}" for s, n in (("", "y"), ("_hi", "upper"), ("_lo", "lower")) for i, x in ((0, a), (1, b)))
    return f"SELECT entity AS era5_name, {MD}, '{part}' AS part, ({a})::INTEGER AS x0, ({b})::INTEGER AS x1, {cols} FROM fr"


# The mean curve of all entities per slot, its prefix areas (mc) and its cut-offs (mq); continues SEG.
POOLED = """, ends AS (SELECT slot, min(x) AS a, max(x) AS b FROM cur GROUP BY slot), mg AS (SELECT *, unnest(range(0, 200)) AS k FROM ends), mx AS (SELECT *, a + (b - a) * k / 199 AS x FROM mg),
  es AS (SELECT entity, slot, min(x0) AS e0, max(x1) AS e1 FROM sg GROUP BY ALL),
  mv AS (SELECT mx.slot, mx.k, mx.x, CASE WHEN mx.x <= e0 OR mx.x >= e1 THEN 0 ELSE (SELECT any_value(y0 + (y1 - y0) * (mx.x - x0) / (x1 - x0)) FROM sg
    WHERE sg.entity = es.entity AND sg.slot = mx.slot AND sg.x0 <= mx.x AND mx.x < sg.x1) END AS d FROM mx JOIN es ON es.slot = mx.slot),
  av AS (SELECT slot, k, x, avg(d) AS d FROM mv GROUP BY ALL), ms AS (SELECT slot, k, x AS x0, d AS y0, lead(x) OVER w AS x1, lead(d) OVER w AS y1 FROM av WINDOW w AS (PARTITION BY slot ORDER BY k)),
  ma AS (SELECT *, (y0 + y1) / 2 * (x1 - x0) AS area FROM ms WHERE x1 IS NOT NULL),
  mc AS (SELECT *, sum(area) OVER (PARTITION BY slot) AS total, sum(area) OVER (PARTITION BY slot ORDER BY k ROWS UNBOUNDED PRECEDING) AS c1 FROM ma),
  mh AS (SELECT *, c1 - area AS c0, unnest([5, 10, 20, 50, 80, 95]) AS p FROM mc),
  mq AS (SELECT slot, p, x0 + 2 * (p / 100 * total - c0) / (y0 + sqrt(y0 * y0 + 2 * (y1 - y0) / (x1 - x0) * (p / 100 * total - c0))) AS q FROM mh WHERE c1 >= p / 100 * total AND c0 < p / 100 * total)"""

QUERIES = {
    "today_status": (today_status, f"""WITH {SEG}, rq AS (SELECT entity, day, slot, CASE WHEN day(day) % 5 = 0 THEN v_max - 1 ELSE v_max END AS t, 0 AS ref FROM ob WHERE year(day) = 2000 AND strftime(day, '%m-%d') <> '02-29'), {STATUS}
      SELECT entity AS era5_name, strftime(day, '%Y-%m-%d') AS date, t AS today_temp, (day(day) % 5 = 0)::INTEGER AS is_preliminary, {CATEGORY} AS category_key, percentile, strftime(day, '%b ') || day(day) AS day_label FROM st2"""),
    "last_week": (last_week, f"""WITH {SEG}, rd AS (SELECT entity, day AS ref FROM ob WHERE year(day) = 1999 AND day(day) = 15),
      rk AS (SELECT ob.entity, ob.day, ob.slot, v_max AS t, ref, row_number() OVER (PARTITION BY ob.entity, ref ORDER BY ob.day DESC) AS rn FROM ob JOIN rd ON rd.entity = ob.entity AND ob.day <= ref),
      rq AS (SELECT * FROM rk WHERE rn <= 7), {STATUS}
      SELECT st2.entity AS era5_name, strftime(st2.ref, '%Y-%m-%d') AS request_date, strftime(st2.day, '%Y-%m-%d') AS date, st2.t AS temperature_max_2m, {CATEGORY.replace("t >=", "st2.t >=")} AS category_key, percentile, rn::INTEGER AS recency
      FROM st2 JOIN rq ON rq.entity = st2.entity AND rq.ref = st2.ref AND rq.day = st2.day"""),
    "national_windows": (national_windows, f"""WITH {SEG}, g AS (SELECT slot, count(*) AS c, sum(n)::BIGINT AS n, DATE '2001-01-01' + (slot - 1)::INTEGER AS sd FROM st GROUP BY slot)
      {POOLED}
      SELECT {MD}, any_value(c) AS n_entities, any_value(n) AS n_samples, CASE WHEN any_value(c) = 3 THEN 'complete' ELSE 'partial' END AS pool, 200 AS points,
        {", ".join(f"max(q) FILTER (WHERE p = {p}) AS p{p}" for p in (5, 10, 20, 50, 80, 95))} FROM g JOIN mq USING (slot) GROUP BY sd"""),
    "national_status": (national_status, f"""WITH {SEG} {POOLED}, t AS (SELECT ob.day AS d, any_value(slot) AS slot, avg(v_max) AS t FROM ob WHERE year(ob.day) = 2000 AND strftime(ob.day, '%m-%d') <> '02-29' GROUP BY ob.day HAVING count(*) = 3),
      pt AS (SELECT t.d, any_value(t.slot) AS slot, any_value(t) AS t, sum(CASE WHEN t >= x1 THEN area WHEN t > x0 THEN (y0 + y0 + (y1 - y0) * (t - x0) / (x1 - x0)) / 2 * (t - x0) ELSE 0 END) / any_value(total) * 100 AS pct FROM t JOIN mc ON mc.slot = t.slot GROUP BY t.d),
      cuts AS (SELECT slot, {", ".join(f"max(q) FILTER (WHERE p = {p}) AS p{p}" for p in (10, 20, 80, 95))} FROM mq GROUP BY slot)
      SELECT strftime(d, '%Y-%m-%d') AS date, t AS today_temp, strftime(d, '%b ') || day(d) AS day_label, {CATEGORY} AS category_key, least(greatest(pct, 0), 100) AS percentile FROM pt JOIN cuts USING (slot)"""),
    "regression_points": (regression_points, FIT + f""", b AS (SELECT entity, slot, CASE WHEN count(*) FILTER (WHERE x BETWEEN 1996 AND 2000) > 4 THEN avg(y) FILTER (WHERE x BETWEEN 1996 AND 2000) ELSE avg(y) END AS baseline FROM good GROUP BY ALL)
      SELECT g.entity AS era5_name, {MD}, baseline, g.x::INTEGER AS x, y, y - baseline AS anomaly, CASE WHEN y - baseline >= 0 THEN '#c25a2c' ELSE '#3a5a8a' END AS color FROM good g
      JOIN b ON b.entity = g.entity AND b.slot = g.slot JOIN fr ON fr.entity = g.entity AND fr.slot = g.slot"""),
    "trend_lines": (trend_lines, FIT + " " + _line("history", "x_min", "x_max") + " UNION ALL " + _line("projection", "x_max", "2050")),
    "national_trends": (national_trends, FIT + f""", pv AS (SELECT fr.*, {p_sql('z_mk')} AS p FROM fr), ys AS (SELECT slot, x, floor(avg(y) * 100 + 0.5) / 100 AS y FROM good GROUP BY ALL),
      yc AS (SELECT slot, count(*) AS points, arg_min(y, x) AS first_y FROM ys GROUP BY slot)
      SELECT {MD}, count(*) AS n_entities, CASE WHEN count(*) = 3 THEN 'complete' ELSE 'partial' END AS pool, avg(slope) AS slope, avg(intercept) AS intercept, avg(p) AS p_val, max(n)::INTEGER AS n_years,
      any_value(points)::INTEGER AS points, any_value(first_y) AS first_y FROM pv JOIN yc USING (slot) GROUP BY sd"""),
    "trend_calendar": (trend_calendar, FIT + f""", pv AS (SELECT fr.*, {p_sql('z_mk')} AS p FROM fr) SELECT entity AS era5_name, slot, slope * 10 AS trend10, p AS p_val,
      CASE WHEN slope * 10 >= 0.3 THEN 'catastrophic' WHEN slope * 10 >= 0.2 THEN 'extreme' WHEN slope * 10 >= 0.1 THEN 'bad' WHEN slope * 10 >= 0.05 THEN 'moderate' ELSE 'baseline' END AS band,
      CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS mark, '°C' AS unit FROM pv"""),
    "trend_milestones": (trend_milestones, FIT + f", m AS (SELECT *, unnest([2030, 2040, 2050]) AS year FROM fr) SELECT entity AS era5_name, {MD}, year::INTEGER AS year, slope * year + intercept AS value FROM m"),
    "count_series": (count_series, f"""WITH RECURSIVE tc AS (SELECT * FROM ({THRESHOLD_SQL})), {count_fit_sql("tc", ["entity", "kind", "threshold", "streak"], 5, 5, "year = 2001")},
      g AS (SELECT entity, kind, threshold, streak, count(*) AS n, sum(count) AS days, max(year) AS last, max(year) FILTER (WHERE year <> 2001) AS fitted FROM tc GROUP BY ALL)
      SELECT entity AS era5_name, kind, threshold, streak, n::INTEGER AS n_years, days::INTEGER AS days, coalesce(fit_ok, false)::INTEGER AS has_trend, coalesce(rate, 0) AS rate_per_year,
        coalesce(per_decade, 0) AS days_per_decade, coalesce(p_value, 1) AS p_value, CASE WHEN fit_ok THEN fitted ELSE last END::INTEGER AS fit_year_max, coalesce(alpha, 0) AS alpha, coalesce(aic, 0) AS aic,
        CASE WHEN fit_ok THEN n ELSE 0 END::INTEGER AS line FROM g LEFT JOIN fits USING (entity, kind, threshold, streak)"""),
    "drought_by_station": (drought_by_station, f"""{tables.DRY_SERIES} SELECT era5_name, (count(DISTINCT series) OVER (PARTITION BY era5_name))::INTEGER AS n_series, min(min(year)) OVER (PARTITION BY era5_name) AS year_min,
      max(max(year)) OVER (PARTITION BY era5_name) AS year_max, series, count(*)::INTEGER AS n_years, sum(spei) AS total, any_value(mk_trend) AS mk_trend FROM sv GROUP BY era5_name, series"""),
    "drought_lines": (drought_lines, f"""{tables.DRY_SERIES} SELECT era5_name, series, min(year) AS x0, max(year) AS x1, any_value(intercept) + any_value(slope_per_decade) / 10 * min(year) AS y0,
      any_value(intercept) + any_value(slope_per_decade) / 10 * max(year) AS y1 FROM sv WHERE slope_per_decade IS NOT NULL GROUP BY era5_name, series"""),
    "seasonal_scatter": (seasonal_scatter, f"""WITH {DAILY}, w AS (SELECT entity, year(day) AS x, v_max AS y FROM daily WHERE strftime(day, '%m-%d') BETWEEN '07-08' AND '07-22'),
      q AS (SELECT entity, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.05) AS p05, quantile_cont(y, 0.95) AS p95 FROM w GROUP BY entity)
      SELECT w.entity, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, 100 * regr_slope(y, x) AS per_century, min(y - med) AS low, max(y - med) AS high,
      any_value(p05) AS p05, any_value(p95) AS p95 FROM w JOIN q USING (entity) GROUP BY w.entity"""),
    "seasonal_histogram": (seasonal_histogram, f"""WITH {DAILY}, s AS (SELECT entity, v_max AS v FROM daily WHERE strftime(day, '%m-%d') BETWEEN '07-08' AND '07-22'),
      st AS (SELECT entity, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS sdp, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.95) AS p95 FROM s GROUP BY entity),
      g AS (SELECT *, least(greatest(CASE WHEN iqr > 0 THEN 2 * iqr / cbrt(n) ELSE 1.06 * sdp / cbrt(n) END, 0.2), 2.5) AS h, unnest(range(0, floor((hi - lo + 4) / 0.1 + 1e-9)::BIGINT + 1)) AS i FROM st),
      c AS (SELECT gx.entity, i, any_value(lo) - 2 + 0.1::DOUBLE * i AS x, any_value(p05) AS p05, any_value(p95) AS p95, any_value(n) AS n, sum(greatest(0, 0.75 * (1 - ((lo - 2 + 0.1::DOUBLE * i - v) / h) ** 2))) / (any_value(n) * any_value(h)) AS d
        FROM g gx JOIN s ON s.entity = gx.entity GROUP BY gx.entity, i),
      y AS (SELECT *, d * n / (sum(d) OVER (PARTITION BY entity) * 0.1) AS k FROM c)
      SELECT entity, count(*) AS points, sum(k) AS total, sum(CASE WHEN x BETWEEN p05 AND p95 THEN k ELSE 0 END) AS middle, max(k) AS peak FROM y GROUP BY entity"""),
    "last_data_day": (last_data_day, "SELECT strftime(max(l_shipdate), '%Y-%m-%d') AS date FROM lineitem"),
}
