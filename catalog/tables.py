"""The derived tables of the station network."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium import session
from meteorium.functions import categories
from meteorium.operators import quality
from meteorium.plans import climatology as plan
from meteorium.plans import validation
from meteorium.sources import sinks

from . import network
from .fits import count_fit_sql, drought_sql
from .inputs import WINDOW_JOIN, slot_sql
from .network import NETWORK, SETTINGS
from .polynomials import p_sql
from .trends import SERIES, ZYW


def station_daily(spark, d):
    return plan.daily(network.data(spark, d), network.stations(spark, d))


def station_percentiles(spark, d):
    return plan.daily_percentiles(network.days(spark, d), network.stations(spark, d), SETTINGS)


def station_windows(spark, d):
    w = plan.daily_window(network.days(spark, d), network.stations(spark, d), SETTINGS)
    return w.withColumns({"points": F.size("distribution"), "x_first": F.element_at("distribution", 1)["x"],
                          "x_last": F.element_at("distribution", -1)["x"]}).drop("distribution")


TREND_COLUMNS = ["era5_name", "station_id", "variable", "month", "day", "day_label", "year_min", "year_max", "trend10", "p_val", "tau", "n_years",
                 "proj_end_year", "slope", "intercept", "slope_hi", "intercept_hi", "slope_lo", "intercept_lo"]


def station_trends(spark, d):
    return plan.annual_trend(network.days(spark, d), network.stations(spark, d), SETTINGS).select(*TREND_COLUMNS)


def station_trend_windows(spark, d):
    t = plan.annual_trend_windows(network.days(spark, d), network.stations(spark, d), SETTINGS)
    return t.select("era5_name", "variable", "month", "day", "window", "slope", "p_val", "n_years")


def station_seasons(spark, d):
    return plan.season_heatmap(network.days(spark, d), network.stations(spark, d), SETTINGS)


def station_threshold_days(spark, d):
    t = plan.tropical(network.days(spark, d), network.stations(spark, d), SETTINGS, 2001)
    return t.select("era5_name", "kind", "threshold", "streak", "nonzero_count", F.posexplode(F.arrays_zip("years", "counts")).alias("i", "z")).select(
        "era5_name", "kind", "threshold", "streak", "nonzero_count", F.col("z")["years"].alias("year"), F.col("z")["counts"].alias("count"))


def station_threshold_trends(spark, d):
    """Every published number of the count trends, one row per year of the drawn lines; one row without numbers where there is no trend."""
    t = plan.tropical(network.days(spark, d), network.stations(spark, d), SETTINGS, 2001)
    lines = F.arrays_zip(*[F.col(f"trend.{c}") for c in ("x_line", "y_line", "ci_low", "ci_high", "pi_low", "pi_high")])
    one = ["model_used", "rate_per_year", "days_per_decade", "p_value", "alpha", "aic", "fit_year_max"]
    rows = t.select("era5_name", "station_id", "kind", "threshold", "streak", "nonzero_count", "fit_ok", *[F.col(f"trend.{c}").alias(c) for c in one], F.explode_outer(lines).alias("z"))
    return rows.select("era5_name", "station_id", "kind", "threshold", "streak", "nonzero_count", "fit_ok", *one, "z.*")


def network_drought(spark, d):
    return plan.drought_heatmap(network.days(spark, d), SETTINGS)


def network_drought_balance(spark, d):
    return plan.drought_heatmap(network.days(spark, d), SETTINGS).select("x", "y", "balance", "rank", "total", "season", "n_days")


def drought_rows(spark, d):
    return plan.drought_series(network.days(spark, d), network.stations(spark, d), SETTINGS)


def station_drought(spark, d):
    """Every index series with its trend, one row per year."""
    t = drought_rows(spark, d).withColumn("z", F.explode(F.arrays_zip(F.col("years").alias("year"), F.col("spei").alias("index"))))
    return t.select("era5_name", "station_id", "series", "z.year", F.col("z.index").alias("spei"), "trend.*")


def _ten(spark, d):
    return plan.all_tables(network.data(spark, d), network.stations(spark, d), SETTINGS, 2001)


def published_tables(spark, d):
    """All ten tables published twice after a clean report; the readers' version, counted from its files."""
    root = session.scratch_path(spark, "published")
    made = sinks.stage(_ten(spark, d))
    unique = lambda staged: quality.all_of([quality.unique_key(staged[t], t, validation.KEYS[t]) for t in validation.UNIQUE])
    sinks.publish({n: df.limit(0) for n, df in made.items()}, unique, root)
    number = sinks.publish(made, unique, root)
    return sinks.inventory(sinks.published(spark, root)).withColumn("version", F.lit(number).cast("bigint"))


def raw_report(spark, d):
    """All rules of the raw rows; the readings exceed the climate's bounds on purpose."""
    raw = network.raw(spark, d).withColumns({
        "latitude": F.lit(46.0), "longitude": F.lit(14.0), "elevation_station_m": F.lit(100), "elevation_era5_m": F.lit(100.0),
        "sequence": F.datediff("date", F.to_date(F.lit("1990-01-01"))).cast("bigint"), "date": F.date_format("date", "yyyy-MM-dd")})
    st = network.stations(spark, d)
    return quality.summary(validation.raw_violations(raw, st))


def table_report(spark, d):
    """All rules of all ten derived tables, counted."""
    st = network.stations(spark, d)
    names = [f"NATION_{i}" for i in range(25)]
    config = st.select("era5_name", "lat", "lon", "elevation", "elevation_era5_m")
    return quality.summary(validation.table_violations(sinks.stage(_ten(spark, d)), config, names, (1995, 2001)))


def r(x, n):
    k = 10 ** n
    return f"floor(({x}) * {k} + 0.5) / {k}"


def _win(half, base=NETWORK, cte="stn"):
    return base + ", " + WINDOW_JOIN.replace("{slot}", slot_sql("day")).replace("{half}", str(half)).replace("FROM daily", f"FROM {cte}")


SLOT_DATE = "(DATE '2001-01-01' + (target - 1)::INTEGER)"
LONG = NETWORK + """, daily AS (SELECT location || '|temperature_mean' AS entity, day, tmean AS v_mean FROM stn UNION ALL SELECT location || '|temperature_max', day, tmax FROM stn
  UNION ALL SELECT location || '|temperature_min', day, tmin FROM stn UNION ALL SELECT location || '|precipitation_sum', day, p FROM stn
  UNION ALL SELECT location || '|et0_evapotranspiration', day, e FROM stn)"""


def _trend_body(half: int) -> str:
    """The trend CTEs of catalog.trends on the network's five variables."""
    tail = SERIES[SERIES.index(", ser AS"):].replace("avg(v_mean) AS y FROM win GROUP BY ALL",
                                                     "CASE WHEN any_value(entity) LIKE '%temperature%' THEN avg(v_mean) ELSE sum(v_mean) END AS y FROM win WHERE wy >= 1995 GROUP BY entity, target, wy")
    return LONG + ", " + WINDOW_JOIN.replace("{slot}", slot_sql("day")).replace("{half}", str(half)) + tail


def _trend_rows(half: int) -> str:
    return f"""WITH {_trend_body(half)}, z AS (SELECT yw.*, {ZYW} AS z_yw, sl[rl + 1] AS slope_lo, sl[ru + 1] AS slope_hi, split_part(entity, '|', 1) AS era5_name, split_part(entity, '|', 2) AS variable,
      DATE '2001-01-01' + (slot - 1)::INTEGER AS sd FROM yw)"""


TREND_SQL = _trend_rows(7) + f""", ids AS (SELECT DISTINCT location, station_id FROM stn)
  SELECT era5_name, station_id, variable, month(sd)::INTEGER AS month, day(sd)::INTEGER AS day, strftime(sd, '%b ') || day(sd) AS day_label, x_min::INTEGER AS year_min, x_max::INTEGER AS year_max,
  {r('slope * 10', 3)} AS trend10, CASE WHEN z_yw IS NOT NULL THEN {r(p_sql('z_yw'), 5)} END AS p_val, {r('tau', 3)} AS tau, n::INTEGER AS n_years, 2050 AS proj_end_year,
  {r('slope', 6)} AS slope, {r('ym - slope * xm', 4)} AS intercept, {r('slope_hi', 6)} AS slope_hi, {r('ym - slope_hi * xm', 4)} AS intercept_hi, {r('slope_lo', 6)} AS slope_lo,
  {r('ym - slope_lo * xm', 4)} AS intercept_lo FROM z JOIN ids ON location = era5_name"""
TREND_WINDOW_SQL = " UNION ALL ".join(f"""SELECT * FROM ({_trend_rows(h)} SELECT era5_name, variable, month(sd)::INTEGER AS month, day(sd)::INTEGER AS day, {h}::INTEGER AS "window", {r('slope', 6)} AS slope,
  CASE WHEN z_yw IS NOT NULL THEN {r(p_sql('z_yw'), 5)} END AS p_val, n::INTEGER AS n_years FROM z)""" for h in (3, 15, 45))
KEYED = NETWORK + """, k AS (SELECT *, floor((month(day) % 12) / 3)::INTEGER AS x, (year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END)::INTEGER AS y FROM stn)"""

def _outside(source, columns):
    return " UNION ALL ".join(f"SELECT 'in_range' AS rule, '{name}' AS c FROM {source} WHERE {value} NOT BETWEEN {low} AND {high}" for name, value, low, high in columns)


GAPS = "SELECT 'missing_days', 'date' FROM {0} GROUP BY location HAVING count(DISTINCT day) < date_diff('day', min(day), max(day)) + 1"
RAW_REPORT = f"""WITH {NETWORK}, v AS ({_outside("net", [("temperature_max", "mx", -50, 45), ("temperature_min", "mn", -50, 45), ("temperature_mean", "me", -50, 45),
      ("precipitation_sum", "p", 0, 500), ("et0_evapotranspiration", "e", 0, 25)])} UNION ALL {GAPS.format("net")})
      SELECT 'raw' AS "table", rule, c AS "column", count(*) AS violations FROM v GROUP BY ALL"""
# Per half-width: the series behind the trend rows, one per station, variable and slot.
SPANS = """, sp AS (SELECT half, location, target, count(DISTINCT wy) AS n, min(wy) AS lo, max(wy) AS hi FROM (SELECT *, abs(((slot - target + 547) % 365) - 182) AS off FROM win)
    JOIN (SELECT unnest([7, 3, 15, 45]) AS half) h ON off <= half WHERE wy >= 1995 GROUP BY ALL HAVING count(DISTINCT wy) >= 5),
  span AS (SELECT CASE half WHEN 7 THEN 'annual_trend' ELSE 'annual_trend_windows' END AS t, sp.* FROM sp CROSS JOIN range(5))"""
TABLE_REPORT = f"""WITH {_win(45)} {SPANS}, dly AS (SELECT {r('tmax', 3)} AS a, {r('tmin', 3)} AS b, {r('tmean', 3)} AS c FROM stn),
      v AS ({_outside("dly", [("temperature_max_2m", "a", -50, 45), ("temperature_min_2m", "b", -50, 45), ("temperature_average_2m", "c", -50, 45)])}
      UNION ALL {GAPS.format("stn")} UNION ALL SELECT 'entity_count', 'era5_name' FROM stn HAVING count(DISTINCT location) <> 25)
      SELECT 'daily' AS "table", rule, c AS "column", count(*) AS violations FROM v GROUP BY ALL
      UNION ALL SELECT t, 'at_least', 'n_years', count(*) FROM span WHERE n < 10 GROUP BY t
      UNION ALL SELECT t, 'year_span', 'n_years', count(*) FROM span WHERE n <> hi - lo + 1 GROUP BY t"""


def _cut_report(name, sql, key, cuts):
    outside = " UNION ALL ".join(f"""SELECT '{name}', 'in_range', '{c}', count(*) FROM ({sql}) WHERE {c} NOT BETWEEN -50 AND 45 HAVING count(*) > 0""" for c in cuts)
    return f"""{outside} UNION ALL SELECT '{name}', 'group_size', '{key}', count(*) FROM (SELECT {key} FROM ({sql}) GROUP BY {key} HAVING count(*) <> 365) HAVING count(*) > 0"""


# The index series of a station: months, seasons and the year that have enough years.
SERIES_SQL = """mo AS (SELECT location, year(day) AS yr, month(day) AS m, count(*) AS n FROM stn GROUP BY ALL), fin AS (SELECT max(day) AS l FROM stn),
  one AS (SELECT location, strftime(make_date(2001, m, 1), '%b') AS series, yr AS y, n, 20 AS least, last_day(make_date(yr, m, 1)) AS fin_day FROM mo
    UNION ALL SELECT location, list_value('Winter','Spring','Summer','Autumn')[floor((m % 12) / 3)::INTEGER + 1], yr + CASE WHEN m = 12 THEN 1 ELSE 0 END, n, 30,
      last_day(make_date(yr + CASE WHEN m = 12 THEN 1 ELSE 0 END, floor((m % 12) / 3)::INTEGER * 3 + 2, 1)) FROM mo),
  yrs AS (SELECT location, series, y FROM one GROUP BY location, series, y, least, fin_day HAVING sum(n) >= least AND fin_day <= (SELECT l FROM fin)),
  kept AS (SELECT location, series, count(*) AS n FROM yrs GROUP BY ALL HAVING count(*) >= 5),
  ann AS (SELECT location, y FROM yrs JOIN kept USING (location, series) WHERE series IN ('Winter', 'Spring', 'Summer', 'Autumn') GROUP BY location, y HAVING count(*) >= 2)"""

QUERIES = {
    "station_daily": (station_daily, f"""WITH {NETWORK} SELECT station_id, location AS era5_name, strftime(day, '%Y-%m-%d') AS date, year(day)::INTEGER AS year, month(day)::INTEGER AS month, day(day)::INTEGER AS day,
      {r('tmax', 3)} AS temperature_max_2m, {r('tmean', 3)} AS temperature_average_2m, {r('tmin', 3)} AS temperature_min_2m FROM stn"""),
    "station_percentiles": (station_percentiles, f"""WITH {_win(7)}, y AS (SELECT station_id, target, wy, avg(tmean) AS m FROM win WHERE station_id IS NOT NULL GROUP BY ALL)
      SELECT strftime(DATE '2025-01-01' + (target - 1)::INTEGER, '%Y-%m-%d') AS date, station_id, {", ".join(f"{r(f'quantile_cont(m, {p})', 2)} AS {n}" for n, p in plan.MEAN_CUTS.items())}
      FROM y GROUP BY station_id, target HAVING count(*) >= 5"""),
    "station_windows": (station_windows, f"""WITH {_win(7)}, sp AS (SELECT location, min(year(day)) AS a, max(year(day)) AS b FROM stn GROUP BY ALL),
      g AS (SELECT location, any_value(station_id) AS station_id, target, count(*) AS n, min(tmax) AS lo, max(tmax) AS hi, {", ".join(f"{r(f'quantile_cont(tmax, {p})', 2)} AS {n}" for n, p in plan.WINDOW_CUTS.items())}
        FROM win GROUP BY location, target HAVING count(*) >= 50)
      SELECT location AS era5_name, station_id, month({SLOT_DATE})::INTEGER AS month, day({SLOT_DATE})::INTEGER AS day, p5, p10, p20, p50, p80, p95, n::INTEGER AS n_samples,
      a::INTEGER AS year_min, b::INTEGER AS year_max, 200 AS points, {r('lo - greatest((hi - lo) * 0.05, 0.5)', 3)} AS x_first, {r('hi + greatest((hi - lo) * 0.05, 0.5)', 3)} AS x_last FROM g JOIN sp USING (location)"""),
    "station_trends": (station_trends, TREND_SQL),
    "station_trend_windows": (station_trend_windows, TREND_WINDOW_SQL),
    "station_seasons": (station_seasons, f"""WITH {KEYED}, last AS (SELECT location, max(day) AS l FROM stn GROUP BY ALL),
      s AS (SELECT location, any_value(station_id) AS station_id, x, y, {r('avg(tmax)', 2)} AS avg, count(*) AS n_days FROM k GROUP BY location, x, y HAVING count(*) >= 30),
      c AS (SELECT s.* FROM s JOIN last USING (location) WHERE last_day(make_date(y, x * 3 + 2, 1)) <= l),
      q AS (SELECT *, rank() OVER (PARTITION BY location, x ORDER BY avg DESC)::INTEGER AS rank, count(*) OVER (PARTITION BY location, x) AS total,
        coalesce((SELECT count(*) FILTER (WHERE b.avg < c.avg) * 100.0::DOUBLE / nullif(count(*), 0) FROM c b WHERE b.location = c.location AND b.x = c.x AND b.y BETWEEN 1996 AND 1999),
          (SELECT count(*) FILTER (WHERE b.avg < c.avg) * 100.0::DOUBLE / count(*) FROM c b WHERE b.location = c.location AND b.x = c.x)) AS pc FROM c),
      ct AS (SELECT *, CASE WHEN pc < 10 THEN 'cold' WHEN pc < 20 THEN 'cool' WHEN pc < 80 THEN 'normal' WHEN pc < 95 THEN 'hot' ELSE 'extreme' END AS cat FROM q)
      SELECT location AS era5_name, station_id, x, y, list_value('Winter','Spring','Summer','Autumn')[x + 1] AS season, avg, {r('pc', 1)} AS percentile, cat, rank, total,
      CASE cat WHEN 'cold' THEN '#3a5a8a' WHEN 'cool' THEN '#6c8fb6' WHEN 'normal' THEN '#e7d9b8' WHEN 'hot' THEN '#c25a2c' ELSE '#962c1a' END AS color, n_days FROM ct"""),
    "station_threshold_days": (station_threshold_days, f"""WITH {NETWORK}, grid AS (SELECT 'days' AS kind, unnest(range(25, 36)) AS threshold UNION ALL SELECT 'nights', unnest(range(15, 26))),
      nb AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY day) AS rn FROM stn),
      hot AS (SELECT location, kind, threshold, year(day) AS yr, rn, rn - row_number() OVER (PARTITION BY location, kind, threshold ORDER BY rn) AS run FROM nb, grid WHERE CASE WHEN kind = 'days' THEN tmax ELSE tmin END > threshold),
      ln AS (SELECT *, count(*) OVER (PARTITION BY location, kind, threshold, run) AS len FROM hot),
      ag AS (SELECT location, kind, threshold, yr, count(*) AS c1, count(*) FILTER (WHERE len >= 2) AS c2, count(*) FILTER (WHERE len >= 3) AS c3 FROM ln GROUP BY ALL),
      sp AS (SELECT location, unnest(range(min(year(day)), max(year(day)) + 1)) AS yr FROM stn GROUP BY location),
      f AS (SELECT sp.location, g.kind, g.threshold, k.streak, sp.yr, coalesce(CASE k.streak WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END, 0) AS count FROM sp CROSS JOIN grid g CROSS JOIN (SELECT unnest([1, 2, 3]) AS streak) k
        LEFT JOIN ag ON ag.location = sp.location AND ag.kind = g.kind AND ag.threshold = g.threshold AND ag.yr = sp.yr)
      SELECT location AS era5_name, kind, threshold::INTEGER AS threshold, streak::INTEGER AS streak, (count(*) FILTER (WHERE count > 0) OVER (PARTITION BY location, kind, threshold, streak))::INTEGER AS nonzero_count,
      yr::INTEGER AS year, count::INTEGER AS count FROM f"""),
    "network_drought_balance": (network_drought_balance, f"""WITH {NETWORK}, dd AS (SELECT day, avg(p) - avg(e) AS b FROM stn GROUP BY day),
      k AS (SELECT *, floor((month(day) % 12) / 3)::INTEGER AS x, (year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END)::INTEGER AS y FROM dd),
      s AS (SELECT x, y, {r('sum(b)', 1)} AS balance, count(*) AS n_days FROM k GROUP BY x, y HAVING count(*) >= 30),
      c AS (SELECT * FROM s WHERE last_day(make_date(y, x * 3 + 2, 1)) <= (SELECT max(day) FROM dd))
      SELECT x, y, balance, rank() OVER (PARTITION BY x ORDER BY balance)::INTEGER AS rank, count(*) OVER (PARTITION BY x) AS total, list_value('Winter','Spring','Summer','Autumn')[x + 1] AS season, n_days FROM c"""),
    "published_tables": (published_tables, f"""WITH {_win(45)} {SPANS}, y AS (SELECT station_id, target FROM win WHERE station_id IS NOT NULL AND abs(((slot - target + 547) % 365) - 182) <= 7 GROUP BY ALL HAVING count(DISTINCT wy) >= 5),
      w AS (SELECT location, target FROM win WHERE abs(((slot - target + 547) % 365) - 182) <= 7 GROUP BY ALL HAVING count(*) >= 50),
      k AS (SELECT *, floor((month(day) % 12) / 3)::INTEGER AS x, (year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END)::INTEGER AS y FROM stn),
      last AS (SELECT location, max(day) AS l FROM stn GROUP BY ALL), s AS (SELECT location, x, y FROM k GROUP BY ALL HAVING count(*) >= 30),
      nat AS (SELECT x, y FROM (SELECT DISTINCT x, y, day FROM k) GROUP BY ALL HAVING count(*) >= 30), {SERIES_SQL},
      c AS (SELECT 'daily' AS "table", count(*) AS n_rows FROM stn UNION ALL SELECT 'daily_percentiles', count(*) FROM y UNION ALL SELECT 'daily_window', count(*) FROM w
      UNION ALL SELECT t, count(*) FROM span GROUP BY t UNION ALL SELECT 'stations', count(DISTINCT s_nationkey) FROM supplier
      UNION ALL SELECT 'tropical', count(DISTINCT location) * 66 FROM stn UNION ALL SELECT 'spei', count(*) FROM nat WHERE last_day(make_date(y, x * 3 + 2, 1)) <= (SELECT max(day) FROM stn)
      UNION ALL SELECT 'spei_station', (SELECT count(*) FROM kept) + (SELECT count(DISTINCT location) FROM ann)
      UNION ALL SELECT 'season_heatmap', count(*) FROM s JOIN last USING (location) WHERE last_day(make_date(y, x * 3 + 2, 1)) <= l) SELECT *, 2::BIGINT AS version FROM c"""),
    "raw_report": (raw_report, RAW_REPORT),
}
NATIONAL = f"""WITH RECURSIVE {NETWORK}, dd AS (SELECT day, avg(p) - avg(e) AS b FROM stn GROUP BY day),
  k AS (SELECT *, floor((month(day) % 12) / 3)::INTEGER AS x, (year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END)::INTEGER AS y FROM dd),
  s AS (SELECT x, y, {r('sum(b)', 1)} AS balance, count(*) AS n_days FROM k GROUP BY x, y HAVING count(*) >= 30),
  c AS (SELECT * FROM s WHERE last_day(make_date(y, x * 3 + 2, 1)) <= (SELECT max(day) FROM dd)), {drought_sql("c", ["x"], "balance", "y BETWEEN 1995 AND 1999")},
  ct AS (SELECT *, CASE WHEN spei < -1.5 THEN 'extreme_dry' WHEN spei < -1 THEN 'dry' WHEN spei < 1 THEN 'normal' WHEN spei < 1.5 THEN 'wet' ELSE 'extreme_wet' END AS cat FROM dry)"""
QUERIES["network_drought"] = (network_drought, f"""{NATIONAL} SELECT x, y, {r('spei', 2)} AS spei, balance, cat, rank() OVER (PARTITION BY x ORDER BY balance)::INTEGER AS rank, count(*) OVER (PARTITION BY x) AS total,
  CASE cat {" ".join(f"WHEN '{c}' THEN '{v}'" for c, v in categories.DROUGHT_COLORS.items())} END AS color, list_value('Winter','Spring','Summer','Autumn')[x + 1] AS season, n_days FROM ct""")

# Index series of the stations and their trends, by the trend CTEs of catalog.trends.
DRY_SERIES = f"""WITH RECURSIVE {NETWORK}, mo AS (SELECT location, year(day)::INTEGER AS yr, month(day) AS m, count(*) AS n, coalesce(sum(p - e), 0) AS bal FROM stn GROUP BY ALL), fin AS (SELECT max(day) AS l FROM stn),
  one AS (SELECT location, strftime(make_date(2001, m, 1), '%b') AS series, yr AS y, n, bal, 20 AS least, last_day(make_date(yr, m, 1)) AS fin_day FROM mo
    UNION ALL SELECT location, list_value('Winter','Spring','Summer','Autumn')[floor((m % 12) / 3)::INTEGER + 1], yr + CASE WHEN m = 12 THEN 1 ELSE 0 END, n, bal, 30,
      last_day(make_date(yr + CASE WHEN m = 12 THEN 1 ELSE 0 END, floor((m % 12) / 3)::INTEGER * 3 + 2, 1)) FROM mo),
  yrs AS (SELECT location, series, y, sum(bal) AS balance FROM one GROUP BY location, series, y, least, fin_day HAVING sum(n) >= least AND fin_day <= (SELECT l FROM fin)),
  kept AS (SELECT * FROM yrs QUALIFY count(*) OVER (PARTITION BY location, series) >= 5), {drought_sql("kept", ["location", "series"], "balance", "y BETWEEN 1995 AND 1999")},
  rd AS (SELECT location, series, y, {r('spei', 2)} AS spei FROM dry),
  vals AS (SELECT * FROM rd UNION ALL SELECT location, 'Annual', y, floor(sum(round_even(spei * 100, 0)) / count(*) + 0.5) / 100 FROM rd WHERE series IN ('Winter', 'Spring', 'Summer', 'Autumn') GROUP BY location, y HAVING count(spei) >= 2),
  ser AS (SELECT location AS entity, series AS slot, y AS x, spei AS y FROM vals), {SERIES[SERIES.index("idx AS (SELECT"):]},
  tr AS (SELECT entity AS location, slot AS series, {r('slope * 10', 3)} AS slope_per_decade, {r(p_sql('z_mk'), 3)} AS p_value,
    CASE WHEN {p_sql('z_mk')} < 0.05 AND z_mk > 0 THEN 'increasing' WHEN {p_sql('z_mk')} < 0.05 AND z_mk < 0 THEN 'decreasing' ELSE 'no trend' END AS mk_trend, {r('intercept', 3)} AS intercept FROM ci),
  ids AS (SELECT DISTINCT location, station_id FROM stn),
  sv AS (SELECT vals.location AS era5_name, station_id, vals.series, y::INTEGER AS year, spei, slope_per_decade, p_value, mk_trend, intercept FROM vals JOIN ids ON ids.location = vals.location
    LEFT JOIN tr ON tr.location = vals.location AND tr.series = vals.series)"""
QUERIES["station_drought"] = (station_drought, f"{DRY_SERIES} SELECT * FROM sv")

COUNTS = QUERIES["station_threshold_days"][1]
QUERIES["station_threshold_trends"] = (station_threshold_trends, f"""WITH RECURSIVE tc AS ({COUNTS}), {count_fit_sql("tc", ["era5_name", "kind", "threshold", "streak"], 5, 5, "year = 2001")},
  ids AS (SELECT n_name AS era5_name, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS station_id FROM nation),
  g AS (SELECT era5_name, kind, threshold, streak, any_value(nonzero_count) AS nonzero_count, min(year) FILTER (WHERE year <> 2001) AS t0, max(year) FILTER (WHERE year <> 2001) AS last, list(year ORDER BY year) AS years FROM tc GROUP BY ALL),
  j AS (SELECT g.*, coalesce(fit_ok, true) AS ok, fits.* EXCLUDE (era5_name, kind, threshold, streak, fit_ok), coalesce(fit_ok, false) AS has FROM g LEFT JOIN fits USING (era5_name, kind, threshold, streak)),
  ln AS (SELECT *, unnest(CASE WHEN has THEN years ELSE [NULL] END) AS yr FROM j),
  mu AS (SELECT *, exp(a + b * (yr - t0)) AS mu, 1.959963984540054::DOUBLE * sqrt(v00 + 2 * (yr - t0) * v01 + (yr - t0) * (yr - t0) * v11) AS half FROM ln),
  bd AS (SELECT *, 1.96::DOUBLE * sqrt(mu + mu * mu * alpha) AS band FROM mu)
  SELECT bd.era5_name, station_id, kind, threshold, streak, nonzero_count, ok AS fit_ok, CASE WHEN has THEN 'nb' END AS model_used, rate AS rate_per_year, per_decade AS days_per_decade, p_value, alpha, aic,
    CASE WHEN has THEN last END AS fit_year_max, yr::DOUBLE AS x_line, round_even(mu * 100, 0) / 100 AS y_line, round_even(mu * exp(-half) * 100, 0) / 100 AS ci_low, round_even(mu * exp(half) * 100, 0) / 100 AS ci_high,
    CASE WHEN has THEN round_even(greatest(0, mu - band) * 100, 0) / 100 END AS pi_low, round_even((mu + band) * 100, 0) / 100 AS pi_high FROM bd JOIN ids ON ids.era5_name = bd.era5_name""")
QUERIES["table_report"] = (table_report, f"""{TABLE_REPORT} UNION ALL SELECT 'season_heatmap', 'in_range', 'avg', count(*) FROM ({QUERIES["station_seasons"][1]})
      WHERE "avg" NOT BETWEEN -50 AND 45 HAVING count(*) > 0
      UNION ALL {_cut_report("daily_percentiles", QUERIES["station_percentiles"][1], "station_id", plan.MEAN_CUTS)}
      UNION ALL {_cut_report("daily_window", QUERIES["station_windows"][1], "era5_name", plan.WINDOW_CUTS)}""")
