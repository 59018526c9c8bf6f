"""Window-year, percentile, season and count aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meteorium.functions import numeric as num
from meteorium.operators import counts, grids, quantiles, seasons, series, windows
from meteorium.operators import quality

from .inputs import DAILY, OBS, PRIORITY, daily, day_text, observations, priority_daily, table, window_sql

CUTS = {"p05": 0.05, "p20": 0.2, "p40": 0.4, "p60": 0.6, "p80": 0.8, "p95": 0.95}


def _cut_sql(v: str) -> str:
    return ", ".join(f"quantile_cont({v}, {p}) AS {n}" for n, p in CUTS.items())


def window_year_means(spark, d):
    return windows.window_years(daily(spark, d), ["entity"], "day", {"v_mean": "avg"}, [7]).select(
        "entity", "slot", "window_year", "n_rows", "v_mean")


def window_year_measures(spark, d):
    w = windows.window_years(daily(spark, d), ["entity"], "day", {"v_max": "avg", "wet": "sum"}, [3, 15])
    return w.groupBy("entity", "half", "window_year").agg(
        F.count(F.lit(1)).alias("slots"), F.avg("v_max").alias("v_max"), F.sum("wet").alias("wet"))


def daily_percentiles(spark, d):
    years = windows.window_years(daily(spark, d), ["entity"], "day", {"v_mean": "avg"}, [7])
    return quantiles.yearly_percentiles(years, ["entity", "slot"], "v_mean", CUTS, 5)


def sample_gate(spark, d):
    """Slots with at least 40 pooled samples and at least 6 years."""
    pooled = windows.pooled_samples(daily(spark, d), ["entity"], "day", "v_max", 3)
    years = windows.window_years(daily(spark, d), ["entity"], "day", {"v_max": "avg"}, [3]).groupBy("entity", "slot").agg(
        F.count(F.lit(1)).alias("n_years"))
    return (pooled.join(years, ["entity", "slot"]).withColumn("n_samples", F.size("samples").cast("bigint"))
            .filter("n_samples >= 40 and n_years >= 6").groupBy("entity").agg(
                F.count(F.lit(1)).alias("slots"), F.sum("n_samples").alias("n_samples"), F.sum("n_years").cast("bigint").alias("n_years")))


def pooled_daily_max(spark, d):
    """Percentiles, size and extremes of the pooled daily maxima around each slot."""
    p = windows.pooled_samples(daily(spark, d), ["entity"], "day", "v_max", 7)
    return p.select("entity", "slot", F.size("samples").cast("bigint").alias("n_samples"), F.array_min("samples").alias("low"),
                    F.array_max("samples").alias("high"),
                    *[num.sorted_percentile("samples", v).alias(n) for n, v in CUTS.items()])


def whole_table_percentiles(spark, d):
    return quantiles.exact_percentiles(observations(spark, d), ["entity"], "value", CUTS)


def entity_span(spark, d):
    return observations(spark, d).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min(F.year("day")).alias("year_min"), F.max(F.year("day")).alias("year_max"))


def spread(spark, d):
    return observations(spark, d).groupBy("entity").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"),
        (F.max("value") - F.min("value")).alias("width"))


def season_means(spark, d):
    return seasons.season_aggregate(daily(spark, d), ["entity"], "day", F.avg("v_max"), "avg", 30).withColumn(
        "avg", num.round_to("avg", 2))


SEASON_SQL = """keyed AS (SELECT *, CAST(floor((month(day) % 12) / 3) AS INTEGER) AS x,
   CAST(year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END AS INTEGER) AS y FROM daily),
 per AS (SELECT entity, x, y, avg(v_max) AS a, sum(wet - dry) AS bal, count(*) AS n_days FROM keyed GROUP BY entity, x, y),
 lastday AS (SELECT entity, max(day) AS last FROM daily GROUP BY entity),
 complete AS (SELECT per.*, list_value('Winter','Spring','Summer','Autumn')[x + 1] AS season FROM per JOIN lastday USING (entity)
   WHERE n_days >= 30 AND last_day(make_date(y, x * 3 + 2, 1)) <= last)"""


def water_balance(spark, d):
    """Season and month sums of the balance with their day gates."""
    bal = F.sum(F.col("wet") - F.col("dry"))
    s = seasons.season_aggregate(daily(spark, d), ["entity"], "day", bal, "balance", 30)
    m = seasons.month_aggregate(daily(spark, d), ["entity"], "day", bal, "balance", 20)
    rows = s.unionByName(m).withColumn("balance", num.round_to("balance", 1))
    years = F.count(F.lit(1)).over(Window.partitionBy("entity", "season"))
    return rows.withColumn("years", years).filter("years >= 6").select("entity", "season", "y", "balance", "n_days")


def network_balance(spark, d):
    """Mean over entities per day, then wet minus dry."""
    return daily(spark, d).groupBy("day").agg((F.avg("wet") - F.avg("dry")).alias("balance")).select(
        day_text("day").alias("day"), "balance")


THRESHOLDS = [60, 65, 70, 72, 75]


def threshold_days(spark, d):
    per_day = series.daily_rollup(observations(spark, d), ["entity"], "day", {"v_max": F.max("value"), "v_min": F.min("value")})
    kinds = {"days": ("v_max", THRESHOLDS), "nights": ("v_min", [5, 10, 15])}
    return counts.threshold_counts(per_day, ["entity"], "day", kinds, [1, 2, 3])


THRESHOLD_SQL = f"""WITH {DAILY}, grid AS (SELECT 'days' AS kind, unnest([{", ".join(f"{t}.0" for t in THRESHOLDS)}])::DOUBLE AS threshold
  UNION ALL SELECT 'nights', unnest([5.0, 10.0, 15.0])::DOUBLE),
 flagged AS (SELECT entity, day, kind, threshold, row_number() OVER (PARTITION BY entity, kind, threshold ORDER BY day) AS rn,
   CASE WHEN kind = 'days' THEN v_max ELSE v_min END > threshold AS hot FROM daily, grid),
 isl AS (SELECT *, rn - row_number() OVER (PARTITION BY entity, kind, threshold ORDER BY rn) AS run FROM flagged WHERE hot),
 lens AS (SELECT *, count(*) OVER (PARTITION BY entity, kind, threshold, run) AS len FROM isl),
 span AS (SELECT entity, min(year(day)) AS lo, max(year(day)) AS hi FROM daily GROUP BY entity),
 spine AS (SELECT entity, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS year FROM span)
 SELECT s.entity, g.kind, g.threshold, k.streak::INTEGER AS streak, s.year, count(l.day)::BIGINT AS count
 FROM spine s CROSS JOIN grid g CROSS JOIN (SELECT unnest([1, 2, 3]) AS streak) k
 LEFT JOIN lens l ON l.entity = s.entity AND l.kind = g.kind AND l.threshold = g.threshold AND year(l.day) = s.year AND l.len >= k.streak
 GROUP BY ALL"""


def nonzero_years(spark, d):
    return threshold_days(spark, d).groupBy("entity", "kind", "threshold", "streak").agg(
        F.count_if(F.col("count") > 0).alias("nonzero_count"))


def annual_from_seasons(spark, d):
    """Mean of the seasonal values of a year that has at least two."""
    s = seasons.season_aggregate(daily(spark, d), ["entity"], "day", F.avg("v_max"), "avg", 30)
    return s.groupBy("entity", "y").agg(F.avg("avg").alias("annual"), F.count(F.lit(1)).alias("n")).filter("n >= 2")


def pooled_national_mean(spark, d):
    """Unweighted mean over entities per day with the all-or-nothing mark."""
    p = priority_daily(spark, d)
    dim = p.select("entity").distinct()
    per = p.groupBy("day").agg(F.count(F.lit(1)).alias("n_entities"), F.avg("v_mean").alias("national"))
    return quality.all_or_nothing(per, ["day"], dim).select(day_text("day").alias("day"), "n_entities", "national", "pool")


def complete_pools(spark, d):
    """Only days on which every entity reports survive the gate."""
    p = daily(spark, d)
    per = p.groupBy("day").agg(F.count(F.lit(1)).alias("n_entities"), F.avg("v_mean").alias("national"))
    marked = quality.all_or_nothing(per, ["day"], p.select("entity").distinct())
    return quality.require_complete_pool(marked.filter("pool = 'complete'")).select(day_text("day").alias("day"), "national")


def baseline_mean(spark, d):
    """Baseline mean when more than five baseline years exist, else the mean of all years."""
    years = windows.window_years(daily(spark, d), ["entity"], "day", {"v_mean": "avg"}, [7])
    base = F.col("window_year").between(1996, 2000)
    return years.groupBy("entity", "slot").agg(
        F.when(F.count(F.when(base, 1)) > 4, F.avg(F.when(base, F.col("v_mean")))).otherwise(F.avg("v_mean")).alias("baseline"))


def distinct_entities(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("n"))


def freshness(spark, d):
    return observations(spark, d).agg(F.max("day").alias("d")).select(day_text("d").alias("last_day"))


def yearly_cell_means(spark, d):
    """Monthly cells to yearly cell means, overall and two sub-period means."""
    cells = observations(spark, d).select((F.col("l_partkey") % 16).alias("x"), (F.col("l_suppkey") % 8).alias("y"), "day", "value")
    monthly = cells.groupBy("x", "y", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("value").alias("value"))
    yearly = monthly.groupBy("x", "y", "year").agg(F.avg("value").alias("value"))
    return grids.reference_means(yearly, ["x", "y"], "year", "value", {"overall": (0, 9999), "early": (1995, 1997), "late": (1998, 2001)})


CELL_SQL = f"""WITH {OBS}, cells AS (SELECT l_partkey % 16 AS x, l_suppkey % 8 AS y, day, value FROM obs),
 monthly AS (SELECT x, y, year(day) AS year, month(day) AS month, avg(value) AS value FROM cells GROUP BY ALL),
 yearly AS (SELECT x, y, year, avg(value) AS value FROM monthly GROUP BY ALL)"""


def country_means(spark, d):
    """Mean over unmasked cells per year."""
    cells = observations(spark, d).select((F.col("l_partkey") % 16).alias("x"), (F.col("l_suppkey") % 8).alias("y"), "day",
                                          F.when(F.col("l_partkey") % 16 == 3, F.lit(-9999.0)).otherwise(F.col("value")).alias("value"))
    yearly = grids.mask_below(cells.groupBy("x", "y", F.year("day").alias("year")).agg(F.avg("value").alias("value")), "value")
    return yearly.groupBy("year").agg(F.avg("value").alias("average"), F.count(F.lit(1)).alias("cells"))


def special_periods(spark, d):
    """Union of two filtered period averages."""
    yearly = observations(spark, d).groupBy(F.year("day").alias("year")).agg(F.avg("value").alias("v"))
    one = lambda a, b: yearly.filter(F.col("year").between(a, b)).agg(F.avg("v").alias("average")).select(
        F.lit(a).alias("year_start"), F.lit(b).alias("year_end"), "average")
    return one(1995, 1998).unionByName(one(1995, 2001))


QUERIES = {
    "window_year_means": (window_year_means, f"""WITH {window_sql(7)} SELECT entity, CAST(target AS INTEGER) AS slot,
      CAST(wy AS INTEGER) AS window_year, count(*) AS n_rows, avg(v_mean) AS v_mean FROM win GROUP BY entity, target, wy"""),
    "window_year_measures": (window_year_measures, f"""WITH {window_sql(15)}, both_halves AS (
      SELECT entity, 15 AS half, target, wy, avg(v_max) AS v_max, sum(wet) AS wet FROM win GROUP BY ALL
      UNION ALL SELECT entity, 3, target, wy, avg(v_max), sum(wet) FROM win WHERE abs(((slot - target + 547) % 365) - 182) <= 3 GROUP BY ALL)
      SELECT entity, CAST(half AS INTEGER) AS half, CAST(wy AS INTEGER) AS window_year, count(*) AS slots, avg(v_max) AS v_max, sum(wet) AS wet
      FROM both_halves GROUP BY ALL"""),
    "daily_percentiles": (daily_percentiles, f"""WITH {window_sql(7)}, years AS (
      SELECT entity, target, wy, avg(v_mean) AS m FROM win GROUP BY entity, target, wy)
      SELECT entity, CAST(target AS INTEGER) AS slot, count(*) AS n_samples, {_cut_sql("m")} FROM years
      GROUP BY entity, target HAVING count(*) >= 5"""),
    "sample_gate": (sample_gate, f"""WITH {window_sql(3)}, g AS (SELECT entity, target, count(*) AS n_samples, count(DISTINCT wy) AS n_years
      FROM win GROUP BY entity, target HAVING count(*) >= 40 AND count(DISTINCT wy) >= 6)
      SELECT entity, count(*) AS slots, sum(n_samples)::BIGINT AS n_samples, sum(n_years)::BIGINT AS n_years FROM g GROUP BY entity"""),
    "pooled_daily_max": (pooled_daily_max, f"""WITH {window_sql(7)} SELECT entity, CAST(target AS INTEGER) AS slot, count(*) AS n_samples,
      min(v_max) AS low, max(v_max) AS high, {_cut_sql("v_max")} FROM win GROUP BY entity, target"""),
    "whole_table_percentiles": (whole_table_percentiles, f"""WITH {OBS} SELECT entity, count(*) AS n_samples, {_cut_sql("value")}
      FROM obs GROUP BY entity"""),
    "entity_span": (entity_span, f"""WITH {OBS} SELECT entity, count(*) AS n_samples, min(year(day))::INTEGER AS year_min,
      max(year(day))::INTEGER AS year_max FROM obs GROUP BY entity"""),
    "spread": (spread, f"""WITH {OBS} SELECT entity, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS low, max(value) AS high,
      max(value) - min(value) AS width FROM obs GROUP BY entity"""),
    "season_means": (season_means, f"""WITH {DAILY}, {SEASON_SQL} SELECT entity, x, y, season, floor(a * 100 + 0.5) / 100 AS avg, n_days
      FROM complete"""),
    "water_balance": (water_balance, f"""WITH {DAILY}, {SEASON_SQL},
      mon AS (SELECT entity, month(day) AS x, CAST(year(day) AS INTEGER) AS y, sum(wet - dry) AS bal, count(*) AS n_days FROM daily GROUP BY ALL),
      allrows AS (SELECT entity, season, y, bal, n_days FROM complete UNION ALL
        SELECT entity, strftime(make_date(2001, x, 1), '%b'), y, bal, n_days FROM mon JOIN lastday USING (entity)
        WHERE n_days >= 20 AND last_day(make_date(y, x, 1)) <= last)
      SELECT entity, season, y, floor(bal * 10 + 0.5) / 10 AS balance, n_days FROM allrows
      QUALIFY count(*) OVER (PARTITION BY entity, season) >= 6"""),
    "network_balance": (network_balance, f"""WITH {DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, avg(wet) - avg(dry) AS balance
      FROM daily GROUP BY daily.day"""),
    "threshold_days": (threshold_days, THRESHOLD_SQL),
    "nonzero_years": (nonzero_years, f"""SELECT entity, kind, threshold, streak, count(*) FILTER (WHERE count > 0) AS nonzero_count
      FROM ({THRESHOLD_SQL}) GROUP BY ALL"""),
    "annual_from_seasons": (annual_from_seasons, f"""WITH {DAILY}, {SEASON_SQL} SELECT entity, y, avg(a) AS annual, count(*) AS n
      FROM complete GROUP BY entity, y HAVING count(*) >= 2"""),
    "pooled_national_mean": (pooled_national_mean, f"""WITH {PRIORITY}, n AS (SELECT count(DISTINCT entity) AS c FROM pdaily)
      SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n_entities, avg(v_mean) AS national,
      CASE WHEN count(*) = (SELECT c FROM n) THEN 'complete' ELSE 'partial' END AS pool FROM pdaily GROUP BY pdaily.day"""),
    "complete_pools": (complete_pools, f"""WITH {DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, avg(v_mean) AS national FROM daily
      GROUP BY daily.day HAVING count(*) = (SELECT count(DISTINCT entity) FROM daily)"""),
    "baseline_mean": (baseline_mean, f"""WITH {window_sql(7)}, years AS (
      SELECT entity, target, wy, avg(v_mean) AS m FROM win GROUP BY entity, target, wy)
      SELECT entity, CAST(target AS INTEGER) AS slot, CASE WHEN count(*) FILTER (WHERE wy BETWEEN 1996 AND 2000) > 4
      THEN avg(m) FILTER (WHERE wy BETWEEN 1996 AND 2000) ELSE avg(m) END AS baseline FROM years GROUP BY entity, target"""),
    "distinct_entities": (distinct_entities, """SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS n
      FROM orders GROUP BY o_orderpriority"""),
    "freshness": (freshness, "SELECT strftime(max(l_shipdate), '%Y-%m-%d') AS last_day FROM lineitem"),
    "yearly_cell_means": (yearly_cell_means, CELL_SQL + """ SELECT x, y, avg(value) AS overall,
      avg(value) FILTER (WHERE year BETWEEN 1995 AND 1997) AS early, avg(value) FILTER (WHERE year BETWEEN 1998 AND 2001) AS late
      FROM yearly GROUP BY x, y"""),
    "country_means": (country_means, f"""WITH {OBS}, cells AS (SELECT l_partkey % 16 AS x, l_suppkey % 8 AS y, year(day) AS year,
        CASE WHEN l_partkey % 16 = 3 THEN -9999.0 ELSE value END AS value FROM obs),
      yearly AS (SELECT x, y, year, avg(value) AS value FROM cells GROUP BY ALL HAVING avg(value) >= -1000)
      SELECT CAST(year AS INTEGER) AS year, avg(value) AS average, count(*) AS cells FROM yearly GROUP BY year"""),
    "special_periods": (special_periods, f"""WITH {OBS}, yearly AS (SELECT year(day) AS year, avg(value) AS v FROM obs GROUP BY ALL)
      SELECT 1995 AS year_start, 1998 AS year_end, avg(v) AS average FROM yearly WHERE year BETWEEN 1995 AND 1998
      UNION ALL SELECT 1995, 2001, avg(v) FROM yearly WHERE year BETWEEN 1995 AND 2001"""),
}
