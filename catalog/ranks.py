"""Ranks, runs, moving means, deduplication and top rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meteorium.functions import calendar as cal
from meteorium.functions import numeric as num
from meteorium.operators import counts, grids, quality, quantiles, seasons, series, windows
from meteorium.plans import serve

from .aggregates import SEASON_SQL
from .inputs import DAILY, OBS, PRIORITY, daily, day_text, observations, priority_daily, slot_sql, table, window_sql


def _seasons(spark, d):
    s = seasons.season_aggregate(daily(spark, d), ["entity"], "day", F.avg("v_max"), "avg", 30)
    return s.withColumn("avg", num.round_to("avg", 1))


def season_ranks(spark, d):
    """Rank from the highest with shared ranks, total, percent of baseline years below, category and colour."""
    r = seasons.rank_seasons(_seasons(spark, d), ["entity", "x"], "avg", F.col("y").between(1996, 1999))
    return seasons.with_season_category(r).select("entity", "x", "y", "avg", "rank", "total", "percentile", "cat", "color")


def balance_ranks(spark, d):
    """Rank from the lowest."""
    s = seasons.season_aggregate(daily(spark, d), ["entity"], "day", F.sum(F.col("wet") - F.col("dry")), "balance", 30)
    s = s.withColumn("balance", num.round_to("balance", 0))
    return seasons.rank_seasons(s, ["entity", "x"], "balance", F.lit(True), highest_first=False).select("entity", "x", "y", "balance", "rank", "total")


def percentile_rank(spark, d):
    """Rounded percent of the slot's sample strictly below each daily maximum."""
    s = windows.pooled_samples(daily(spark, d), ["entity"], "day", "v_max", 7)
    req = daily(spark, d).select("entity", cal.slot("day").alias("slot"), day_text("day").alias("day"), "v_max")
    return quantiles.rank_against_sample(req, s, ["entity", "slot"], "v_max", "pct").select("entity", "day", "pct")


def run_days(spark, d):
    """Days above a threshold inside runs of at least two rows."""
    r = counts.streak_days(daily(spark, d), ["entity"], "day", "v_max", 62.0, 2)
    return r.select("entity", day_text("day").alias("day"), F.col("run_length").alias("run"), "v_max")


def _monthly(spark, d):
    return observations(spark, d).groupBy("entity", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("value").alias("v")).withColumn(
        "step", (F.col("year") * 12 + F.col("month")).cast("int"))


def centred_means(spark, d):
    return grids.centred_mean(_monthly(spark, d), ["entity"], "step", "v", "mean", 10).select("entity", "step", "mean")


def decade_samples(spark, d):
    x = grids.decade_samples(grids.centred_mean(_monthly(spark, d), ["entity"], "step", "v", "mean", 10), ["entity"], "step", 1850)
    return x.select("entity", "year_start", "year_end", "mean")


def running_means(spark, d):
    return grids.complete_running_mean(_monthly(spark, d), ["entity"], "step", "v", "mean", 10).select("entity", "step", "mean")


def running_anomalies(spark, d):
    """Moving mean against two reference means."""
    y = observations(spark, d).groupBy((F.col("l_partkey") % 16).alias("x"), F.year("day").alias("year")).agg(F.avg("value").alias("v"))
    return grids.running_anomalies(y, ["x"], "year", "v", {"to_all": (0, 9999), "to_early": (1995, 1998)}, 3)


def keep_last(spark, d):
    """Last arrival per customer and year."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    return series.keep_last(o, ["o_custkey", "year"], ["o_orderkey"])


def gaps(spark, d):
    g = series.date_gaps(priority_daily(spark, d), ["entity"], "day")
    return g.select("entity", day_text("day").alias("day"), day_text("previous").alias("previous"), F.col("missing").cast("bigint").alias("missing"))


def continuity(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"))
    c = series.continuity(o, ["o_orderpriority"], "day")
    return c.select("o_orderpriority", "n_rows", "n_days", "duplicates", "missing")


def order_inversions(spark, d):
    """Places where the ship date falls against the arrival order; the sum of their numbers is exact, a decimal where it passes 64 bits."""
    o = observations(spark, d).withColumn("seq", F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 8 + F.col("l_linenumber"))
    o = o.groupBy("entity", "seq").agg(F.max("day").alias("day"))
    found = series.order_inversions(o, ["entity"], "seq", "day", block=4_000_000_000).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("seq").cast("decimal(20,0)")).alias("seqs"))
    return series.bigint_where_it_fits(found, "seqs")


def monotone_check(spark, d):
    """Rows where the mean price falls although the quantity rises."""
    o = observations(spark, d).groupBy("entity", F.col("qty").cast("int").alias("driver")).agg(F.avg("value").alias("idx"))
    return quality.monotone(o, "lineitem", ["entity"], "driver", "idx").select("rule", "key", "column")


def baseline_anomaly(spark, d):
    """Window value minus the mean of its slot, with the sign."""
    y = windows.window_years(daily(spark, d), ["entity"], "day", {"v_mean": "avg"}, [7])
    m = F.avg("v_mean").over(Window.partitionBy("entity", "slot"))
    return y.select("entity", "slot", "window_year", (F.col("v_mean") - m).alias("anomaly"), F.when(F.col("v_mean") >= m, 1).otherwise(-1).alias("sign"))


def median_anomaly(spark, d):
    """Anomaly of each daily value against the overall median of its entity and month."""
    x = daily(spark, d).select("entity", F.month("day").alias("month"), "day", "v_max")
    med = x.groupBy("entity", "month").agg(F.percentile("v_max", F.lit(0.5)).alias("med"))
    return x.join(med, ["entity", "month"]).select("entity", day_text("day").alias("day"), (F.col("v_max") - F.col("med")).alias("anomaly"))


def latest_week(spark, d):
    """The last seven rows up to a date per entity."""
    r = series.latest_rows(daily(spark, d), ["entity"], "day", 7, F.to_date(F.lit("2000-03-03")))
    return r.select("entity", day_text("day").alias("day"), "v_max", "recency")


def latest_row(spark, d):
    return observations(spark, d).groupBy("entity").agg(F.max_by("value", F.struct("day", "l_orderkey", "l_linenumber", "l_partkey", "value")).alias("value"), day_text(F.max("day")).alias("day"))


def guarded_page(spark, d):
    """A page of all nations; one more row than the page would fail."""
    return serve.page(table(spark, d, "nation"), 25, ["n_nationkey"]).select("n_nationkey", "n_name")


def ordered_table(spark, d):
    """Rows in the order season, year with their place."""
    s = _seasons(spark, d)
    return s.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("x", "y"))).select("entity", "x", "y", "place")


def locale_sorted(spark, d):
    """Rank of the part names in the Slovene order."""
    p = table(spark, d, "part").select("p_name").distinct()
    return serve.sorted_names(p, "p_name")


def heatmap_counters(spark, d):
    r = seasons.with_season_category(seasons.rank_seasons(_seasons(spark, d), ["entity", "x"], "avg", F.col("y").between(1996, 1999)))
    return seasons.heatmap_counters(r, ["entity"], "y", ["extreme", "hot"], ["cold"], ["extreme"], 1999, 3)


RANKED = f"""WITH {DAILY}, {SEASON_SQL}, r1 AS (SELECT entity, x, y, floor(a * 10 + 0.5) / 10 AS avg FROM complete),
 r2 AS (SELECT *, rank() OVER (PARTITION BY entity, x ORDER BY avg DESC)::INTEGER AS rank, count(*) OVER (PARTITION BY entity, x) AS total,
   (SELECT count(*) FILTER (WHERE b.avg < r1.avg) * 100.0::DOUBLE / count(*) FROM r1 b WHERE b.entity = r1.entity AND b.x = r1.x AND b.y BETWEEN 1996 AND 1999) AS percentile FROM r1),
 r3 AS (SELECT *, CASE WHEN percentile < 10 THEN 'cold' WHEN percentile < 20 THEN 'cool' WHEN percentile < 80 THEN 'normal' WHEN percentile < 95 THEN 'hot' ELSE 'extreme' END AS cat FROM r2)"""
MONTHLY = f"""WITH {OBS}, m AS (SELECT entity, (year(day) * 12 + month(day))::INTEGER AS step, avg(value) AS v FROM obs GROUP BY ALL),
 c AS (SELECT entity, step, avg(v) OVER (PARTITION BY entity ORDER BY step ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS mean,
   row_number() OVER (PARTITION BY entity ORDER BY step) - 1 AS i FROM m)"""

QUERIES = {
    "season_ranks": (season_ranks, RANKED + """ SELECT entity, x, y, avg, rank, total, percentile, cat,
      CASE cat WHEN 'cold' THEN '#3a5a8a' WHEN 'cool' THEN '#6c8fb6' WHEN 'normal' THEN '#e7d9b8' WHEN 'hot' THEN '#c25a2c' ELSE '#962c1a' END AS color FROM r3"""),
    "balance_ranks": (balance_ranks, f"""WITH {DAILY}, {SEASON_SQL}, b AS (SELECT entity, x, y, floor(bal + 0.5) AS balance FROM complete)
      SELECT *, rank() OVER (PARTITION BY entity, x ORDER BY balance)::INTEGER AS rank, count(*) OVER (PARTITION BY entity, x) AS total FROM b"""),
    "percentile_rank": (percentile_rank, f"""WITH {window_sql(7)}, q AS (SELECT entity, day, {slot_sql("day")} AS slot, v_max FROM daily)
      SELECT q.entity, strftime(q.day, '%Y-%m-%d') AS day, floor(count(*) FILTER (WHERE w.v_max < q.v_max) / count(*) * 100 + 0.5)::INTEGER AS pct
      FROM q JOIN win w ON w.entity = q.entity AND w.target = q.slot GROUP BY q.entity, q.day"""),
    "run_days": (run_days, f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) AS rn FROM daily),
      i AS (SELECT *, rn - row_number() OVER (PARTITION BY entity ORDER BY day) AS isl FROM r WHERE v_max > 62),
      l AS (SELECT *, count(*) OVER (PARTITION BY entity, isl) AS run FROM i)
      SELECT entity, strftime(day, '%Y-%m-%d') AS day, run, v_max FROM l WHERE run >= 2"""),
    "centred_means": (centred_means, MONTHLY + " SELECT entity, step, mean FROM c"),
    "decade_samples": (decade_samples, MONTHLY + " SELECT entity, (1850 + i - 6)::INTEGER AS year_start, (1859 + i - 6)::INTEGER AS year_end, mean FROM c WHERE i >= 6 AND (i - 6) % 10 = 0"),
    "running_means": (running_means, MONTHLY + """ SELECT entity, step, avg(v) OVER (PARTITION BY entity ORDER BY step ROWS 9 PRECEDING) AS mean FROM m
      QUALIFY count(*) OVER (PARTITION BY entity ORDER BY step ROWS 9 PRECEDING) = 10"""),
    "running_anomalies": (running_anomalies, f"""WITH {OBS}, y AS (SELECT l_partkey % 16 AS x, year(day)::INTEGER AS year, avg(value) AS v FROM obs GROUP BY ALL),
      r AS (SELECT x, avg(v) AS a, avg(v) FILTER (WHERE year BETWEEN 1995 AND 1998) AS e FROM y GROUP BY x),
      w AS (SELECT x, year, avg(v) OVER (PARTITION BY x ORDER BY year ROWS 2 PRECEDING) AS running, count(*) OVER (PARTITION BY x ORDER BY year ROWS 2 PRECEDING) AS n FROM y)
      SELECT x, year, running, running - a AS to_all, running - e AS to_early FROM w JOIN r USING (x) WHERE n = 3"""),
    "keep_last": (keep_last, """SELECT o_custkey, year(o_orderdate)::INTEGER AS year, o_orderkey, o_totalprice FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey DESC) = 1"""),
    "gaps": (gaps, f"""WITH {PRIORITY}, g AS (SELECT entity, day, lag(day) OVER (PARTITION BY entity ORDER BY day) AS p FROM pdaily)
      SELECT entity, strftime(day, '%Y-%m-%d') AS day, strftime(p, '%Y-%m-%d') AS previous, date_diff('day', p, day) - 1 AS missing FROM g WHERE date_diff('day', p, day) > 1"""),
    "continuity": (continuity, """WITH o AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderpriority, count(*) AS n_rows, count(DISTINCT d) AS n_days,
      count(*) - count(DISTINCT d) AS duplicates, date_diff('day', min(d), max(d)) + 1 - count(DISTINCT d) AS missing FROM o GROUP BY ALL"""),
    "order_inversions": (order_inversions, f"""WITH {OBS}, s AS (SELECT entity, l_orderkey * 1000000 + l_partkey * 8 + l_linenumber AS seq, max(day) AS day FROM obs GROUP BY ALL),
      l AS (SELECT *, lag(day) OVER (PARTITION BY entity ORDER BY seq) AS p FROM s)
      SELECT entity, count(*) AS n, sum(seq)::BIGINT AS seqs FROM l WHERE day < p GROUP BY entity"""),
    "monotone_check": (monotone_check, f"""WITH {OBS}, o AS (SELECT entity, qty::INTEGER AS driver, avg(value) AS idx FROM obs GROUP BY ALL),
      l AS (SELECT *, lag(idx) OVER (PARTITION BY entity ORDER BY driver) AS p FROM o)
      SELECT 'monotone' AS rule, entity || '/' || driver AS key, 'idx' AS "column" FROM l WHERE idx < p"""),
    "baseline_anomaly": (baseline_anomaly, f"""WITH {window_sql(7)}, y AS (SELECT entity, target, wy, avg(v_mean) AS m FROM win GROUP BY ALL),
      a AS (SELECT *, m - avg(m) OVER (PARTITION BY entity, target) AS anomaly FROM y)
      SELECT entity, target::INTEGER AS slot, wy::INTEGER AS window_year, anomaly, CASE WHEN anomaly >= 0 THEN 1 ELSE -1 END AS sign FROM a"""),
    "median_anomaly": (median_anomaly, f"""WITH {DAILY}, m AS (SELECT entity, month(day) AS mo, quantile_cont(v_max, 0.5) AS med FROM daily GROUP BY ALL)
      SELECT d.entity, strftime(d.day, '%Y-%m-%d') AS day, v_max - med AS anomaly FROM daily d JOIN m ON m.entity = d.entity AND m.mo = month(d.day)"""),
    "latest_week": (latest_week, f"""WITH {DAILY} SELECT entity, strftime(day, '%Y-%m-%d') AS day, v_max, row_number() OVER (PARTITION BY entity ORDER BY daily.day DESC)::INTEGER AS recency
      FROM daily WHERE daily.day <= DATE '2000-03-03' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY daily.day DESC) <= 7"""),
    "latest_row": (latest_row, f"""WITH {OBS} SELECT entity, value, strftime(day, '%Y-%m-%d') AS day FROM obs
      QUALIFY row_number() OVER (PARTITION BY entity ORDER BY obs.day DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, value DESC) = 1"""),
    "guarded_page": (guarded_page, "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 25"),
    "ordered_table": (ordered_table, f"""WITH {DAILY}, {SEASON_SQL} SELECT entity, x, y, row_number() OVER (PARTITION BY entity ORDER BY x, y)::INTEGER AS place FROM complete"""),
    "locale_sorted": (locale_sorted, "SELECT p_name, row_number() OVER (ORDER BY p_name) AS rank FROM (SELECT DISTINCT p_name FROM part)"),
    "heatmap_counters": (heatmap_counters, RANKED + """, k AS (SELECT *, max(y) OVER (PARTITION BY entity) AS my FROM r3)
      SELECT entity, count(*) FILTER (WHERE cat = 'extreme') AS n_extreme, count(*) FILTER (WHERE cat = 'cold') AS n_cold,
      count(*) FILTER (WHERE cat = 'extreme' AND y >= 1999) AS n_extreme_since, count(*) FILTER (WHERE cat IN ('extreme', 'hot') AND y >= my - 2) AS n_hot_recent FROM k GROUP BY entity"""),
}
