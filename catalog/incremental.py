"""Incremental refresh, roll-up and live classification, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.streaming import refresh, rollup

from .inputs import day_text, table


def fetch_plan(spark, d):
    """Date range to fetch per customer."""
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    today = F.to_date(F.lit("2001-07-25"))
    p = refresh.fetch_plan(have, who, "k", "day", today, F.to_date(F.lit("2001-07-20")), "1950-01-01")
    return p.select("k", day_text("last_day").alias("last_day"), day_text("fetch_from").alias("fetch_from"), "action")


def upsert(spark, d):
    """Old rows up to 2000 and arriving rows from 1999 on; the arriving value wins."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_orderkey").alias("v"))
    old = o.filter("year(day) <= 2000").withColumn("v", -F.col("v"))
    new = o.filter("year(day) >= 1999")
    m = refresh.upsert(old, new, ["entity", "day"])
    return m.groupBy("entity", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


def refreshed_rows(spark, d):
    """A whole refresh: plan, trim, tag and merge; old rows end in 2000, arrivals cover everything."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_orderkey").alias("v"))
    old = o.filter("day < date'2000-03-05'").withColumns({"v": -F.col("v"), "source": F.lit("era5")})
    today, end = F.to_date(F.lit("2000-04-10")), F.to_date(F.lit("2000-04-08"))
    plan = refresh.fetch_plan(old, o.select("entity").distinct(), "entity", "day", today, end, "1995-01-01")
    return refresh.apply_arrivals(old, o, plan, "entity", "day", today).groupBy("entity", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), day_text(F.max("day")).alias("last_day"))


def daily_extremes(spark, d):
    """Minimum, mean and maximum per entity and local day of the sub-hourly events."""
    e = table(spark, d, "events").select("event_type", "ts", F.round(F.col("value") * 64) .alias("value"))
    r = rollup.daily_extremes(e.withColumn("value", F.col("value") / 64), ["event_type"], "ts", "value", "Europe/Ljubljana")
    return r.select("event_type", day_text("date").alias("date"), "value_min", "value_mean", "value_max", "n")


def live_classification(spark, d):
    """Events against the climatology of their type and local day."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    local = e.select("event_type", F.date_format("ts", "MM-dd").alias("month_day"), "value")
    c = local.groupBy("event_type", "month_day").agg(F.percentile("value", F.array(*[F.lit(p) for p in (0.1, 0.2, 0.8, 0.95)])).alias("p"))
    c = c.select("event_type", "month_day", *[F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p20", "p80", "p95"))])
    x = rollup.classify_live(e, c, ["event_type"], "ts", "value")
    return x.groupBy("event_type", "category_key").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def measurement_guard(spark, d):
    """Rows kept and rows quarantined; some times and values are broken on purpose."""
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 10 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("ts")).alias("ts"),
                                         F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    good = rollup.valid_measurements(e, "ts", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))
    bad = rollup.quarantined(e, "ts", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("quarantined"))
    return good.join(bad, "event_type")


def source_freshness(spark, d):
    """Last day, number of days and age per customer segment."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    f = refresh.freshness(o, "c_mktsegment", "o_orderdate", F.to_date(F.lit("2001-12-31")))
    return f.select("c_mktsegment", day_text("last_day").alias("last_day"), "n_days", "age_days")


QUERIES = {
    "fetch_plan": (fetch_plan, """WITH l AS (SELECT o_custkey AS k, CAST(max(o_orderdate) AS DATE) AS m FROM orders GROUP BY ALL),
      p AS (SELECT c_custkey AS k, m, CASE WHEN m IS NULL THEN DATE '1950-01-01' ELSE least(m + 1, DATE '2001-07-25' - 15) END AS f FROM customer LEFT JOIN l ON l.k = c_custkey)
      SELECT k, strftime(m, '%Y-%m-%d') AS last_day, strftime(f, '%Y-%m-%d') AS fetch_from, CASE WHEN m IS NULL THEN 'full' WHEN f <= DATE '2001-07-20' THEN 'refresh' ELSE 'skip' END AS action FROM p"""),
    "upsert": (upsert, """WITH o AS (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS v FROM orders GROUP BY ALL)
      SELECT entity, year(day)::INTEGER AS year, count(*) AS n, sum(CASE WHEN year(day) >= 1999 THEN v ELSE -v END)::BIGINT AS v FROM o GROUP BY ALL"""),
    "refreshed_rows": (refreshed_rows, """WITH o AS (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS v FROM orders GROUP BY ALL),
      l AS (SELECT entity, least(max(day) + 1, DATE '2000-04-10' - 15) AS f FROM o WHERE day < DATE '2000-03-05' GROUP BY entity),
      m AS (SELECT entity, day, CASE WHEN day >= f AND day <= DATE '2000-04-08' THEN v ELSE -v END AS v, CASE WHEN day >= f AND day >= DATE '2000-04-10' - 7 THEN 'era5t' ELSE 'era5' END AS source
        FROM o JOIN l USING (entity) WHERE day < DATE '2000-03-05' OR (day >= f AND day <= DATE '2000-04-08'))
      SELECT entity, source, count(*) AS n, sum(v)::BIGINT AS v, strftime(max(day), '%Y-%m-%d') AS last_day FROM m GROUP BY entity, source"""),
    "daily_extremes": (daily_extremes, """WITH e AS (SELECT event_type, CAST(ts + INTERVAL 1 HOUR AS DATE) AS d, round(value * 64) / 64 AS v FROM events)
      SELECT event_type, strftime(d, '%Y-%m-%d') AS date, min(v) AS value_min, avg(v) AS value_mean, max(v) AS value_max, count(*) AS n FROM e GROUP BY event_type, d"""),
    "live_classification": (live_classification, """WITH e AS (SELECT event_id, event_type, strftime(ts, '%m-%d') AS md, value FROM events),
      c AS (SELECT event_type, md, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.2) AS p20, quantile_cont(value, 0.8) AS p80, quantile_cont(value, 0.95) AS p95 FROM e GROUP BY ALL)
      SELECT event_type, CASE WHEN value >= p95 THEN 'hell' WHEN value >= p80 THEN 'hot' WHEN value >= p20 THEN 'nope' WHEN value >= p10 THEN 'cold' ELSE 'freezing' END AS category_key,
      count(*) AS n, sum(event_id)::BIGINT AS ids FROM e JOIN c USING (event_type, md) GROUP BY ALL"""),
    "measurement_guard": (measurement_guard, """SELECT event_type, count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 7 <> 0) AS kept,
      count(*) FILTER (WHERE event_id % 10 = 0 OR event_id % 7 = 0) AS quarantined FROM events GROUP BY ALL"""),
    "source_freshness": (source_freshness, """SELECT c_mktsegment, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days,
      date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-31')::INTEGER AS age_days FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""),
}
