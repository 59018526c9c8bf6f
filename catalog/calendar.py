"""Calendar expressions over all dates of the tables."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from meteorium.functions import calendar as cal
from meteorium.operators import series, windows
from meteorium.session import materialize
from meteorium.streaming import refresh

from .inputs import OBS, day_text, observations, slot_sql, table


def _days(spark, d):
    return observations(spark, d).select("day").distinct()


def noleap_slot(spark, d):
    """Slot, place on the year line and climatology key of every date."""
    return _days(spark, d).select(day_text("day").alias("date"), cal.slot("day").alias("slot"),
                                  cal.position("day").alias("position"), cal.month_day_no_leap("day").alias("key"))


def slot_inverse(spark, d):
    """Month, day and label of every slot in use, with the days that fall on it."""
    s = observations(spark, d).groupBy(cal.slot("day").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    m, dd = cal.slot_month("slot"), cal.slot_day("slot")
    return s.select("slot", m.alias("month"), dd.alias("day"), cal.day_label(m, dd).alias("label"), "n")


def slot_spine(spark, d):
    """All 365 slots per entity with their number of observations, zero where there is none."""
    seen = observations(spark, d).groupBy("entity", cal.slot("day").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return (seen.select("entity").distinct().select("entity", cal.all_slots().alias("slot"))
            .join(seen, ["entity", "slot"], "left").na.fill(0, ["n"]))


def circular_window_pairs(spark, d):
    """Signed distance and window year of every date against every slot within seven days."""
    offset = F.explode(F.sequence(F.lit(-7), F.lit(7)))
    x = _days(spark, d).withColumn("slot", cal.slot("day")).withColumn("offset", offset)
    x = x.withColumn("target", (F.pmod(F.col("slot") - 1 + F.col("offset"), F.lit(365)) + 1).cast("int"))
    near = x.withColumn("distance", cal.circular_distance("slot", "target").cast("int")).filter("abs(distance) <= 7")
    return near.select(day_text("day").alias("date"), "target", "distance",
                       cal.window_year(F.year("day"), "slot", "target").alias("window_year"))


def calendar_parts(spark, d):
    rows = observations(spark, d).select(F.col("day").alias("date"))
    return series.with_calendar(rows, "date").groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


def month_lengths(spark, d):
    """Leap year and month length of every month in use."""
    y = _days(spark, d).select(F.year("day").alias("year"), F.month("day").alias("month")).distinct()
    return y.select("year", "month", cal.is_leap("year").cast("int").alias("leap"), cal.days_in_month("year", "month").alias("days"))


def season_attribution(spark, d):
    """Season, season year and closing dates of every observation, counted."""
    x = observations(spark, d).select("day", cal.season_index(F.month("day")).alias("x"), cal.season_year("day").alias("season_year"),
                                      cal.month_end(F.year("day"), F.month("day")).alias("m"))
    return x.groupBy("x", "season_year", cal.season_name("x").alias("season"), day_text(cal.season_end("season_year", "x")).alias("season_end")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("m").alias("months"))


def local_daily_dates(spark, d):
    """Local dates of multi-day requests at two UTC offsets."""
    e = table(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("start"))
    r = e.select("event_id", "start", (F.col("start") + 86400 * (F.col("event_id") % 4)).alias("end"), F.lit(86400).cast("bigint").alias("step"),
                 F.when(F.col("event_id") % 2 == 0, 3600).otherwise(7200).cast("bigint").alias("offset"))
    out = series.local_daily_range(r, "start", "end", "step", "offset", "date")
    return out.groupBy(day_text("date").alias("date"), "offset").agg(F.count(F.lit(1)).alias("n"))


def zone_dates(spark, d):
    """Calendar date of each event in a named zone."""
    e = table(spark, d, "events")
    return e.groupBy(day_text(cal.date_in_zone("ts", "Europe/Ljubljana")).alias("date")).agg(F.count(F.lit(1)).alias("n"))


def provenance(spark, d):
    """Preliminary or final by age against the last day of the table."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return o.groupBy(cal.provenance_tag("date", o.agg(F.max("date")).scalar()).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def future_cut(spark, d):
    """Rows up to an injected today, and how many the cut drops."""
    o = observations(spark, d)
    today = F.to_date(F.lit("2000-06-15"))
    return o.groupBy("entity").agg(F.count_if(F.col("day") <= today).alias("kept"), F.count_if(F.col("day") > today).alias("dropped"))


def range_trim(spark, d):
    """Rows inside a range; the rows kept and dropped are counted while the rows are written, in one reading."""
    counts = Observation()
    inside = materialize(refresh.trim_range(observations(spark, d), "day", F.to_date(F.lit("1997-02-27")), F.to_date(F.lit("1997-03-15")), counts))
    seen = counts.get
    return inside.groupBy("entity", day_text("day").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).withColumns(
        {"kept": F.lit(seen["kept"]).cast("bigint"), "dropped": F.lit(seen["dropped"]).cast("bigint")})


def month_day_window(spark, d):
    """Rows in the wrapped window of 15 days around 31 December; 29 February never matches."""
    w = windows.rows_in_window(observations(spark, d), "day", "12-31", 15)
    return w.groupBy(cal.month_day("day").alias("month_day"), F.year("day").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))


NEAR = ", ".join(f"'{x}'" for x in cal.month_day_window("12-31", 15))
QUERIES = {
    "noleap_slot": (noleap_slot, f"""SELECT strftime(d, '%Y-%m-%d') AS date, {slot_sql("d")}::INTEGER AS slot,
      (year(d) * 365 + {slot_sql("d")} - 1)::INTEGER AS position,
      CASE WHEN strftime(d, '%m-%d') = '02-29' THEN '02-28' ELSE strftime(d, '%m-%d') END AS key
      FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)"""),
    "slot_inverse": (slot_inverse, f"""WITH s AS (SELECT {slot_sql("l_shipdate")} AS slot, count(*) AS n FROM lineitem GROUP BY ALL),
      p AS (SELECT slot, DATE '2001-01-01' + (slot - 1)::INTEGER AS d, n FROM s)
      SELECT slot::INTEGER AS slot, month(d)::INTEGER AS month, day(d)::INTEGER AS day, strftime(d, '%b ') || day(d) AS label, n FROM p"""),
    "slot_spine": (slot_spine, f"""WITH {OBS}, s AS (SELECT entity, {slot_sql("day")} AS slot, count(*) AS n FROM obs GROUP BY ALL)
      SELECT e.entity, t.slot::INTEGER AS slot, coalesce(s.n, 0)::BIGINT AS n FROM (SELECT DISTINCT entity FROM obs) e
      CROSS JOIN (SELECT unnest(range(1, 366)) AS slot) t LEFT JOIN s ON s.entity = e.entity AND s.slot = t.slot"""),
    "circular_window_pairs": (circular_window_pairs, f"""WITH x AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, {slot_sql("l_shipdate")} AS slot FROM lineitem),
      y AS (SELECT *, unnest(range(1, 366)) AS target FROM x), z AS (SELECT *, ((slot - target + 182 + 365) % 365) - 182 AS distance FROM y)
      SELECT strftime(d, '%Y-%m-%d') AS date, target::INTEGER AS target, distance::INTEGER AS distance,
      (year(d) + CASE WHEN slot - target > 182 THEN 1 WHEN slot - target < -182 THEN -1 ELSE 0 END)::INTEGER AS window_year
      FROM z WHERE abs(distance) <= 7"""),
    "calendar_parts": (calendar_parts, """SELECT year(l_shipdate)::INTEGER AS year, month(l_shipdate)::INTEGER AS month,
      day(l_shipdate)::INTEGER AS day, count(*) AS n FROM lineitem GROUP BY ALL"""),
    "month_lengths": (month_lengths, """SELECT DISTINCT year(l_shipdate)::INTEGER AS year, month(l_shipdate)::INTEGER AS month,
      CASE WHEN (year(l_shipdate) % 4 = 0 AND year(l_shipdate) % 100 <> 0) OR year(l_shipdate) % 400 = 0 THEN 1 ELSE 0 END::INTEGER AS leap,
      day(last_day(l_shipdate))::INTEGER AS days FROM lineitem"""),
    "season_attribution": (season_attribution, """WITH k AS (SELECT CAST(l_shipdate AS DATE) AS d, floor((month(l_shipdate) % 12) / 3)::INTEGER AS x,
      (year(l_shipdate) + CASE WHEN month(l_shipdate) = 12 THEN 1 ELSE 0 END)::INTEGER AS season_year FROM lineitem)
      SELECT x, season_year, list_value('Winter','Spring','Summer','Autumn')[x + 1] AS season,
      strftime(last_day(make_date(season_year, x * 3 + 2, 1)), '%Y-%m-%d') AS season_end, count(*) AS n,
      count(DISTINCT last_day(d)) AS months FROM k GROUP BY ALL"""),
    "local_daily_dates": (local_daily_dates, """WITH r AS (SELECT event_id, floor(epoch(ts))::BIGINT AS s, event_id % 4 AS k,
      CASE WHEN event_id % 2 = 0 THEN 3600 ELSE 7200 END::BIGINT AS "offset" FROM events),
      x AS (SELECT s + unnest(range(0, k)) * 86400 + "offset" AS t, "offset" FROM r)
      SELECT strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, "offset", count(*) AS n FROM x GROUP BY ALL"""),
    "zone_dates": (zone_dates, """SELECT strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY ALL"""),
    "provenance": (provenance, """SELECT CASE WHEN CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) - 7 FROM orders)
      THEN 'era5t' ELSE 'era5' END AS source, count(*) AS n FROM orders GROUP BY ALL"""),
    "future_cut": (future_cut, f"""WITH {OBS} SELECT entity, count(*) FILTER (WHERE day <= DATE '2000-06-15') AS kept,
      count(*) FILTER (WHERE day > DATE '2000-06-15') AS dropped FROM obs GROUP BY entity"""),
    "range_trim": (range_trim, f"""WITH {OBS}, c AS (SELECT count(*) FILTER (WHERE day BETWEEN DATE '1997-02-27' AND DATE '1997-03-15') AS kept,
        count(*) FILTER (WHERE NOT day BETWEEN DATE '1997-02-27' AND DATE '1997-03-15') AS dropped FROM obs)
      SELECT entity, strftime(day, '%Y-%m-%d') AS date, count(*) AS n, sum(value) AS value, any_value(kept) AS kept, any_value(dropped) AS dropped FROM obs CROSS JOIN c
      WHERE day BETWEEN DATE '1997-02-27' AND DATE '1997-03-15' GROUP BY entity, obs.day"""),
    "month_day_window": (month_day_window, f"""WITH {OBS} SELECT strftime(day, '%m-%d') AS month_day, year(day)::INTEGER AS year, count(*) AS n,
      avg(value) AS value FROM obs WHERE strftime(day, '%m-%d') IN ({NEAR}) GROUP BY ALL"""),
}
