"""Data-quality rules over whole tables; the rules are set so that some rows of the given data break them."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.functions import calendar as cal
from meteorium.functions import categories as cat
from meteorium.operators import quality as q
from meteorium.operators import seasons
from meteorium.plans import validation

from .inputs import OBS, observations, slot_sql, table
from .ranks import RANKED, _seasons
from .trends import QUERIES as TRENDS
from .trends import count_regression

COUNT_REGRESSION = TRENDS["count_regression"][1]


def _counted(v):
    return v.groupBy("rule", "column").agg(F.count(F.lit(1)).alias("n"))


def row_rules(spark, d):
    """Null, range, membership and ordering rules in one scan."""
    o = observations(spark, d).select("l_orderkey", "l_linenumber", "entity", F.when(F.col("l_partkey") % 17 != 0, F.col("value")).alias("t_max"),
                                      (F.col("qty") * 1.0).alias("t_mean"), (F.col("disc") * 1.0).alias("t_min"))
    return _counted(q.row_violations(o, "raw", ["l_orderkey", "l_linenumber"], [
        q.not_null("t_max"), q.in_range("t_max", -50, 45), q.one_of("entity", ["A", "N"]), q.at_least("t_min", 3),
        q.non_decreasing(["t_min", "t_mean", "t_max"])]))


def violation_rows(spark, d):
    """The report itself: table, rule, key, column and value of every offending part."""
    p = table(spark, d, "part")
    return q.row_violations(p, "part", ["p_partkey"], [q.in_range("p_size", 3, 48), q.one_of("p_type", ["ECONOMY", "SMALL", "LARGE"])])


def cast_rules(spark, d):
    """Text that is no number, no date or no JSON."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("NO")).otherwise(F.col("value").cast("string")).alias("num"),
                                         F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
                                         F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("props"))
    return _counted(q.row_violations(e, "events", ["event_id"], [q.castable("num", "double"), q.parseable_date("date"), q.parseable_json("props")]))


def unique_keys(spark, d):
    return q.unique_key(table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")), "orders", ["o_custkey", "day"]).select("rule", "key", "value")


def span_rules(spark, d):
    """Year order, span equals number of years, minimum sample and rank not above total."""
    y = observations(spark, d).groupBy("l_suppkey", "entity", "l_linenumber").agg(F.min(F.year("day")).alias("year_min"), F.max(F.year("day")).alias("year_max"),
                                                                  F.count_distinct(F.year("day")).alias("n_years"), F.count(F.lit(1)).alias("n_samples"))
    y = y.withColumns({"rank": F.col("n_samples") % 9, "total": F.col("n_years")})
    return _counted(q.row_violations(y, "span", ["l_suppkey", "entity", "l_linenumber"], [
        q.holds("year_order", "year_min", F.col("year_min") < F.col("year_max")), q.holds("year_span", "n_years", F.col("n_years") == F.col("year_max") - F.col("year_min") + 1),
        q.at_least("n_samples", 30), q.holds("rank_total", "rank", F.col("rank") <= F.col("total"))]))


def color_rules(spark, d):
    """Category and colour must agree; the colours of some normal seasons are swapped on purpose."""
    r = seasons.with_season_category(seasons.rank_seasons(_seasons(spark, d), ["entity", "x"], "avg", F.col("y").between(1996, 1999)))
    r = r.withColumn("color", F.when((F.col("cat") == "normal") & (F.col("y") % 2 == 0), F.lit("#ffffff")).otherwise(F.col("color")))
    return q.row_violations(r, "season", ["entity", "x", "y"], [q.maps_to("cat", "color", cat.SEASON_COLORS)]).select("rule", "key", "value")


def implied_ranges(spark, d):
    """The allowed range depends on the kind."""
    o = observations(spark, d).select("l_orderkey", F.when(F.col("entity") == "A", "days").otherwise("nights").alias("kind"), F.col("qty").alias("threshold"))
    r = [q.implies_range(F.col("kind") == "days", "threshold", 25, 35), q.implies_range(F.col("kind") == "nights", "threshold", 15, 25)]
    return q.row_violations(o, "kinds", ["kind"], r).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def count_matches(spark, d):
    """A stored count against the JSON array it summarises."""
    c = observations(spark, d).groupBy("l_suppkey").agg(*[F.count_if(F.year("day") == y).alias(f"y{y}") for y in range(1995, 2002)],
                                                        F.count_distinct(F.year("day")).alias("nonzero"))
    c = c.select("l_suppkey", F.to_json(F.array(*[f"y{y}" for y in range(1995, 2002)])).alias("counts"),
                 F.when(F.col("l_suppkey") % 6 == 0, F.col("nonzero") - 1).otherwise(F.col("nonzero")).alias("nonzero"))
    return q.row_violations(c, "counts", ["l_suppkey"], [q.positive_count_matches("nonzero", "counts")]).select("rule", "key", "value")


def config_equality(spark, d):
    """Dimension rows against the configuration: missing, unexpected and differing values."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    have = s.filter("s_suppkey % 10 <> 3")
    config = s.filter("s_suppkey % 10 <> 4").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 10 == 5, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    return q.equals_config(have, "supplier", "s_suppkey", config, ["s_nationkey", "s_acctbal"]).select("key", "column", "value")


def continuity_rules(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    return q.daily_continuity(o, "orders", ["o_orderpriority", "o_orderstatus"], "day").select("rule", "key", "value")


def slot_counts(spark, d):
    """Entities that do not have all 365 slots."""
    s = observations(spark, d).select("entity", F.col("l_suppkey").alias("s"), cal.slot("day").alias("slot")).distinct()
    return q.group_size(s, "slots", ["entity", "s"], 365).select("rule", "key", "value")


def bounds_agree(spark, d):
    """Published year bounds against the span of the data; every eighth supplier is published one year short."""
    o = observations(spark, d).select(F.col("l_suppkey").cast("string").alias("k"), F.year("day").alias("year"))
    pub = o.groupBy("k").agg(F.min("year").alias("lo"), F.max("year").alias("hi")).withColumn("hi", F.when(F.col("k").cast("int") % 8 == 0, F.col("hi") - 1).otherwise(F.col("hi")))
    return q.same_bounds(pub, "published", "k", "lo", "hi", o, "year").select("rule", "key", "value")


def collapsed_series(spark, d):
    """Series that hold one value only."""
    o = observations(spark, d).select("l_partkey", F.when(F.col("l_partkey") % 50 == 0, F.lit(1.0)).otherwise(F.col("qty")).alias("v"))
    return q.not_collapsed(o, "series", ["l_partkey"], "v").select("rule", "key")


def constant_columns(spark, d):
    """A column that must hold one value per group."""
    o = observations(spark, d).select("l_suppkey", F.when(F.col("l_suppkey") % 4 == 0, F.col("l_linenumber")).otherwise(F.lit(1)).alias("diff"))
    return q.constant_per_group(o, "raw", ["l_suppkey"], "diff").select("rule", "key", "value")


def provenance_allow_list(spark, d):
    """Provenance values outside the allow-list, each once with its rows."""
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return q.row_violations(o, "orders", ["o_orderstatus"], [q.one_of("o_orderstatus", ["F", "O"])]).select("rule", "key")


def untrusted_fits(spark, d):
    """Trends published from fits that do not trust themselves; those of single days are published on purpose, whatever the fit says."""
    f = count_regression(spark, d).withColumn("trend", F.when(F.col("rate").isNotNull() | (F.col("streak") == 1), F.struct(F.coalesce("rate", F.lit(1.0)).alias("rate"), "per_decade")))
    return q.untrusted_published(f, "tropical", ["entity", "kind", "threshold", "streak"]).select("rule", "key")


def served_shapes(spark, d):
    """Served rows and records that lack their shape: station rows, percentile rows and live records made of suppliers and customers, some of them broken."""
    s = table(spark, d, "supplier")
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    num = lambda c: F.col(c).cast("string")
    key = F.col("s_suppkey")
    station = F.concat_ws(",", num("s_suppkey"), text("s_name"), text("s_name"), F.when(key % 5 == 0, F.lit("null")).otherwise(text("s_name")),
                          F.when(key % 7 == 0, text("s_name")).otherwise(num("s_nationkey")), F.lit('"x"'), num("s_nationkey"), F.lit("14.5"), F.when(key % 11 != 0, F.lit("46")))
    live = F.concat(F.lit('{"station": {"id": "a", "name": '), text("s_name"), F.lit(', "coordinate": {"latitude": 46, "longitude": 14.5, "altitude": '),
                    F.when(key % 3 == 0, F.lit('"high"')).otherwise(F.lit("300")), F.lit('}}, "condition": {"timestamp": "t", "temperature": 1.5}, "statistics": {"timestamp": "t", '),
                    F.when(key % 4 == 0, F.lit("")).otherwise(F.lit('"temperature_average_24h": 1, ')),
                    F.lit('"temperature_min_24h": 0, "temperature_max_24h": 2.5, "timestamp_temperature_min_24h": "t", "timestamp_temperature_max_24h": "t"}}'))
    c = table(spark, d, "customer")
    cuts = F.concat_ws(",", F.col("c_custkey").cast("string"), F.lit("3"), F.when(F.col("c_custkey") % 6 == 0, F.lit("20230101")).otherwise(F.lit('"2023-01-01"')),
                       *[F.lit(str(k)) for k in range(8)], F.when(F.col("c_custkey") % 10 == 0, F.lit("null")).otherwise(F.col("c_acctbal").cast("string")))
    wrap = lambda x: F.concat(F.lit("["), x, F.lit("]"))
    rows = q.row_violations(s.select("s_suppkey", wrap(station).alias("station"), live.alias("live")), "served", ["s_suppkey"],
                            [q.row_shape("station", q.STATION_ROW), q.record_shape("live", q.LIVE_STATION)])
    return rows.unionByName(q.row_violations(c.select("c_custkey", wrap(cuts).alias("cuts")), "percentiles", ["c_custkey"], [q.row_shape("cuts", q.PERCENTILE_ROW)])).select("rule", "key", "column")


def text_tables(spark, d):
    """A derived table as text, with numbers that are none, are not whole or are missing: what its declared types and rules report."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    daily = o.select(F.concat(F.lit("S"), (F.col("o_custkey") % 3).cast("string")).alias("era5_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
                     F.when(k % 97 == 0, "nineteen").otherwise(F.year("o_orderdate").cast("string")).alias("year"), F.when(k % 89 == 0, "2.5").otherwise(F.concat(F.month("o_orderdate").cast("string"), F.lit(".0"))).alias("month"),
                     F.dayofmonth("o_orderdate").cast("string").alias("day"), F.when(k % 83 == 0, F.lit(None)).otherwise(F.lit("5.5")).alias("temperature_max_2m"),
                     F.when(k % 79 == 0, "").otherwise(F.lit("4")).alias("temperature_average_2m"), F.when(k % 73 == 0, "6").otherwise(F.lit("-3e0")).alias("temperature_min_2m"))
    config = spark.createDataFrame([], "era5_name string, lat double, lon double, elevation int, elevation_era5_m int")
    found = validation.table_violations({"daily": daily}, config, ["S0", "S1", "S2"], (1900, 2100))
    return found.filter("rule IN ('castable', 'not_null', 'non_decreasing')").groupBy("rule", "column").agg(F.count(F.lit(1)).alias("n"))


def row_shapes(spark, d):
    """Rows with all fields present and of the right kind."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 12 != 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("bal"))
    return _counted(q.row_violations(c, "customer", ["c_custkey"], [q.not_null("name"), q.not_null("bal"), q.holds("name_form", "name", F.col("name").startswith("Customer#")),
                                                                     q.at_least("bal", 0)]))


def all_reports(spark, d):
    """Every rule of several tables in one report, counted."""
    o = table(spark, d, "orders")
    parts = [q.row_violations(o, "orders", ["o_orderkey"], [q.in_range("o_totalprice", 2000, 480000)]), q.unique_key(o, "orders", ["o_custkey", "o_orderdate"]),
             q.subset_of(o, "orders", "o_custkey", table(spark, d, "customer").filter("c_custkey % 50 <> 7"), "c_custkey"),
             q.entity_count(o, "orders", "o_orderpriority", 6), q.missing_tables(spark, ["orders"], ["orders", "daily"])]
    return q.summary(q.all_of(parts))


QUERIES = {
    "row_rules": (row_rules, f"""WITH {OBS}, o AS (SELECT entity, CASE WHEN l_partkey % 17 <> 0 THEN value END AS t_max, qty AS t_mean, disc AS t_min FROM obs), v AS (
      SELECT 'not_null' AS rule, 't_max' AS "column" FROM o WHERE t_max IS NULL UNION ALL SELECT 'in_range', 't_max' FROM o WHERE t_max NOT BETWEEN -50 AND 45
      UNION ALL SELECT 'one_of', 'entity' FROM o WHERE entity NOT IN ('A', 'N') UNION ALL SELECT 'at_least', 't_min' FROM o WHERE t_min < 3
      UNION ALL SELECT 'non_decreasing', 't_min,t_mean,t_max' FROM o WHERE t_min > t_mean OR t_mean > t_max) SELECT rule, "column", count(*) AS n FROM v GROUP BY ALL"""),
    "violation_rows": (violation_rows, """SELECT 'part' AS "table", 'in_range' AS rule, p_partkey::VARCHAR AS key, 'p_size' AS "column", p_size::VARCHAR AS value FROM part WHERE p_size NOT BETWEEN 3 AND 48
      UNION ALL SELECT 'part', 'one_of', p_partkey::VARCHAR, 'p_type', p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'LARGE')"""),
    "cast_rules": (cast_rules, """SELECT 'castable' AS rule, 'num' AS "column", count(*) AS n FROM events WHERE event_id % 5 = 0 UNION ALL SELECT 'parseable_date', 'date', count(*) FROM events WHERE event_id % 4 = 0
      UNION ALL SELECT 'parseable_json', 'props', count(*) FROM events WHERE event_id % 7 = 0"""),
    "unique_keys": (unique_keys, """SELECT 'unique_key' AS rule, o_custkey || '/' || strftime(o_orderdate, '%Y-%m-%d') AS key, count(*)::VARCHAR AS value FROM orders
      GROUP BY o_custkey, o_orderdate HAVING count(*) > 1"""),
    "span_rules": (span_rules, f"""WITH {OBS}, y AS (SELECT min(year(day)) AS a, max(year(day)) AS b, count(DISTINCT year(day)) AS n, count(*) AS s FROM obs GROUP BY l_suppkey, entity, l_linenumber), v AS (
      SELECT 'year_order' AS rule, 'year_min' AS "column" FROM y WHERE a >= b UNION ALL SELECT 'year_span', 'n_years' FROM y WHERE n <> b - a + 1
      UNION ALL SELECT 'at_least', 'n_samples' FROM y WHERE s < 30 UNION ALL SELECT 'rank_total', 'rank' FROM y WHERE s % 9 > n) SELECT rule, "column", count(*) AS n FROM v GROUP BY ALL"""),
    "color_rules": (color_rules, RANKED + """ SELECT 'maps_to' AS rule, entity || '/' || x || '/' || y AS key, '#ffffff' AS value FROM r3 WHERE cat = 'normal' AND y % 2 = 0"""),
    "implied_ranges": (implied_ranges, """SELECT CASE WHEN l_returnflag = 'A' THEN 'days' ELSE 'nights' END AS key, count(*) AS n FROM lineitem
      WHERE (l_returnflag = 'A' AND l_quantity NOT BETWEEN 25 AND 35) OR (l_returnflag <> 'A' AND l_quantity NOT BETWEEN 15 AND 25) GROUP BY ALL"""),
    "count_matches": (count_matches, """SELECT 'positive_count_matches' AS rule, l_suppkey::VARCHAR AS key, (count(DISTINCT year(l_shipdate)) - 1)::VARCHAR AS value FROM lineitem
      WHERE l_suppkey % 6 = 0 GROUP BY l_suppkey"""),
    "config_equality": (config_equality, """SELECT s_suppkey::VARCHAR AS key, 's_suppkey' AS "column", 'missing' AS value FROM supplier WHERE s_suppkey % 10 = 3
      UNION ALL SELECT s_suppkey::VARCHAR, 's_suppkey', 'unexpected' FROM supplier WHERE s_suppkey % 10 = 4
      UNION ALL SELECT s_suppkey::VARCHAR, 's_nationkey', s_nationkey::VARCHAR FROM supplier WHERE s_suppkey % 10 = 5"""),
    "continuity_rules": (continuity_rules, """WITH o AS (SELECT o_orderpriority || '/' || o_orderstatus AS key, CAST(o_orderdate AS DATE) AS d FROM orders),
      c AS (SELECT key, count(*) - count(DISTINCT d) AS dup, date_diff('day', min(d), max(d)) + 1 - count(DISTINCT d) AS miss FROM o GROUP BY key)
      SELECT 'duplicate_days' AS rule, key, dup::VARCHAR AS value FROM c WHERE dup > 0 UNION ALL SELECT 'missing_days', key, miss::VARCHAR FROM c WHERE miss > 0"""),
    "slot_counts": (slot_counts, f"""WITH {OBS} SELECT 'group_size' AS rule, entity || '/' || l_suppkey AS key, count(DISTINCT {slot_sql("day")})::VARCHAR AS value FROM obs
      GROUP BY entity, l_suppkey HAVING count(DISTINCT {slot_sql("day")}) <> 365"""),
    "bounds_agree": (bounds_agree, """SELECT 'same_bounds' AS rule, l_suppkey::VARCHAR AS key, min(year(l_shipdate)) || '..' || (max(year(l_shipdate)) - 1) AS value FROM lineitem
      WHERE l_suppkey % 8 = 0 GROUP BY l_suppkey"""),
    "collapsed_series": (collapsed_series, """WITH o AS (SELECT l_partkey, CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE l_quantity END AS v FROM lineitem)
      SELECT 'not_collapsed' AS rule, l_partkey::VARCHAR AS key FROM o GROUP BY l_partkey HAVING count(*) >= 2 AND min(v) = max(v)"""),
    "constant_columns": (constant_columns, """SELECT 'constant_per_group' AS rule, l_suppkey::VARCHAR AS key, min(l_linenumber) || '..' || max(l_linenumber) AS value FROM lineitem
      WHERE l_suppkey % 4 = 0 GROUP BY l_suppkey HAVING min(l_linenumber) <> max(l_linenumber)"""),
    "provenance_allow_list": (provenance_allow_list, "SELECT DISTINCT 'one_of' AS rule, o_orderstatus AS key FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
    "untrusted_fits": (untrusted_fits, f"SELECT 'untrusted_published' AS rule, concat_ws('/', entity, kind, threshold, streak) AS key FROM ({COUNT_REGRESSION}) WHERE NOT fit_ok AND streak = 1"),
    "served_shapes": (served_shapes, """SELECT 'row_shape' AS rule, s_suppkey::VARCHAR AS key, 'station' AS "column" FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0
      UNION ALL SELECT 'record_shape', s_suppkey::VARCHAR, 'live' FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0
      UNION ALL SELECT 'row_shape', c_custkey::VARCHAR, 'cuts' FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 10 = 0"""),
    "text_tables": (text_tables, """SELECT 'castable' AS rule, 'year' AS "column", count(*) AS n FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT 'castable', 'month', count(*) FROM orders WHERE o_orderkey % 89 = 0
      UNION ALL SELECT 'castable', 'temperature_average_2m', count(*) FROM orders WHERE o_orderkey % 79 = 0 UNION ALL SELECT 'not_null', 'temperature_max_2m', count(*) FROM orders WHERE o_orderkey % 83 = 0
      UNION ALL SELECT 'non_decreasing', 'temperature_min_2m,temperature_average_2m,temperature_max_2m', count(*) FROM orders WHERE o_orderkey % 73 = 0 AND o_orderkey % 79 <> 0"""),
    "row_shapes": (row_shapes, """SELECT 'not_null' AS rule, 'name' AS "column", count(*) AS n FROM customer WHERE c_custkey % 12 = 0
      UNION ALL SELECT 'at_least', 'bal', count(*) FROM customer WHERE c_acctbal < 0"""),
    "all_reports": (all_reports, """SELECT 'orders' AS "table", 'in_range' AS rule, 'o_totalprice' AS "column", count(*) AS violations FROM orders WHERE o_totalprice NOT BETWEEN 2000 AND 480000
      UNION ALL SELECT 'orders', 'unique_key', 'o_custkey,o_orderdate', count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)
      UNION ALL SELECT 'orders', 'subset_of', 'o_custkey', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 7)
      UNION ALL SELECT 'orders', 'entity_count', 'o_orderpriority', 1 UNION ALL SELECT 'daily', 'missing_table', NULL, 1"""),
}
