"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.functions import calendar as cal
from meteorium.functions import categories as cat
from meteorium.functions import geo
from meteorium.functions import numeric as num
from meteorium.functions import text as txt
from meteorium.operators import grids
from meteorium.plans import emissions
from meteorium.sources import readers
from meteorium.streaming import rollup

from .inputs import DAILY, OBS, daily, day_text, observations, table


def lapse_correction(spark, d):
    """Three temperatures moved by an elevation difference in a multiple of 1/64 m."""
    o = observations(spark, d).withColumn("diff", (F.col("l_suppkey") % 32 - 16) / 64)
    c = lambda v: num.lapse_corrected(v, "diff")
    return o.groupBy("entity", "l_suppkey").agg(F.max(c("value")).alias("t_max"), F.min(c("value")).alias("t_min"),
                                                F.max(c(F.col("value") / 2)).alias("t_half"))


def daily_table(spark, d):
    x = daily(spark, d)
    r = lambda c: num.round_to(c, 3)
    return x.select("entity", day_text("day").alias("date"), F.year("day").alias("year"), F.month("day").alias("month"),
                    F.dayofmonth("day").alias("dom"), r("v_max").alias("v_max"), r("v_min").alias("v_min"))


def display_names(spark, d):
    """Display, default official and locative names from underscore names; some entities have their own."""
    p = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("raw"),
                                       F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("official"))
    shown = txt.display_name("raw")
    return p.select("p_partkey", shown.alias("name"), F.coalesce("official", shown).alias("official_name"),
                    F.concat(F.lit("v "), shown).alias("name_locative"))


def label_split(spark, d):
    p = table(spark, d, "part")
    prefix, rest = txt.label_parts(F.concat("p_type", F.lit(" "), "p_name"))
    return p.select("p_partkey", prefix.alias("prefix"), rest.alias("rest"))


def kelvin(spark, d):
    return observations(spark, d).groupBy("entity").agg(F.min(num.kelvin_to_celsius(F.col("value") + 273)).alias("low"),
                                                        F.max(num.kelvin_to_celsius(F.col("value") + 273)).alias("high"))


BOX = geo.Box(south=20, north=75, west=-15, east=65)


def longitude_box(spark, d):
    """Longitudes 0..360 wrapped and cut to an open box."""
    o = observations(spark, d).select((F.col("l_partkey") % 360 + 0.5).alias("lon"), (F.col("l_orderkey") % 180 - 90.0).alias("lat"), "value")
    w = o.withColumn("lon", geo.wrap_longitude("lon")).filter(geo.inside("lat", "lon", BOX))
    return w.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def masked_flipped_grid(spark, d):
    """Rows flipped from the north, no-data cells left out."""
    c = observations(spark, d).groupBy((F.col("l_partkey") % 20).alias("x"), (F.col("l_suppkey") % 10).alias("y")).agg(F.sum("value").alias("v"))
    c = c.withColumn("v", F.when(F.col("x") % 7 == 0, F.lit(-9999.0)).otherwise(F.col("v")))
    return grids.mask_below(grids.flip_rows(c, [], "y"), "v")


def notation_zero(spark, d):
    """Notation keys as 0, or a null when they should stay unknown."""
    o = table(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, F.lit("NO,NA")).otherwise(
        F.col("o_custkey").cast("string")).alias("raw"))
    return o.groupBy("o_orderpriority").agg(F.sum(num.number_or_zero("raw")).alias("total"),
                                            F.count(F.col("raw").try_cast("double")).alias("numbers"),
                                            F.avg(F.col("raw").try_cast("double")).alias("mean_known"))


def co2_equivalents(spark, d):
    """Three gases weighted by their warming potential, per year."""
    l = observations(spark, d).select(F.year("day").alias("year"), "qty", F.element_at(F.array(F.lit("co2"), F.lit("ch4"), F.lit("n2o"), F.lit("nox")),
                                                                                       (F.col("l_partkey") % 4 + 1).cast("int")).alias("gas"))
    return l.groupBy("year").agg(F.sum(emissions.co2_equivalent("gas", "qty")).alias("co2e"))


def served_predicates(spark, d):
    """Equality, upper bound and suffix predicates with a projection, as they reach the scan."""
    o = table(spark, d, "orders")
    return (o.filter((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderdate") <= F.to_timestamp(F.lit("1998-12-31")))
                     & day_text("o_orderdate").endswith("-15")).select("o_orderkey", day_text("o_orderdate").alias("date"), "o_totalprice"))


def feature_columns(spark, d):
    """Columns chosen by feature flags."""
    cols = readers.columns_for({"water": True, "wind": False}, ["entity", "v_max"], {"water": ["wet", "dry"], "wind": ["gust"]})
    return daily(spark, d).select(*cols).groupBy("entity").agg(*[F.max(c).alias(c) for c in cols[1:]])


def valid_records(spark, d):
    """Finite values in years 1996 to 2000; some values are broken on purpose."""
    v = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col("value"))
    o = observations(spark, d).select("entity", F.year("day").alias("year"), v.alias("value"))
    good = rollup.valid_records(o, "year", "value", (1996, 2000))
    return good.groupBy("entity", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def first_available(spark, d):
    """First of several value columns that is present."""
    o = observations(spark, d).select("entity", F.when(F.col("l_linenumber") == 1, F.col("value")).alias("a"),
                                      F.when(F.col("l_linenumber") <= 2, F.col("qty")).alias("b"), F.col("disc").alias("c"))
    return o.groupBy("entity").agg(F.sum(F.coalesce("a", "b", "c")).alias("total"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))


def map_variable(spark, d):
    """One variable of the wide map for one period."""
    wide = daily(spark, d).groupBy("entity", F.year("day").alias("year")).agg(
        F.max("v_max").alias("ensmean"), F.min("v_min").alias("perc10"), F.max("wet").alias("perc90"))
    return grids.map_variables(wide, ["entity"], ["ensmean", "perc10", "perc90"], ["ensmean", "perc10"], "year", 1998)


def variable_units(spark, d):
    """Unit of each variable in the long table."""
    long = daily(spark, d).select("entity", F.col("v_max").alias("temperature_max"), F.col("wet").alias("precipitation_sum"),
                                  F.col("dry").alias("et0_evapotranspiration")).unpivot(
        ["entity"], ["temperature_max", "precipitation_sum", "et0_evapotranspiration"], "variable", "value")
    return long.groupBy("variable", cat.variable_unit("variable").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))


def clamp_and_round(spark, d):
    o = observations(spark, d)
    return o.groupBy("entity").agg(F.sum(num.clamp("value", 10.0, 60.0)).alias("clamped"), F.sum(num.round_to(F.col("qty") / 8, 0)).alias("rounded"))


def month_day_fallback(spark, d):
    """Lookup key of each day in a 365-row climatology."""
    return observations(spark, d).groupBy(cal.month_day_no_leap("day").alias("key")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "lapse_correction": (lapse_correction, f"""WITH {OBS}, o AS (SELECT *, (l_suppkey % 32 - 16) / 64 AS diff FROM obs)
      SELECT entity, l_suppkey, max(value + diff * 0.0065) AS t_max, min(value + diff * 0.0065) AS t_min,
      max(value / 2 + diff * 0.0065) AS t_half FROM o GROUP BY ALL"""),
    "daily_table": (daily_table, f"""WITH {DAILY} SELECT entity, strftime(day, '%Y-%m-%d') AS date, year(day)::INTEGER AS year,
      month(day)::INTEGER AS month, day(day)::INTEGER AS dom, floor(v_max * 1000 + 0.5) / 1000 AS v_max,
      floor(v_min * 1000 + 0.5) / 1000 AS v_min FROM daily"""),
    "display_names": (display_names, """SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS official_name,
      'v ' || p_name AS name_locative FROM part"""),
    "label_split": (label_split, """SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ')[1] AS prefix,
      array_to_string(string_split(p_type || ' ' || p_name, ' ')[2:], ' ') AS rest FROM part"""),
    "kelvin": (kelvin, f"WITH {OBS} SELECT entity, min(value + 273 - 273.15) AS low, max(value + 273 - 273.15) AS high FROM obs GROUP BY entity"),
    "longitude_box": (longitude_box, f"""WITH {OBS}, o AS (SELECT l_partkey % 360 + 0.5::DOUBLE AS l0, l_orderkey % 180 - 90.0::DOUBLE AS lat, value FROM obs),
      w AS (SELECT CASE WHEN l0 > 180 THEN l0 - 360 ELSE l0 END AS lon, lat, value FROM o)
      SELECT lon, lat, count(*) AS n, sum(value) AS value FROM w WHERE lon > -15 AND lon < 65 AND lat > 20 AND lat < 75 GROUP BY ALL"""),
    "masked_flipped_grid": (masked_flipped_grid, f"""WITH {OBS}, c AS (SELECT l_partkey % 20 AS x, l_suppkey % 10 AS y, sum(value) AS v FROM obs GROUP BY ALL)
      SELECT x, (SELECT max(y) FROM c) - y AS y, v FROM c WHERE x % 7 <> 0"""),
    "notation_zero": (notation_zero, """WITH o AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN 'NO,NA' ELSE o_custkey::VARCHAR END AS raw FROM orders)
      SELECT o_orderpriority, sum(coalesce(try_cast(raw AS DOUBLE), 0)) AS total, count(try_cast(raw AS DOUBLE)) AS numbers,
      avg(try_cast(raw AS DOUBLE)) AS mean_known FROM o GROUP BY ALL"""),
    "co2_equivalents": (co2_equivalents, f"""WITH {OBS} SELECT year(day)::INTEGER AS year,
      sum(qty * CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 25 WHEN 2 THEN 298 ELSE 0 END) AS co2e FROM obs GROUP BY ALL"""),
    "served_predicates": (served_predicates, """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice FROM orders
      WHERE o_orderpriority = '2-HIGH' AND o_orderdate <= TIMESTAMP '1998-12-31' AND day(o_orderdate) = 15"""),
    "feature_columns": (feature_columns, f"WITH {DAILY} SELECT entity, max(v_max) AS v_max, max(wet) AS wet, max(dry) AS dry FROM daily GROUP BY entity"),
    "valid_records": (valid_records, f"""WITH {OBS} SELECT entity, year(day)::INTEGER AS year, count(*) AS n, sum(value) AS value FROM obs
      WHERE l_linenumber NOT IN (3, 4) AND year(day) BETWEEN 1996 AND 2000 GROUP BY ALL"""),
    "first_available": (first_available, f"""WITH {OBS} SELECT entity, sum(CASE WHEN l_linenumber = 1 THEN value WHEN l_linenumber <= 2 THEN qty ELSE disc END) AS total,
      count(*) FILTER (WHERE l_linenumber = 1) AS n_a, count(*) FILTER (WHERE l_linenumber <= 2) AS n_b FROM obs GROUP BY entity"""),
    "map_variable": (map_variable, f"""WITH {DAILY}, w AS (SELECT entity, year(day)::INTEGER AS year, max(v_max) AS a, min(v_min) AS b FROM daily WHERE year(day) = 1998 GROUP BY ALL)
      SELECT entity, year, 'ensmean' AS variable, a AS value FROM w UNION ALL SELECT entity, year, 'perc10', b FROM w"""),
    "variable_units": (variable_units, f"""WITH {DAILY} SELECT 'temperature_max' AS variable, '°C' AS unit, count(*) AS n, max(v_max) AS high FROM daily
      UNION ALL SELECT 'precipitation_sum', 'mm', count(*), max(wet) FROM daily UNION ALL SELECT 'et0_evapotranspiration', 'mm', count(*), max(dry) FROM daily"""),
    "clamp_and_round": (clamp_and_round, f"""WITH {OBS} SELECT entity, sum(least(greatest(value, 10.0), 60.0)) AS clamped,
      sum(floor(qty / 8 + 0.5)) AS rounded FROM obs GROUP BY entity"""),
    "month_day_fallback": (month_day_fallback, """SELECT CASE WHEN strftime(l_shipdate, '%m-%d') = '02-29' THEN '02-28' ELSE strftime(l_shipdate, '%m-%d') END AS key,
      count(*) AS n FROM lineitem GROUP BY ALL"""),
}
