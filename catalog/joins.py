"""Lookups, set checks, cell joins and interpolating joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.functions import geo
from meteorium.operators import quality, series
from meteorium.operators import zones as zone_ops
from meteorium.plans import climatology
from meteorium.streaming import refresh

from .inputs import OBS, PRIORITY, day_text, level, observations, priority_daily, table


def fact_to_entity(spark, d):
    """Every fact keeps its row; unmapped suppliers have a null id."""
    dim = table(spark, d, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    o = observations(spark, d).join(dim, "l_suppkey", "left")
    return o.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def mapped_entities_only(spark, d):
    dim = table(spark, d, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return observations(spark, d).join(dim, "l_suppkey").groupBy("s_nationkey", "entity").agg(F.count(F.lit(1)).alias("n"))


def dimension_assembly(spark, d):
    """Entities left-joined with ids and details, with default names."""
    s = table(spark, d, "supplier")
    config = s.select(F.replace("s_name", F.lit("#"), F.lit("_")).alias("era5_name"), F.col("s_acctbal").alias("lat"), F.col("s_acctbal").alias("lon"),
                      F.col("s_nationkey").alias("elevation"), F.col("s_nationkey").alias("elevation_era5_m"))
    ids = s.filter("s_suppkey % 2 = 0").select(F.replace("s_name", F.lit("#"), F.lit("_")).alias("era5_name"), F.col("s_suppkey").alias("station_id"))
    details = s.filter("s_suppkey % 3 = 0").select(F.replace("s_name", F.lit("#"), F.lit("_")).alias("era5_name"),
                                                   F.concat(F.lit("S "), F.col("s_suppkey")).alias("official_name"),
                                                   F.lit(None).cast("string").alias("name_locative"), F.col("s_nationkey").alias("xml_id"))
    return climatology.station_table(config, ids, details)


def metadata_gaps(spark, d):
    """Entities without details and details without an entity."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("era5_name"))
    return climatology.metadata_gaps(s.filter("k % 5 <> 0").select("era5_name"), s.filter("k % 7 <> 0").select("era5_name"))


def observation_climatology(spark, d):
    """Each observation next to the mean of its month and day."""
    o = observations(spark, d)
    md = [F.month("day").alias("month"), F.dayofmonth("day").alias("dom")]
    clim = o.groupBy("entity", *md).agg(F.avg("value").alias("normal"))
    x = o.select("entity", *md, "value").join(clim, ["entity", "month", "dom"])
    return x.groupBy("entity", "month").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= F.col("normal")).alias("above"))


def source_priority(spark, d):
    """Archive value first, live value second, with a preliminary flag."""
    p = priority_daily(spark, d).select("entity", "day", "v_max", "v_mean")
    archive = p.filter("dayofyear(day) % 3 <> 0").select("entity", "day", F.col("v_max").alias("a"))
    live = p.filter("dayofyear(day) % 2 = 0").select("entity", "day", F.col("v_mean").alias("b"))
    x = archive.join(live, ["entity", "day"], "full_outer")
    return x.select("entity", day_text("day").alias("day"), F.coalesce("a", "b").alias("value"), F.col("a").isNull().cast("int").alias("preliminary"))


def merged_variables(spark, d):
    """Long variables to one wide row per key."""
    o = observations(spark, d).select("entity", F.year("day").alias("year"), F.col("l_linenumber").alias("var"), "value")
    return o.groupBy("entity", "year").agg(*[F.avg(F.when(F.col("var") == k, F.col("value"))).alias(f"v{k}") for k in range(1, 8)])


BOX = geo.Box(south=0, north=100, west=0, east=2000)


def points_on_cells(spark, d):
    """Points to raster cells by computed keys; only points on cells of the raster survive."""
    pts = observations(spark, d).select(geo.cell_row(F.col("l_suppkey").cast("double"), BOX, 16).alias("row"),
                                        geo.cell_col(F.col("l_partkey").cast("double"), BOX, 32).alias("col"))
    cells = table(spark, d, "orders").groupBy((F.col("o_custkey") % 16).cast("int").alias("row"), (F.col("o_orderkey") % 29).cast("int").alias("col")).agg(
        F.max(level("o_totalprice")).alias("elevation"))
    per = pts.groupBy("row", "col").agg(F.count(F.lit(1)).alias("points"))
    return per.join(cells, ["row", "col"])


def zone_membership(spark, d):
    """Points inside any of two fixed boxes, edges included; the zones are a constant, so this is a row filter."""
    zones = [("old port", geo.Box(10, 39.5, 100, 636)), ("bay", geo.Box(38, 52, 500, 1752))]
    o = observations(spark, d).withColumn("zone", F.explode(F.filter(F.array(*[
        F.when(geo.inside(F.col("l_suppkey"), F.col("l_partkey"), b, open_bounds=False), F.lit(n)) for n, b in zones]), lambda z: z.isNotNull())))
    return o.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def zone_table(spark, d):
    """Points inside the boxes of a zone table: boxes of the suppliers, of very different shapes, some of them empty or one line."""
    wide, high = F.pow(F.lit(3.0), F.col("s_suppkey") % 7), F.col("s_nationkey") % 6 * F.when(F.col("s_suppkey") % 11 == 0, -1).otherwise(1)
    zones = table(spark, d, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") * 37 % 2000 - wide).alias("west"), (F.col("s_suppkey") * 37 % 2000 + wide).alias("east"),
        (F.col("s_suppkey") - high).alias("south"), (F.col("s_suppkey") + high).alias("north"))
    o = observations(spark, d).select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), "value")
    return zone_ops.zone_join(o, zones, "x", "y").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def snapped_levels(spark, d):
    """Levels snapped to the published steps and looked up."""
    lev = table(spark, d, "orders").groupBy((F.col("o_custkey") % 25 * 10 + 10).cast("int").alias("level_cm")).agg(F.count(F.lit(1)).alias("ha"))
    req = observations(spark, d).withColumn("level_cm", geo.snap_level(F.col("value") * 4))
    return req.join(lev, "level_cm").groupBy("level_cm", "ha").agg(F.count(F.lit(1)).alias("requests"))


def piecewise_lookup(spark, d):
    """Piecewise-linear value with constant ends from yearly knots per entity."""
    knots = observations(spark, d).filter("year(day) % 2 = 0").groupBy("entity", F.year("day").alias("year")).agg(F.avg("value").alias("y"))
    req = observations(spark, d).groupBy("entity", (F.year("day") + (F.month("day") - 1) / 16).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return series.lookup_piecewise(req, knots, ["entity"], "year", "at", {"value": "y"})


def yearly_interpolation(spark, d):
    """Every second year interpolated to all years."""
    knots = observations(spark, d).filter("year(day) % 2 = 1").groupBy("entity", F.year("day").alias("year")).agg(
        F.avg("value").alias("a"), F.sum("qty").alias("b"))
    return series.interpolate_yearly(knots, ["entity"], "year", ["a", "b"])


def row_alignment(spark, d):
    """Two tables compared by key: present on one side, on both and equal, or different."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"))
    other = o.filter("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.col("a") + 1).otherwise(F.col("a")).alias("b"))
    x = o.filter("o_orderkey % 17 <> 0").join(other, "o_orderkey", "full_outer")
    state = F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("different")
    return x.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def id_subset(spark, d):
    """Supplier ids of the facts that the dimension does not know."""
    known = table(spark, d, "supplier").filter("s_suppkey % 6 <> 1")
    return quality.subset_of(table(spark, d, "lineitem"), "lineitem", "l_suppkey", known, "s_suppkey")


def late_entities(spark, d):
    """Expected customers without an order after a date."""
    o = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.to_timestamp(F.lit("2000-01-01")))
    return refresh.late_entities(o.select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


def anomaly_to_climatology(spark, d):
    """Anomaly with sign flag against the entity's mean of the slot's month."""
    o = observations(spark, d)
    base = o.groupBy("entity", F.month("day").alias("month")).agg(F.avg("value").alias("base"))
    x = o.select("entity", F.month("day").alias("month"), F.year("day").alias("year"), "value").join(base, ["entity", "month"])
    g = x.groupBy("entity", "month", "year").agg(F.avg("value").alias("v"), F.max("base").alias("base"))
    return g.select("entity", "month", "year", (F.col("v") - F.col("base")).alias("anomaly"), F.when(F.col("v") >= F.col("base"), "warm").otherwise("cold").alias("sign"))


QUERIES = {
    "fact_to_entity": (fact_to_entity, f"""WITH {OBS} SELECT s_nationkey, count(*) AS n, sum(value) AS value FROM obs
      LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) s ON s_suppkey = l_suppkey GROUP BY ALL"""),
    "mapped_entities_only": (mapped_entities_only, f"""WITH {OBS} SELECT s_nationkey, entity, count(*) AS n FROM obs
      JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 4 <> 0 GROUP BY ALL"""),
    "dimension_assembly": (dimension_assembly, """SELECT replace(s_name, '#', '_') AS era5_name, replace(replace(s_name, '#', '_'), '_', ' ') AS name,
      CASE WHEN s_suppkey % 3 = 0 THEN 'S ' || s_suppkey ELSE replace(s_name, '#', ' ') END AS official_name, 'v ' || replace(s_name, '#', ' ') AS name_locative,
      CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS station_id, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END AS xml_id,
      s_acctbal AS lat, s_acctbal AS lon, s_nationkey AS elevation, s_nationkey AS elevation_era5_m FROM supplier"""),
    "metadata_gaps": (metadata_gaps, """SELECT s_name AS era5_name, 'missing' AS problem FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 = 0
      UNION ALL SELECT s_name, 'orphan' FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 7 <> 0"""),
    "observation_climatology": (observation_climatology, f"""WITH {OBS}, c AS (SELECT entity, month(day) AS m, day(day) AS dd, avg(value) AS normal FROM obs GROUP BY ALL)
      SELECT o.entity, month(o.day)::INTEGER AS month, count(*) AS n, count(*) FILTER (WHERE value >= normal) AS above FROM obs o
      JOIN c ON c.entity = o.entity AND c.m = month(o.day) AND c.dd = day(o.day) GROUP BY ALL"""),
    "source_priority": (source_priority, f"""WITH {PRIORITY}, a AS (SELECT entity, day, v_max FROM pdaily WHERE dayofyear(day) % 3 <> 0),
      b AS (SELECT entity, day, v_mean FROM pdaily WHERE dayofyear(day) % 2 = 0)
      SELECT entity, strftime(day, '%Y-%m-%d') AS day, coalesce(v_max, v_mean) AS value, (v_max IS NULL)::INTEGER AS preliminary
      FROM a FULL JOIN b USING (entity, day)"""),
    "merged_variables": (merged_variables, f"""WITH {OBS} SELECT entity, year(day)::INTEGER AS year,
      {", ".join(f"avg(value) FILTER (WHERE l_linenumber = {k}) AS v{k}" for k in range(1, 8))} FROM obs GROUP BY ALL"""),
    "points_on_cells": (points_on_cells, f"""WITH {OBS}, {PRIORITY}, p AS (SELECT trunc((100 - l_suppkey) / 100 * 16)::INTEGER AS row,
        trunc(l_partkey / 2000 * 32)::INTEGER AS col, count(*) AS points FROM obs GROUP BY ALL),
      c AS (SELECT (o_custkey % 16)::INTEGER AS row, (o_orderkey % 29)::INTEGER AS col, max(round(o_totalprice * 100) / 131072.0) AS elevation FROM orders GROUP BY ALL)
      SELECT row, col, points, elevation FROM p JOIN c USING (row, col)"""),
    "zone_membership": (zone_membership, f"""WITH {OBS}, z(zone, s, n, w, e) AS (VALUES ('old port', 10, 39.5, 100, 636), ('bay', 38, 52, 500, 1752))
      SELECT zone, count(*) AS n, sum(value) AS value FROM obs JOIN z ON l_suppkey BETWEEN z.s AND z.n AND l_partkey BETWEEN z.w AND z.e GROUP BY zone"""),
    "zone_table": (zone_table, f"""WITH {OBS}, z AS (SELECT s_suppkey, s_suppkey * 37 % 2000 AS c, 3 ** (s_suppkey % 7) AS w, s_nationkey % 6 * CASE WHEN s_suppkey % 11 = 0 THEN -1 ELSE 1 END AS h FROM supplier)
      SELECT s_suppkey, count(*) AS n, sum(value) AS value FROM obs JOIN z ON l_partkey BETWEEN c - w AND c + w AND l_suppkey BETWEEN s_suppkey - h AND s_suppkey + h GROUP BY s_suppkey"""),
    "snapped_levels": (snapped_levels, f"""WITH {OBS}, lev AS (SELECT (o_custkey % 25 * 10 + 10)::INTEGER AS level_cm, count(*) AS ha FROM orders GROUP BY ALL),
      r AS (SELECT least(greatest((floor(value * 4 / 10 + 0.5) * 10)::INTEGER, 10), 250) AS level_cm FROM obs)
      SELECT level_cm, ha, count(*) AS requests FROM r JOIN lev USING (level_cm) GROUP BY ALL"""),
    "piecewise_lookup": (piecewise_lookup, f"""WITH {OBS}, k AS (SELECT entity, year(day)::DOUBLE AS x, avg(value) AS y FROM obs WHERE year(day) % 2 = 0 GROUP BY ALL),
      s AS (SELECT *, lead(x) OVER (PARTITION BY entity ORDER BY x) AS x1, lead(y) OVER (PARTITION BY entity ORDER BY x) AS y1,
        min(x) OVER (PARTITION BY entity) AS lo, max(x) OVER (PARTITION BY entity) AS hi FROM k),
      r AS (SELECT entity, year(day) + (month(day) - 1) / 16 AS at, count(*) AS n FROM obs GROUP BY ALL)
      SELECT r.entity, r.at, r.n, CASE WHEN r.at <= s.lo OR r.at >= s.hi THEN s.y ELSE s.y + (r.at - s.x) / (s.x1 - s.x) * (s.y1 - s.y) END AS value
      FROM r JOIN s ON s.entity = r.entity AND ((r.at <= s.lo AND s.x = s.lo) OR (r.at >= s.hi AND s.x = s.hi) OR (r.at > s.lo AND r.at < s.hi AND s.x <= r.at AND r.at < s.x1))"""),
    "yearly_interpolation": (yearly_interpolation, f"""WITH {OBS}, k AS (SELECT entity, year(day) AS x, avg(value) AS a, sum(qty) AS b FROM obs WHERE year(day) % 2 = 1 GROUP BY ALL),
      s AS (SELECT *, lead(x) OVER w AS x1, lead(a) OVER w AS a1, lead(b) OVER w AS b1 FROM k WINDOW w AS (PARTITION BY entity ORDER BY x)),
      g AS (SELECT *, unnest(range(x, coalesce(x1, x + 1))) AS t FROM s)
      SELECT entity, t::INTEGER AS year, CASE WHEN t = x THEN a ELSE a + (t - x) / (x1 - x) * (a1 - a) END AS a,
      CASE WHEN t = x THEN b ELSE b + (t - x) / (x1 - x) * (b1 - b) END AS b FROM g"""),
    "row_alignment": (row_alignment, """SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'only_left' WHEN o_orderkey % 17 = 0 THEN 'only_right'
      WHEN o_orderkey % 13 = 0 THEN 'different' ELSE 'same' END AS state, count(*) AS n FROM orders
      WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 17 = 0) GROUP BY ALL"""),
    "id_subset": (id_subset, """SELECT DISTINCT 'lineitem' AS "table", 'subset_of' AS rule, l_suppkey::VARCHAR AS key, 'l_suppkey' AS "column", l_suppkey::VARCHAR AS value
      FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 6 <> 1)"""),
    "late_entities": (late_entities, """SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN
      (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')"""),
    "anomaly_to_climatology": (anomaly_to_climatology, f"""WITH {OBS}, b AS (SELECT entity, month(day) AS month, avg(value) AS base FROM obs GROUP BY ALL),
      g AS (SELECT entity, month(day) AS month, year(day) AS year, avg(value) AS v FROM obs GROUP BY ALL)
      SELECT entity, month::INTEGER AS month, year::INTEGER AS year, v - base AS anomaly, CASE WHEN v >= base THEN 'warm' ELSE 'cold' END AS sign
      FROM g JOIN b USING (entity, month)"""),
}
