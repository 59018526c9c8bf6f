"""Grids: running country means, regridding, flood levels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meteorium.functions import geo
from meteorium.operators import flood, grids
from meteorium.plans import grids as plans

from .inputs import OBS, observations, table

LEVELS = list(range(1, 51))
BOX = geo.Box(south=45.4, north=45.65, west=13.5, east=13.9)
HECTARES = ((45.65 - 45.4) / 500 * 111.32) * ((13.9 - 13.5) / 64 * 111.32 * math.cos(math.radians((45.65 + 45.4) / 2))) * 100


def elevation_cells(spark, d):
    """The embedding table as an elevation grid: one row per vector, one column per dimension, metres between -1 and 1."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return e.select(F.col("x").cast("bigint").alias("x"), "y", F.col("v").cast("double").alias("elevation"))


CELLS = """cells AS (SELECT unnest(range(0, 64)) AS x, vec_id AS y, unnest(embedding)::DOUBLE AS elevation FROM embeddings)"""


def long_grid(spark, d):
    """Array rows to long cells and back to one array per row."""
    c = elevation_cells(spark, d)
    back = c.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", "elevation"))).alias("row"))
    return back.select("y", F.size("row").alias("cells"), F.get("row", F.lit(7))["elevation"].alias("eighth"),
                       F.array_max(F.transform("row", lambda p: p["elevation"])).alias("high"))


def closed_longitude(spark, d):
    """Cells at 0 degrees repeated at 360."""
    c = elevation_cells(spark, d).select((F.col("x") * 5.625).alias("lon"), "y", "elevation")
    return grids.close_longitude(c, "lon").groupBy("lon").agg(F.count(F.lit(1)).alias("n"), F.max("elevation").alias("high"))


def bilinear_grid(spark, d):
    """Half-step bilinear refinement of the grid."""
    return grids.regrid_bilinear(elevation_cells(spark, d), [], "x", "y", "elevation", 2).groupBy("fx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("elevation").alias("total"), F.max("elevation").alias("high"))


def bicubic_grid(spark, d):
    return grids.regrid_bicubic(elevation_cells(spark, d), [], "x", "y", "elevation", 2).groupBy("fx").agg(
        F.count(F.lit(1)).alias("n"), F.avg("elevation").alias("mean"))


def _connected(spark, d):
    return flood.connect_levels(elevation_cells(spark, d))


def flood_extent(spark, d):
    """Cells under water at 5 cm, connected with the sea."""
    return flood.flooded(_connected(spark, d), 0.05).select("x", "y")


def flood_levels(spark, d):
    """Flooded cells at every level from 1 to 50 cm from one solution."""
    c = _connected(spark, d)
    return flood.level_counts(c, LEVELS, base=-1e9)


def newly_flooded(spark, d):
    """Flooded at 10 cm but not sea at 1 cm."""
    return flood.newly_flooded(_connected(spark, d), 0.10).groupBy("x").agg(F.count(F.lit(1)).alias("n"))


def flood_statistics(spark, d):
    """Cells, hectares and buildings per level; orders stand for buildings."""
    pts = table(spark, d, "orders").select((F.col("o_orderkey") % 64).alias("x"), (F.col("o_custkey") % 500).alias("y"))
    return plans.flood_statistics(elevation_cells(spark, d), pts, [5, 10, 20, 30], HECTARES).select("level_cm", "px", "buildings", "ha")


def _reach(levels: list[int], base: bool = False) -> str:
    """Cells that a 4-neighbour path below each level connects with a seed, per level in cm."""
    lv = ", ".join(str(x) for x in levels)
    return f"""WITH RECURSIVE {CELLS}, lv AS (SELECT unnest([{lv}]) AS cm),
      wet AS MATERIALIZED (SELECT cm, x, y FROM cells JOIN lv ON elevation < cm / 100),
      seeds AS (SELECT cm, x, y FROM cells JOIN lv ON elevation < cm / 100 WHERE elevation <= 0 AND (x = 0 OR y = (SELECT max(y) FROM cells))),
      reach(cm, x, y) AS (SELECT cm, x, y FROM seeds UNION SELECT w.cm, w.x, w.y FROM reach r
        JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) ON true JOIN wet w ON w.cm = r.cm AND w.x = r.x + s.dx AND w.y = r.y + s.dy)"""


def model_map(spark, d):
    """Decade means of two variables on a finer grid inside an open box."""
    o = observations(spark, d).select(F.when(F.col("l_linenumber") % 2 == 0, "ensmean").otherwise("perc90").alias("variable"),
                                      (F.year("day") * 12 + F.month("day")).alias("year"), (F.col("l_partkey") % 8).alias("x"),
                                      (F.col("l_suppkey") % 4).alias("y"), (F.col("value") + 273).alias("value"))
    c = o.groupBy("variable", "year", "x", "y").agg(F.avg("value").alias("value"))
    return plans.model_map(c, 1850, geo.Box(-1, 3.2, 0.2, 6.9), 2, ["ensmean", "perc90"], method="bilinear")


def model_map_bicubic(spark, d):
    """The published map: slices that are cubic along each axis, which the spline must give back; a closed circle of eight cells."""
    level = observations(spark, d).groupBy(F.when(F.col("l_linenumber") % 2 == 0, "ensmean").otherwise("perc90").alias("variable"),
                                           (F.year("day") * 12 + F.month("day")).alias("year")).agg(F.avg("value").alias("a"))
    x, y = F.col("x"), F.col("y")
    cells = level.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(4))))
    cells = cells.select("variable", "year", "x", "y", (273.15 + F.col("a") * (1 + x * x * x / 64) + y * y * x / 16 - y * y * y / 32).alias("value"))
    return plans.model_map(cells, 1850, geo.Box(-70, 70, -100, 100), 3, ["ensmean", "perc90"], around=8, step=45.0, south=-90.0)


def historical_country(spark, d):
    """Running country mean over complete windows of three years."""
    c = observations(spark, d).select(F.year("day").alias("year"), F.month("day").alias("month"), (F.col("l_partkey") % 8).alias("x"),
                                      (F.col("l_suppkey") % 4).alias("y"), F.when(F.col("l_partkey") % 8 == 5, F.lit(-9999.0)).otherwise(F.col("value")).alias("value"))
    m = c.groupBy("year", "month", "x", "y").agg(F.avg("value").alias("value"))
    t = plans.historical_grids(m, (1995, 1998), 3)
    run = t["running"].select(F.concat(F.lit("running "), "year_end").alias("row"), "temperature_average")
    special = t["special"].select(F.concat(F.lit("special "), "year_end").alias("row"), "temperature_average")
    yearly = t["yearly"].select(F.concat(F.lit("year "), "year").alias("row"), "temperature_average")
    return run.unionByName(special).unionByName(yearly)


def historical_map(spark, d):
    """Running cell means with their differences to both reference means."""
    c = observations(spark, d).select(F.year("day").alias("year"), (F.col("l_partkey") % 8).alias("x"), (F.col("l_suppkey") % 4).alias("y"), "value")
    m = c.groupBy("year", F.lit(1).alias("month"), "x", "y").agg(F.avg("value").alias("value"))
    return plans.historical_grids(m, (1995, 1998), 3)["map"]


COUNTRY = f"""WITH {OBS}, m AS (SELECT year(day) AS year, month(day) AS month, l_partkey % 8 AS x, 3 - l_suppkey % 4 AS y,
    avg(CASE WHEN l_partkey % 8 = 5 THEN -9999.0 ELSE value END) AS value FROM obs GROUP BY ALL),
  yr AS (SELECT x, y, year, avg(value) AS value FROM m GROUP BY ALL HAVING avg(value) >= -1000),
  country AS (SELECT year, avg(value) AS a FROM yr GROUP BY year),
  rc AS (SELECT x, y, year, avg(value) OVER w AS running, count(*) OVER w AS n FROM yr WINDOW w AS (PARTITION BY x, y ORDER BY year ROWS 2 PRECEDING))"""

def _spline(n: str, source: str, key: str, pos: str) -> str:
    """CTEs that end in ``n``: lines of ``source`` (key, pos, v) with the second derivatives of their not-a-knot splines, by elimination from one end and back."""
    return f"""{n}_l AS (SELECT {key}, list(v ORDER BY {pos}) AS y FROM {source} GROUP BY {key}),
      {n}_b AS (SELECT *, list_transform(range(1, len(y) + 1), lambda i: CASE WHEN i = 1 OR i = len(y) THEN 0 ELSE 6 * (y[i + 1] - 2 * y[i] + y[i - 1]) END) AS b FROM {n}_l),
      {n}_f AS (SELECT {key}, y, b, [0::DOUBLE, b[2] / 6] AS m, [0::DOUBLE, 0::DOUBLE] AS f, 2 AS k FROM {n}_b
        UNION ALL SELECT {key}, y, b, list_append(m, (b[k + 1] - m[k]) / (4 - f[k])), list_append(f, 1 / (4 - f[k])), k + 1 FROM {n}_f WHERE k + 1 <= len(y) - 2),
      {n}_r AS (SELECT {key}, y, b, m, f, [b[len(y) - 1] / 6] AS s, len(y) - 1 AS k FROM {n}_f WHERE k = len(y) - 2
        UNION ALL SELECT {key}, y, b, m, f, list_prepend(m[k - 1] - f[k - 1] * s[1], s), k - 1 FROM {n}_r WHERE k - 1 >= 3),
      {n} AS (SELECT {key}, y, list_concat([2 * m[2] - s[1], m[2]], s, [2 * s[len(s)] - s[len(s) - 1]]) AS s FROM {n}_r WHERE k = 3)"""


def _halved(n: str, key: str, out: str) -> str:
    """Knots and middles of the lines of ``n``."""
    return f"""SELECT {key}, i AS {out}, CASE WHEN i % 2 = 0 THEN y[i // 2 + 1] ELSE (y[i // 2 + 1] + y[i // 2 + 2]) / 2 - (s[i // 2 + 1] + s[i // 2 + 2]) / 16 END AS v
      FROM (SELECT *, unnest(range(0, 2 * len(y) - 1)) AS i FROM {n})"""


QUERIES = {
    "long_grid": (long_grid, "SELECT vec_id AS y, len(embedding)::INTEGER AS cells, embedding[8]::DOUBLE AS eighth, list_max(embedding)::DOUBLE AS high FROM embeddings"),
    "closed_longitude": (closed_longitude, f"""WITH {CELLS}, c AS (SELECT x * 5.625::DOUBLE AS lon, elevation FROM cells UNION ALL SELECT 360.0, elevation FROM cells WHERE x = 0)
      SELECT lon, count(*) AS n, max(elevation) AS high FROM c GROUP BY lon"""),
    "bilinear_grid": (bilinear_grid, f"""WITH {CELLS}, f AS (SELECT 2 * x AS fx, 2 * y AS fy, elevation AS v FROM cells
      UNION ALL SELECT 2 * a.x + 1, 2 * a.y, (a.elevation + b.elevation) / 2 FROM cells a JOIN cells b ON b.y = a.y AND b.x = a.x + 1
      UNION ALL SELECT 2 * a.x, 2 * a.y + 1, (a.elevation + b.elevation) / 2 FROM cells a JOIN cells b ON b.x = a.x AND b.y = a.y + 1
      UNION ALL SELECT 2 * a.x + 1, 2 * a.y + 1, (a.elevation + b.elevation + c.elevation + e.elevation) / 4 FROM cells a JOIN cells b ON b.y = a.y AND b.x = a.x + 1
        JOIN cells c ON c.x = a.x AND c.y = a.y + 1 JOIN cells e ON e.x = a.x + 1 AND e.y = a.y + 1)
      SELECT fx, count(*) AS n, sum(v) AS total, max(v) AS high FROM f GROUP BY fx"""),
    "bicubic_grid": (bicubic_grid, f"""WITH RECURSIVE {CELLS}, src AS (SELECT x, y AS row_no, elevation AS v FROM cells), {_spline("h", "src", "row_no", "x")},
      fine AS ({_halved("h", "row_no", "fx")}), {_spline("w", "fine", "fx", "row_no")}, done AS ({_halved("w", "fx", "fy")})
      SELECT fx, count(*) AS n, avg(v) AS mean FROM done GROUP BY fx"""),
    "flood_extent": (flood_extent, _reach([5]) + " SELECT x, y FROM reach"),
    "flood_levels": (flood_levels, _reach(LEVELS) + " SELECT lv.cm::INTEGER AS level_cm, count(x) AS px FROM lv LEFT JOIN reach ON reach.cm = lv.cm GROUP BY ALL"),
    "newly_flooded": (newly_flooded, _reach([1, 10]) + " SELECT x, count(*) AS n FROM reach a WHERE cm = 10 AND NOT EXISTS (SELECT 1 FROM reach b WHERE b.cm = 1 AND b.x = a.x AND b.y = a.y) GROUP BY x"),
    "flood_statistics": (flood_statistics, _reach([1, 5, 10, 20, 30]) + f""", b AS (SELECT o_orderkey % 64 AS x, o_custkey % 500 AS y, count(*) AS k FROM orders GROUP BY ALL),
      fresh AS (SELECT cm, a.x, a.y FROM reach a WHERE cm > 1 AND NOT EXISTS (SELECT 1 FROM reach c WHERE c.cm = 1 AND c.x = a.x AND c.y = a.y))
      SELECT cm::INTEGER AS level_cm, count(*) AS px, coalesce(sum(k), 0)::BIGINT AS buildings, floor(count(*) * {HECTARES!r}::DOUBLE * 10 + 0.5) / 10 AS ha
      FROM fresh LEFT JOIN b ON b.x = fresh.x AND b.y = fresh.y GROUP BY cm"""),
    "model_map": (model_map, f"""WITH {OBS}, o AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'ensmean' ELSE 'perc90' END AS variable, year(day) * 12 + month(day) AS step, l_partkey % 8 AS x, l_suppkey % 4 AS y,
        avg(value + 273) - 273.15 AS v FROM obs GROUP BY ALL),
      r AS (SELECT variable, x, y, avg(v) OVER (PARTITION BY variable, x, y ORDER BY step ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m,
        row_number() OVER (PARTITION BY variable, x, y ORDER BY step) - 1 AS i FROM o),
      s AS (SELECT * FROM r WHERE i >= 6 AND (i - 6) % 10 = 0),
      w AS (SELECT variable, i, x * 2 + dx AS fx, y * 2 + dy AS fy, (1 - abs(dx) / 2) * (1 - abs(dy) / 2) AS wt, m FROM s, (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b),
      f AS (SELECT variable, i, fx, fy, sum(wt * m) AS v FROM w GROUP BY ALL HAVING abs(sum(wt) - 1) < 1e-9)
      SELECT (1850 + i - 6)::INTEGER AS year_start, (1859 + i - 6)::INTEGER AS year_end, fy / 2 AS latitude, fx / 2 AS longitude,
      round(avg(v) FILTER (WHERE variable = 'ensmean'), 2) AS ensmean, round(avg(v) FILTER (WHERE variable = 'perc90'), 2) AS perc90
      FROM f WHERE fx / 2 > 0.2 AND fx / 2 < 6.9 AND fy / 2 > -1 AND fy / 2 < 3.2 GROUP BY ALL"""),
    "model_map_bicubic": (model_map_bicubic, f"""WITH {OBS}, o AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'ensmean' ELSE 'perc90' END AS variable, year(day) * 12 + month(day) AS step, avg(value) AS a
        FROM obs GROUP BY ALL),
      r AS (SELECT variable, avg(a) OVER (PARTITION BY variable ORDER BY step ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m, row_number() OVER (PARTITION BY variable ORDER BY step) - 1 AS i FROM o),
      f AS (SELECT variable, i, m, unnest(range(0, 22)) / 3 AS x FROM r WHERE i >= 6 AND (i - 6) % 10 = 0),
      g AS (SELECT *, unnest(range(0, 13)) / 3 AS y FROM f),
      v AS (SELECT variable, i, CASE WHEN x * 45 > 180 THEN x * 45 - 360 ELSE x * 45 END AS longitude, y * 45 - 90 AS latitude, m * (1 + x * x * x / 64) + y * y * x / 16 - y * y * y / 32 AS v FROM g)
      SELECT (1850 + i - 6)::INTEGER AS year_start, (1859 + i - 6)::INTEGER AS year_end, latitude, longitude,
      round(avg(v) FILTER (WHERE variable = 'ensmean'), 2) AS ensmean, round(avg(v) FILTER (WHERE variable = 'perc90'), 2) AS perc90
      FROM v WHERE longitude > -100 AND longitude < 100 AND latitude > -70 AND latitude < 70 GROUP BY ALL"""),
    "historical_country": (historical_country, COUNTRY + """ SELECT 'running ' || year AS row, avg(running) AS temperature_average FROM rc WHERE n = 3 GROUP BY year
      UNION ALL SELECT 'special 1998', avg(a) FROM country WHERE year BETWEEN 1995 AND 1998 UNION ALL SELECT 'special 2001', avg(a) FROM country
      UNION ALL SELECT 'year ' || year, a FROM country"""),
    "historical_map": (historical_map, f"""WITH {OBS}, yr AS (SELECT year(day)::INTEGER AS year, l_partkey % 8 AS x, 3 - l_suppkey % 4 AS y, avg(value) AS v FROM obs GROUP BY ALL),
      f AS (SELECT x, y, avg(v) AS a, avg(v) FILTER (WHERE year BETWEEN 1995 AND 1998) AS e FROM yr GROUP BY ALL),
      r AS (SELECT x, y, year, avg(v) OVER w AS m, count(*) OVER w AS n FROM yr WINDOW w AS (PARTITION BY x, y ORDER BY year ROWS 2 PRECEDING))
      SELECT year - 2 AS year_start, year AS year_end, x, y, m AS temperature_average, m - a AS temperature_difference_to_average, m - e AS temperature_difference_to_average_until_1990
      FROM r JOIN f USING (x, y) WHERE n = 3"""),
}
