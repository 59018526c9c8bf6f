"""Emission tables from coded cells; orders stand for spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.plans import emissions

from .inputs import table


def _cells(spark, d):
    """Cells (year, code, raw) with a notation key in every seventh cell."""
    return table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 60).cast("int").alias("code"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("NO,NA")).otherwise((F.col("o_orderkey") % 1000).cast("string")).alias("raw"))


CELLS = """WITH c AS (SELECT year(o_orderdate)::INTEGER AS year, o_custkey % 60 AS code, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 1000)::DOUBLE END AS v FROM orders)"""


def historical_emissions(spark, d):
    return emissions.historical(_cells(spark, d))["historical"]


def _detail(name):
    def run(spark, d):
        return emissions.historical(_cells(spark, d))[name]
    return run


def _wide_sql(columns, sums=None):
    parts = [f'sum(v) FILTER (WHERE code = {c}) AS "{n}"' for n, c in columns.items()]
    parts += [" + ".join(f"sum(v) FILTER (WHERE code = {c})" for c in cs) + f' AS "{n}"' for n, cs in (sums or {}).items()]
    wanted = sorted({*columns.values(), *(c for cs in (sums or {}).values() for c in cs)})
    return f"{CELLS} SELECT year, {', '.join(parts)} FROM c WHERE code IN ({', '.join(map(str, wanted))}) GROUP BY year"


def transport_breakdown(spark, d):
    o = table(spark, d, "orders")
    gas = F.element_at(F.array(F.lit("co2"), F.lit("ch4"), F.lit("n2o")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.lit("NO")).otherwise((F.col("o_orderkey") % 1000).cast("string"))
    y = F.year("o_orderdate").alias("year")
    cells = o.select(y, (F.col("o_custkey") % 70).cast("int").alias("row"), gas.alias("gas"), raw.alias("raw"))
    bunkers = o.select(y, (F.col("o_custkey") % 60).cast("int").alias("row"), raw.alias("raw"))
    vehicles = o.select(y, F.when(F.col("o_custkey") % 2 == 0, "buses").otherwise("heavy_duty_trucks").alias("vehicle"), gas.alias("gas"), raw.alias("raw"))
    return emissions.transport(cells, bunkers, vehicles)


def _transport_sql():
    r = ", ".join(f'sum(v * w) FILTER (WHERE o_custkey % 70 = {c}) AS "{n}"' for n, c in emissions.TRANSPORT_ROWS.items())
    b = ", ".join(f'sum(v) FILTER (WHERE o_custkey % 60 = {c}) AS "{n}"' for n, c in emissions.BUNKER_ROWS.items())
    return f"""WITH c AS (SELECT year(o_orderdate)::INTEGER AS year, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_orderkey % 1000)::DOUBLE END AS v,
      CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 25 ELSE 298 END AS w FROM orders)
      SELECT year, {r}, {b}, sum(v * w) FILTER (WHERE o_custkey % 2 = 1) AS "road_transporation.heavy_duty_trucks",
      sum(v * w) FILTER (WHERE o_custkey % 2 = 0) AS "road_transporation.buses" FROM c GROUP BY year"""


def _sheet(spark, d):
    """A sheet of 50 x 70 cells; a cell holds the sum of its orders."""
    o = table(spark, d, "orders")
    return o.groupBy((F.col("o_custkey") % 50).cast("int").alias("row"), (F.col("o_orderkey") % 70).cast("int").alias("col")).agg(
        F.sum("o_orderkey").cast("string").alias("raw"))


def projections(spark, d):
    """Six interpolated scenarios in one long table."""
    return emissions.projections(_sheet(spark, d))


def _projection_sql():
    blocks = ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in emissions.PROJECTION_BLOCKS.items())
    cols = ", ".join(f"sum(v) FILTER (WHERE row = {c}) AS {n}" for n, c in emissions.PROJECTION.items())
    return f"""WITH s AS (SELECT o_custkey % 50 AS row, o_orderkey % 70 AS col, sum(o_orderkey)::DOUBLE AS v FROM orders GROUP BY ALL),
      bl(scenario, a, b) AS (VALUES {blocks}), k AS (SELECT scenario, row - 23 AS row, 2020 + (col - a) * 5 AS x, v FROM s JOIN bl ON col >= a AND col < b AND row >= 23 AND row < 44),
      g AS (SELECT *, lead(x) OVER w AS x1, lead(v) OVER w AS v1 FROM k WINDOW w AS (PARTITION BY scenario, row ORDER BY x)),
      e AS (SELECT scenario, row, x, v AS v0, x1, v1, unnest(range(x, coalesce(x1, x + 1))) AS t FROM g),
      y AS (SELECT scenario, row, t::INTEGER AS year, CASE WHEN t = x THEN v0 ELSE v0 + (t - x) / (x1 - x) * (v1 - v0) END AS v FROM e)
      SELECT scenario, year, {cols}, sum(v) FILTER (WHERE row = 6) + sum(v) FILTER (WHERE row = 7) AS others FROM y WHERE row IN (19, 2, 3, 4, 8, 5, 9, 18, 10, 6, 7) GROUP BY scenario, year"""


def reduction_paths(spark, d):
    return emissions.paris(_sheet(spark, d))


QUERIES = {
    "historical_emissions": (historical_emissions, _wide_sql(emissions.HISTORICAL, {"others": emissions.HISTORICAL_OTHERS})),
    **{f"emissions_{n}": (_detail(n), _wide_sql(c)) for n, c in emissions.HISTORICAL_TABLES.items()},
    "transport_breakdown": (transport_breakdown, _transport_sql()),
    "projections": (projections, _projection_sql()),
    "reduction_paths": (reduction_paths, f"""WITH s AS (SELECT o_custkey % 50 AS row, o_orderkey % 70 AS col, sum(o_orderkey)::DOUBLE AS v FROM orders GROUP BY ALL)
      SELECT (2020 + row)::INTEGER AS year, {", ".join(f"sum(v) FILTER (WHERE col = {c}) AS {n}" for n, c in emissions.PARIS_COLUMNS.items())} FROM s
      WHERE row < 11 AND col IN (3, 4, 6, 8, 10) GROUP BY ALL"""),
}
