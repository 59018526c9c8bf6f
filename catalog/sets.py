"""Unions, differences and intersections."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.operators import quality, windows

from .inputs import OBS, daily, observations, table, window_sql


def union_of_parts(spark, d):
    """Old and new rows with different columns under one schema."""
    o = observations(spark, d)
    old = o.filter("year(day) < 1999").select("entity", "value", "qty")
    new = o.filter("year(day) >= 1999").select("qty", "entity", "disc")
    u = old.unionByName(new, allowMissingColumns=True)
    return u.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("values"), F.count("disc").alias("discs"), F.sum("qty").alias("qty"))


def two_way_difference(spark, d):
    """Keys on one side only, both ways."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).filter("k % 10 <> 0")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return (c.exceptAll(o).withColumn("side", F.lit("customer")).unionByName(o.exceptAll(c).withColumn("side", F.lit("order"))))


def key_intersection(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    b = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("k"))
    return a.intersect(b)


def tagged_windows(spark, d):
    """Several half-widths in one table, tagged by the half-width."""
    w = windows.window_years(daily(spark, d), ["entity"], "day", {"v_max": "avg"}, [3, 7, 15])
    return w.groupBy("half", "entity").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_rows").alias("samples"))


def expected_entities(spark, d):
    """Missing and unexpected entities between facts and configuration."""
    f = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("loc"))
    c = table(spark, d, "customer").filter("c_custkey % 9 <> 4").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("loc"))
    return quality.expected_entities(f, "orders", "loc", c, "loc").select("rule", "key")


QUERIES = {
    "union_of_parts": (union_of_parts, f"""WITH {OBS} SELECT entity, count(*) AS n, count(*) FILTER (WHERE year(day) < 1999) AS values,
      count(*) FILTER (WHERE year(day) >= 1999) AS discs, sum(qty) AS qty FROM obs GROUP BY entity"""),
    "two_way_difference": (two_way_difference, """SELECT c_custkey AS k, 'customer' AS side FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
      UNION ALL SELECT DISTINCT o_custkey, 'order' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)"""),
    "key_intersection": (key_intersection, "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25"),
    "tagged_windows": (tagged_windows, " UNION ALL ".join(f"""SELECT {h}::INTEGER AS half, entity, count(*) AS rows, sum(n)::BIGINT AS samples FROM (
      WITH {window_sql(h)} SELECT entity, target, wy, count(*) AS n FROM win GROUP BY ALL) GROUP BY entity""" for h in (3, 7, 15))),
    "expected_entities": (expected_entities, """SELECT 'missing_entity' AS rule, 'c' || c_custkey AS key FROM customer WHERE c_custkey % 9 <> 4 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
      UNION ALL SELECT DISTINCT 'unexpected_entity', 'c' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 4)"""),
}
