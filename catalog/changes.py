"""Fingerprints, manifests and row diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteorium.operators import change

from .inputs import table


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _changed(spark, d):
    o = _orders(spark, d)
    return o.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 1000 == 1, F.lit("X")).otherwise(F.col("o_orderstatus")),
                          "o_custkey": F.when(F.col("o_orderkey") % 777 == 5, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))})


def fingerprints(spark, d):
    return change.fingerprints(_orders(spark, d), "orders", ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


def manifest_states(spark, d):
    """Manifest of the changed table against the old one: gated, informational, missing and unknown columns."""
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    old = change.fingerprints(_orders(spark, d), "orders", ["o_orderkey"], [*cols, "o_orderkey"])
    new = change.fingerprints(_changed(spark, d).withColumn("extra", F.lit(1)), "orders", ["o_orderkey"], [*cols, "extra"])
    return change.compare_manifests(new, old, [("orders", "o_custkey")]).select("table", "column", "status")


def row_differences(spark, d):
    cur = _changed(spark, d).filter("o_orderkey % 1500 <> 7")
    return change.row_diff(cur, _orders(spark, d), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


def first_differences(spark, d):
    """Three differing rows per column in key order and the column's total."""
    diff = change.row_diff(_changed(spark, d), _orders(spark, d), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])
    return change.first_diffs(diff, ["o_orderkey"], 3).select("column", "o_orderkey", "current", "reference", "place", "differing")


CELL = """('0x' || substr(sha256(o_orderkey::VARCHAR || chr(31) || {c}::VARCHAR), 1, 15))::BIGINT::HUGEINT"""
CHANGED = """WITH ch AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 1000 = 1 THEN 'X' ELSE o_orderstatus END AS s2,
  CASE WHEN o_orderkey % 777 = 5 THEN o_custkey + 1 ELSE o_custkey END AS c2 FROM orders),
 df AS (SELECT o_orderkey, 'o_orderstatus' AS "column", s2 AS "current", o_orderstatus AS reference FROM ch WHERE s2 <> o_orderstatus
   UNION ALL SELECT o_orderkey, 'o_custkey', c2::VARCHAR, o_custkey::VARCHAR FROM ch WHERE c2 <> o_custkey)"""
QUERIES = {
    "fingerprints": (fingerprints, " UNION ALL ".join(f"""SELECT 'orders' AS "table", '{c}' AS "column", count(*) AS n_rows, sum({CELL.replace("{c}", c)})::VARCHAR AS hash FROM orders"""
                                                      for c in ("o_custkey", "o_orderstatus", "o_orderpriority"))),
    "manifest_states": (manifest_states, CHANGED + ", nw AS (SELECT o_orderkey, s2 AS o_orderstatus, c2 AS o_custkey, o_orderpriority, 1 AS extra FROM ch JOIN orders USING (o_orderkey)), a AS ("
      + " UNION ALL ".join(f"SELECT '{c}' AS c, sum({CELL.replace('{c}', c)}) AS h FROM nw" for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "extra")) + "), e AS ("
      + " UNION ALL ".join(f"SELECT '{c}' AS c, sum({CELL.replace('{c}', c)}) AS h FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey"))
      + """) SELECT 'orders' AS "table", c AS "column", CASE WHEN e.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'unknown' WHEN a.h = e.h THEN 'ok' WHEN c = 'o_custkey' THEN 'informational' ELSE 'moved' END AS status
      FROM a FULL JOIN e USING (c)"""),
    "row_differences": (row_differences, CHANGED + """ SELECT * FROM df WHERE o_orderkey % 1500 <> 7
      UNION ALL SELECT o_orderkey, '<row>', NULL, 'present' FROM orders WHERE o_orderkey % 1500 = 7"""),
    "first_differences": (first_differences, CHANGED + """ SELECT "column", o_orderkey, "current", reference, row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey)::INTEGER AS place,
      count(*) OVER (PARTITION BY "column") AS differing FROM df QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey) <= 3"""),
}
