"""Climate-shaped views of the given tables.

``observations`` reads lineitem as station rows: the return flag is the entity, the ship date the day, and the price the
measured value.  Prices are turned into whole cents over a power of two, so sums do not depend on their order and the
Spark result equals the SQL result to the last bit wherever only sums and counts are involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meteorium.operators import series

CENTS = 131072.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def level(c: str | Column) -> Column:
    """Money as a temperature-like level."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 100) / CENTS


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("entity"), F.to_date("l_shipdate").alias("day"), level("l_extendedprice").alias("value"),
        F.col("l_quantity").alias("qty"), F.round(F.col("l_discount") * 100).alias("disc"), "l_suppkey", "l_orderkey",
        "l_linenumber", "l_partkey")


OBS = f"""obs AS (SELECT l_returnflag AS entity, CAST(l_shipdate AS DATE) AS day, round(l_extendedprice * 100) / {CENTS} AS value,
  l_quantity AS qty, round(l_discount * 100) AS disc, l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)"""


def daily(spark: SparkSession, folder: str, entity: list[str] | None = None) -> DataFrame:
    return series.daily_rollup(observations(spark, folder), entity or ["entity"], "day", {
        "v_mean": F.avg("value"), "v_max": F.max("value"), "v_min": F.min("value"),
        "wet": F.sum("qty") / 64, "dry": F.sum("disc") / 16})


DAILY = OBS + """, daily AS (SELECT entity, day, avg(value) AS v_mean, max(value) AS v_max, min(value) AS v_min,
  sum(qty) / 64 AS wet, sum(disc) / 16 AS dry FROM obs GROUP BY entity, day)"""


def priority_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a second network: priority, day, level."""
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("day"),
                                              level("o_totalprice").alias("value"))
    return series.daily_rollup(o, ["entity"], "day", {"v_mean": F.avg("value"), "v_max": F.max("value"), "v_sum": F.sum("value")})


PRIORITY = f"""ord AS (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS day, round(o_totalprice * 100) / {CENTS} AS value
  FROM orders), pdaily AS (SELECT entity, day, avg(value) AS v_mean, max(value) AS v_max, sum(value) AS v_sum FROM ord GROUP BY entity, day)"""

# Days before each month on a 365-day calendar, and the slot of a date, as SQL.
SLOT = """(list_value(0,31,59,90,120,151,181,212,243,273,304,334)[month({d})]
  + CASE WHEN month({d}) = 2 AND day({d}) = 29 THEN 28 ELSE day({d}) END)"""


def slot_sql(d: str) -> str:
    return SLOT.replace("{d}", d)


def day_text(c: str | Column) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


WINDOW_JOIN = """targets AS (SELECT unnest(range(1, 366)) AS target),
 placed AS (SELECT *, {slot} AS slot, year(day) AS yr FROM daily),
 win AS (SELECT p.*, t.target, p.yr + CASE WHEN p.slot - t.target > 182 THEN 1 WHEN p.slot - t.target < -182 THEN -1 ELSE 0 END AS wy
   FROM placed p JOIN targets t ON abs(((p.slot - t.target + 182 + 365) % 365) - 182) <= {half})"""


def window_sql(half: int, base: str = DAILY) -> str:
    return base + ", " + WINDOW_JOIN.replace("{slot}", slot_sql("day")).replace("{half}", str(half))
