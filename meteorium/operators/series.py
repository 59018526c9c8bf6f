"""Reduction of raw observations to calendar-bounded series.

Raw observations may be skewed (one entity can hold a third of all rows).  Every operator that needs an order inside
an entity therefore starts from ``daily_rollup`` or a yearly aggregate.  Both combine on the map side, and their result
holds at most one row per entity and calendar day (or year), however many raw rows there are; that calendar bound is
what makes the later per-entity windows and arrays safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..session import materialize


def daily_rollup(df: DataFrame, entity: list[str], date: str, measures: dict[str, Column]) -> DataFrame:
    """One row per entity and calendar day; ``measures`` maps an output name to an aggregate."""
    return (df.withColumn("_day", F.to_date(date)).groupBy(*entity, "_day")
            .agg(*[c.alias(name) for name, c in measures.items()])
            .withColumnRenamed("_day", date))


def with_calendar(df: DataFrame, date: str) -> DataFrame:
    d = F.col(date)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)})


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row that arrived last per key.

    ``max_by`` combines on the map side, so a key with very many versions never meets in one task as a sorted group.
    """
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def latest_rows(df: DataFrame, entity: list[str], date: str, n: int, until: Column | None = None) -> DataFrame:
    """The last ``n`` rows per entity at or before ``until``, with their place counted from the newest.

    Filtering on ``row_number`` lets Spark keep only ``n`` candidates per entity and task before the shuffle.
    """
    if until is not None:
        df = df.filter(F.col(date) <= until)
    w = Window.partitionBy(*entity).orderBy(F.col(date).desc())
    return df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def interpolate_yearly(knots: DataFrame, group: list[str], x: str, values: list[str]) -> DataFrame:
    """Linear interpolation between knots for every integer x inside each group's span.

    Each knot row carries the next knot (``lead``) and expands to the integers of its own segment, so no row is
    compared with more than one neighbour.
    """
    w = Window.partitionBy(*group).orderBy(x)
    seg = knots.withColumn("_x1", F.lead(x).over(w))
    for v in values:
        seg = seg.withColumn(f"_n_{v}", F.lead(v).over(w))
    last = F.coalesce(F.col("_x1") - 1, F.col(x))
    grid = seg.withColumn("_x", F.explode(F.sequence(F.col(x), last)))
    share = (F.col("_x") - F.col(x)) / (F.col("_x1") - F.col(x))
    out = [F.when(F.col("_x") == F.col(x), F.col(v))
           .otherwise(F.col(v) + share * (F.col(f"_n_{v}") - F.col(v))).alias(v) for v in values]
    return grid.select(*group, F.col("_x").alias(x), *out)


def lookup_piecewise(requests: DataFrame, knots: DataFrame, group: list[str], x: str, at: str, values: dict[str, str]) -> DataFrame:
    """Piecewise-linear values at ``at`` with constant ends; ``values`` maps an output name to a knot column.

    Requests are placed among the knots: both are sorted together by group and place, cut into ranges whatever the group, and each
    different place takes the last knot at or before it and the first one after it, inside its range or from the nearest range that
    has one.  So neither a group of very many knots nor one of very many requests comes together, and one pass serves all values.
    A request without a place, or whose group has no knots, gets nulls; of several knots at one place the last by value counts.
    """
    ys = list(dict.fromkeys(values.values()))
    pos = F.col(at).cast("double")
    knot = F.struct(F.col(x).cast("double").alias("x"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(ys)])
    known = knots.filter(F.col(x).isNotNull()).select(*group, F.col(x).cast("double").alias("_pos"), knot.alias("_knot"))
    asked = requests.filter(pos.isNotNull()).select(*group, pos.alias("_pos")).distinct()
    rows = known.unionByName(asked, allowMissingColumns=True).withColumn("_asked", F.col("_knot").isNull())
    order = [*group, "_pos", "_asked", "_knot"]
    placed = materialize(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falling = [F.col(c).desc() for c in ("_pos", "_asked", "_knot")]
    near = placed.withColumns({"_before": F.last("_knot", ignorenulls=True).over(inside.orderBy("_pos", "_asked", "_knot")),
                               "_after": F.last(F.when(~F.col("_asked"), F.col("_knot")), ignorenulls=True).over(inside.orderBy(*falling))}).filter("_asked")
    # the last knot of earlier ranges and the first one of later ranges, by range and group: a table of few rows
    ends = placed.groupBy("_range", *group).agg(F.min("_knot").alias("_first"), F.max("_knot").alias("_last"))
    over = Window.partitionBy(*group)
    ends = ends.withColumns({"_earlier": F.last("_last", ignorenulls=True).over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                             "_later": F.last("_first", ignorenulls=True).over(over.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1))})
    found = near.join(ends.select("_range", *group, "_earlier", "_later"), ["_range", *group])
    a, b = F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later")
    share = (F.col("_pos") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))

    def value(y: str) -> Column:
        return F.when(F.col("_a").isNull(), F.col(f"_b.{y}")).when(F.col("_b").isNull() | (F.col("_a.x") == F.col("_pos")), F.col(f"_a.{y}")).otherwise(
            F.col(f"_a.{y}") + share * (F.col(f"_b.{y}") - F.col(f"_a.{y}")))
    answers = found.select(*group, "_pos", a.alias("_a"), b.alias("_b")).select(*group, "_pos", *[value(f"y{ys.index(c)}").alias(n) for n, c in values.items()])
    return requests.withColumn("_pos", pos).join(answers, [*group, "_pos"], "left").select(*requests.columns, *values)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows in a total order with their place in it, from 1.

    Rows are sorted range by range; each range counts its rows on its own, and the counts of the ranges before it are added.
    """
    ranged = materialize(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before)
    inside = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(offsets.select("_range", "_before"), "_range").withColumn(name, F.col("_before") + F.col("_i")).drop("_range", "_before", "_i").orderBy(name)


def date_gaps(df: DataFrame, entity: list[str], date: str) -> DataFrame:
    """Missing stretches: the day before and after each gap and the number of days missing between them."""
    days = df.select(*entity, F.to_date(date).alias(date)).distinct()
    w = Window.partitionBy(*entity).orderBy(date)
    return (days.withColumn("previous", F.lag(date).over(w))
            .withColumn("missing", F.datediff(date, "previous") - 1).filter("missing > 0"))


def continuity(df: DataFrame, entity: list[str], date: str) -> DataFrame:
    """Rows, distinct days, duplicates and missing days per entity."""
    per_day = df.groupBy(*entity, F.to_date(date).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return (per_day.groupBy(*entity)
            .agg(F.sum("_n").alias("n_rows"), F.count("_d").alias("n_days"),
                 F.min("_d").alias("first_day"), F.max("_d").alias("last_day"))
            .withColumn("duplicates", F.col("n_rows") - F.col("n_days"))
            .withColumn("missing", (F.datediff("last_day", "first_day") + 1 - F.col("n_days")).cast("bigint")))


def order_inversions(df: DataFrame, entity: list[str], sequence: str, date: str, block: int = 65536) -> DataFrame:
    """Places where the date falls below the date before it in arrival order.

    The rows of a hot entity are cut into blocks of the arrival number.  ``lag`` runs inside a block; the first row of
    each block is compared with the last row of the block before it through a table of one row per block.
    """
    cut = df.withColumn("_block", F.floor(F.col(sequence) / block))
    w = Window.partitionBy(*entity, "_block").orderBy(sequence)
    inner = (cut.withColumn("_before", F.lag(date).over(w)).filter(F.col(date) < F.col("_before"))
             .select(*entity, sequence, date))
    ends = cut.groupBy(*entity, "_block").agg(
        F.min(F.struct(sequence, date)).alias("_first"), F.max(F.struct(sequence, date)).alias("_last"))
    over = Window.partitionBy(*entity).orderBy("_block")
    edge = (ends.withColumn("_prev", F.lag("_last").over(over))
            .filter(F.col("_first")[date] < F.col("_prev")[date])
            .select(*entity, F.col("_first")[sequence].alias(sequence), F.col("_first")[date].alias(date)))
    return inner.unionByName(edge)


def bigint_where_it_fits(df: DataFrame, column: str) -> DataFrame:
    """A whole decimal column as bigint, or as it is where a value passes 64 bits.  The rows are written first, to look at them."""
    written = materialize(df)
    low, high = written.agg(F.min(column), F.max(column)).first()
    fits = low is None or (-(1 << 63) <= low and high < 1 << 63)
    return written.withColumn(column, F.col(column).cast("bigint")) if fits else written


def local_daily_range(df: DataFrame, start: str, end: str, interval: str, offset: str, date: str) -> DataFrame:
    """One row per local calendar date of each request."""
    return df.withColumn(date, F.explode(cal.local_dates(start, end, interval, offset)))
