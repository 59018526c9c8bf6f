"""Season and month aggregates with completeness gates, ranks and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import categories as cat
from . import quantiles


def _complete(agg: DataFrame, scope: list[str], end: Column) -> DataFrame:
    """Periods whose last day is not after the last data day of their scope ([] is the whole table).

    A scope holds a few rows per year, so the window that finds its last day is small and needs no second pass.
    """
    if not scope:
        return agg.filter(end <= agg.agg(F.max("_max")).scalar())
    return agg.withColumn("_last", F.max("_max").over(Window.partitionBy(*scope))).filter(end <= F.col("_last"))


def season_aggregate(daily: DataFrame, entity: list[str], date: str, value: Column, name: str,
                     min_days: int = 30, last_per: list[str] | None = None) -> DataFrame:
    """One row per entity, season year ``y`` and season ``x`` (0 winter .. 3 autumn).

    December belongs to the next year's winter.  A season is kept when its last day is not after the last day of the
    data (``last_per`` names the columns whose last day counts; [] means the last day of the whole table) and at least
    ``min_days`` rows exist.  A winter whose December lies outside the data still counts when it has enough days.
    """
    scope = entity if last_per is None else last_per
    keyed = daily.withColumns({"x": cal.season_index(F.month(date)), "y": cal.season_year(date)})
    agg = (keyed.groupBy(*entity, "x", "y")
           .agg(value.alias(name), F.count(F.lit(1)).alias("n_days"), F.max(date).alias("_max")))
    return (_complete(agg, scope, cal.season_end("y", "x"))
            .filter(F.col("n_days") >= min_days)
            .withColumn("season", cal.season_name("x"))
            .select(*entity, "x", "y", "season", name, "n_days"))


def month_aggregate(daily: DataFrame, entity: list[str], date: str, value: Column, name: str,
                    min_days: int = 20, last_per: list[str] | None = None) -> DataFrame:
    """One row per entity, year ``y`` and month ``x`` (1..12) with the same completeness rule."""
    scope = entity if last_per is None else last_per
    agg = (daily.groupBy(*entity, F.month(date).alias("x"), F.year(date).alias("y"))
           .agg(value.alias(name), F.count(F.lit(1)).alias("n_days"), F.max(date).alias("_max")))
    return (_complete(agg, scope, cal.month_end("y", "x"))
            .filter(F.col("n_days") >= min_days)
            .withColumn("season", F.element_at(F.array(*[F.lit(m) for m in cal.MONTHS]), F.col("x")))
            .select(*entity, "x", "y", "season", name, "n_days"))


def rank_seasons(seasons: DataFrame, group: list[str], value: str, baseline: Column,
                 highest_first: bool = True) -> DataFrame:
    """Rank (ties share the best), total and strict percentile against the baseline years.

    One group holds one row per year, so its window is bounded by the calendar.
    """
    order = F.col(value).desc() if highest_first else F.col(value).asc()
    everything = Window.partitionBy(*group)
    ranked = seasons.withColumns({"rank": F.rank().over(Window.partitionBy(*group).orderBy(order)),
                                  "total": F.count(F.lit(1)).over(everything)})
    return quantiles.strict_percent_rank(ranked, group, value, "percentile", baseline)


def with_season_category(df: DataFrame) -> DataFrame:
    return (df.withColumn("cat", cat.season_category("percentile"))
            .withColumn("color", cat.season_color("cat")))


def heatmap_counters(df: DataFrame, group: list[str], year: str, hot: list[str], cold: list[str], very: list[str],
                     since: int, recent: int = 10) -> DataFrame:
    """Counts of extreme and cold cells, extreme cells since a year, and hot cells in the last years."""
    last = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    c = F.col("cat")
    marked = (df.groupBy(*group, year, "cat").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_recent", F.col(year) >= F.max(year).over(last) - (recent - 1)))

    def total(cond):
        return F.sum(F.when(cond, F.col("_n")).otherwise(0)).cast("bigint")

    out = marked.groupBy(*group) if group else marked.groupBy()
    return out.agg(total(c.isin(very)).alias("n_extreme"), total(c.isin(cold)).alias("n_cold"),
                   total(c.isin(very) & (F.col(year) >= since)).alias("n_extreme_since"),
                   total(c.isin(hot) & F.col("_recent")).alias("n_hot_recent"))
