"""Circular day-of-year windows.

``window_years`` and ``pooled_samples`` are the two forms the derived tables need.  A window of +-h days around a slot
would multiply the rows by 2h+1 if each observation were sent to every target slot (144 copies for half-widths 3, 7,
15 and 45 together).  Here each entity's days are laid on one line of 365 steps per year and the windows are sliding
frames over it: one shuffle of the unmultiplied daily table serves all half-widths and all measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal


def _fill(df: DataFrame, entity: list[str], at: str, line, first: Column, last: Column, values: list[str]) -> DataFrame:
    """Insert the missing integer positions of each entity between ``first`` and ``last``, with null values.

    Every row stretches to the position before the next row (the first and last one also to the ends), so the gaps are
    filled without building a second table of positions and joining it.
    """
    before, after = F.lag(at).over(line), F.lead(at).over(line)
    begin = F.when(before.isNull(), first).otherwise(F.col(at))
    end = F.when(after.isNull(), last).otherwise(after - 1)
    spread = df.withColumns({"_begin": begin, "_end": end}).withColumn("_at", F.explode(F.sequence("_begin", "_end")))
    return spread.select(*entity, F.col("_at").alias(at), *[F.when(F.col("_at") == F.col(at), F.col(v)).alias(v) for v in values])


def window_years(daily: DataFrame, entity: list[str], date: str, measures: dict[str, str],
                 halves: list[int]) -> DataFrame:
    """Mean or sum of each measure per (entity, half-width, slot, window year).

    ``measures`` maps a column to ``"avg"`` or ``"sum"``.  Output: entity, half, slot, window_year, n_rows and the
    measures.  A mean over no values is null; a sum over rows without values is 0.
    """
    if max(halves) > 182:
        raise ValueError("half-width must not exceed 182")
    names = list(measures)
    per = (daily.withColumn("_a", cal.position(date)).groupBy(*entity, "_a")
           .agg(F.count(F.lit(1)).alias("_n"),
                *[F.sum(F.col(m).cast("double")).alias(f"_s_{m}") for m in names],
                *[F.count(m).alias(f"_c_{m}") for m in names]))
    reach = max(halves)
    line = Window.partitionBy(*entity).orderBy("_a")
    sums = [c for c in per.columns if c not in (*entity, "_a")]
    dense = _fill(per, entity, "_a", line, F.col("_a") - reach, F.col("_a") + reach, sums)
    blocks = []
    for h in halves:
        w = line.rowsBetween(-h, h)
        cells = [F.lit(h).alias("half"), F.sum("_n").over(w).alias("n_rows")]
        for m in names:
            total, count = F.sum(f"_s_{m}").over(w), F.sum(f"_c_{m}").over(w)
            value = F.coalesce(total, F.lit(0.0)) if measures[m] == "sum" else F.when(count > 0, total / count)
            cells.append(value.alias(m))
        blocks.append(F.struct(*cells))
    wide = dense.select(*entity, "_a", *[b.alias(f"_w{i}") for i, b in enumerate(blocks)])
    long = wide.select(*entity, "_a", F.explode(F.array(*[f"_w{i}" for i in range(len(blocks))])).alias("_w"))
    return (long.filter(F.col("_w")["n_rows"] > 0)
            .select(*entity, F.col("_w")["half"].alias("half"), cal.position_slot("_a").alias("slot"),
                    cal.position_year("_a").alias("window_year"), F.col("_w")["n_rows"].alias("n_rows"),
                    *[F.col("_w")[m].alias(m) for m in names]))


def pooled_samples(daily: DataFrame, entity: list[str], date: str, value: str, half: int) -> DataFrame:
    """Ascending array of all daily values within the window of each (entity, slot), all years pooled.

    Values are first gathered per slot (one per year), then the neighbours' arrays are joined by a circular frame.  The
    array length is bounded by (2 * half + 1) * years because ``daily`` holds one row per entity and day.
    """
    per = daily.groupBy(*entity, cal.slot(date).alias("slot")).agg(F.collect_list(value).alias("_v"))
    line = Window.partitionBy(*entity).orderBy("slot")
    full = _fill(per, entity, "slot", line, F.lit(1), F.lit(cal.SLOTS), ["_v"]).withColumn(
        "_v", F.coalesce("_v", F.array().cast("array<double>")))
    shifts = F.array(F.lit(0), F.when(F.col("slot") <= half, 365), F.when(F.col("slot") > 365 - half, -365))
    ring = (full.withColumn("_k", F.explode(F.filter(shifts, lambda k: k.isNotNull())))
            .withColumn("_p", F.col("slot") + F.col("_k")))
    w = Window.partitionBy(*entity).orderBy("_p").rangeBetween(-half, half)
    return (ring.withColumn("samples", F.sort_array(F.flatten(F.collect_list("_v").over(w))))
            .filter("_k = 0").select(*entity, "slot", "samples").filter(F.size("samples") > 0))


def rows_in_window(df: DataFrame, date: str, center: str, days: int) -> DataFrame:
    """Rows whose month and day lie in the wrapped window around ``MM-dd``; 29 February is left out."""
    return df.filter(cal.month_day(date).isin(cal.month_day_window(center, days)))
