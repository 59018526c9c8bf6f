"""Long cell tables: running means, anomalies, masks, regridding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def centred_mean(df: DataFrame, group: list[str], order: str, value: str, name: str, size: int = 10) -> DataFrame:
    """Centred moving mean with at least one value; an even window reaches one row further back than ahead."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-(size // 2), (size - 1) // 2)
    return df.withColumn(name, F.avg(value).over(w))


def decade_samples(df: DataFrame, group: list[str], order: str, first_year: int, step: int = 10,
                   start: int = 6) -> DataFrame:
    """Every ``step``-th row from index ``start``, labelled with the years it is published under."""
    idx = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    return (df.withColumn("_i", idx).filter((F.col("_i") >= start) & (F.pmod(F.col("_i") - start, F.lit(step)) == 0))
            .withColumns({"year_start": (F.lit(first_year) + F.col("_i") - start).cast("int"),
                          "year_end": (F.lit(first_year) + F.col("_i") - start + step - 1).cast("int")}).drop("_i"))


def complete_running_mean(df: DataFrame, group: list[str], order: str, value: str, name: str,
                          size: int = 10) -> DataFrame:
    """Moving mean over complete windows only, on the row that ends the window."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-(size - 1), 0)
    return (df.withColumns({name: F.avg(value).over(w), "_n": F.count(F.lit(1)).over(w)})
            .filter(F.col("_n") == size).drop("_n"))


def reference_means(df: DataFrame, group: list[str], year: str, value: str,
                    periods: dict[str, tuple[int, int]]) -> DataFrame:
    """Means over several year ranges per group, in one pass."""
    out = df.groupBy(*group) if group else df.groupBy()
    return out.agg(*[F.avg(F.when(F.col(year).between(*p), F.col(value))).alias(n) for n, p in periods.items()])


def running_anomalies(df: DataFrame, group: list[str], year: str, value: str, periods: dict[str, tuple[int, int]],
                      size: int = 10) -> DataFrame:
    """Complete running mean and its difference to each reference mean, per group."""
    whole = Window.partitionBy(*group)
    marked = df
    for n, p in periods.items():
        marked = marked.withColumn(f"_r_{n}", F.avg(F.when(F.col(year).between(*p), F.col(value))).over(whole))
    run = complete_running_mean(marked, group, year, value, "running", size)
    return run.select(*group, year, "running", *[(F.col("running") - F.col(f"_r_{n}")).alias(n) for n in periods])


def flip_rows(df: DataFrame, group: list[str], y: str) -> DataFrame:
    """Vertical flip: the last row becomes row 0."""
    if not group:
        return df.withColumn(y, df.agg(F.max(y)).scalar() - F.col(y))
    joined = df.join(df.groupBy(*group).agg(F.max(y).alias("_h")), group)
    return joined.withColumn(y, F.col("_h") - F.col(y)).drop("_h")


def mask_below(df: DataFrame, value: str, bound: float = -1000.0) -> DataFrame:
    """Drop no-data cells."""
    return df.filter(F.col(value) >= bound)


def close_longitude(df: DataFrame, lon: str, full: float = 360.0) -> DataFrame:
    """Repeat the cells at 0 degrees at 360 degrees (at ``full`` in other units)."""
    return df.withColumn(lon, F.explode(F.when(F.col(lon) == 0, F.array(F.lit(0.0), F.lit(full)))
                                        .otherwise(F.array(F.col(lon).cast("double")))))


def regrid_bilinear(df: DataFrame, group: list[str], x: str, y: str, value: str, factor: int) -> DataFrame:
    """Refine a unit grid by a whole factor with bilinear weights.

    Every source cell sends its weighted value to the fine points it touches, so the result is one aggregation on
    the fine cell key; there is no join and no grid in memory.  Fine points outside the source grid are dropped
    because their weights do not add up to 1.
    """
    reach = F.array(*[F.lit(k) for k in range(-factor + 1, factor)])
    spread = (df.withColumn("_dx", F.explode(reach)).withColumn("_dy", F.explode(reach))
              .withColumn("_w", (1 - F.abs("_dx") / factor) * (1 - F.abs("_dy") / factor)))
    return (spread.groupBy(*group, (F.col(x) * factor + F.col("_dx")).alias("fx"),
                           (F.col(y) * factor + F.col("_dy")).alias("fy"))
            .agg(F.sum("_w").alias("_weight"), F.sum(F.col("_w") * F.col(value)).alias(value))
            .filter(F.abs(F.col("_weight") - 1) < 1e-9).drop("_weight"))


def second_derivatives(y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of not-a-knot splines through the columns of ``y`` (four rows or more).

    On an even grid the end conditions make the second and the last but one derivative known at once; those between
    solve a system of ones beside fours, whose elimination factors depend on the number of knots only.
    """
    n = len(y)
    bend = np.zeros_like(y)
    bend[1:-1] = 6 * (y[2:] - 2 * y[1:-1] + y[:-2])
    m = np.zeros_like(y)
    m[1], m[-2] = bend[1] / 6, bend[-2] / 6
    factors = np.zeros(n)
    for k in range(2, n - 2):
        factors[k] = 1 / (4 - (factors[k - 1] if k > 2 else 0))
        m[k] = (bend[k] - m[k - 1]) * factors[k]
    for k in range(n - 3, 1, -1):
        m[k] -= factors[k] * m[k + 1]
    m[0], m[-1] = 2 * m[1] - m[2], 2 * m[-2] - m[-3]
    return m


def not_a_knot_spline(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolating cubic splines (not-a-knot ends) through the columns of ``y`` at 0, 1, 2, ... evaluated at ``at``."""
    n, y = len(y), np.asarray(y, dtype=float)
    if n < 4:
        coef = np.polynomial.polynomial.polyfit(np.arange(n), y, n - 1)
        return np.polynomial.polynomial.polyval(at, coef).T if y.ndim > 1 else np.polynomial.polynomial.polyval(at, coef)
    second = second_derivatives(y)
    i = np.clip(np.floor(at).astype(int), 0, n - 2)
    t = (at - i).reshape(-1, *([1] * (y.ndim - 1)))
    return (y[i] * (1 - t) + y[i + 1] * t
            - t * (1 - t) / 6 * ((2 - t) * second[i] + (1 + t) * second[i + 1]))


def _spline_axis(df: DataFrame, keep: list[str], along: str, value: str, factor: int, out: str) -> DataFrame:
    """Cubic spline along one axis, one row per line of cells."""
    lines = df.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct(along, value))).alias("_l"))

    @F.pandas_udf("array<double>")
    def refine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            fine: list = [None] * len(values)
            sizes = np.array([len(v) for v in values])
            for n in np.unique(sizes):  # lines of a length are solved side by side
                rows = np.flatnonzero(sizes == n)
                made = not_a_knot_spline(np.stack([values.iloc[r] for r in rows], axis=1), np.arange((n - 1) * factor + 1) / factor)
                for r, column in zip(rows, made.T):
                    fine[r] = column
            yield pd.Series(fine)

    whole = F.element_at("_l", -1)[along] - F.element_at("_l", 1)[along] == F.size("_l") - 1
    whole = whole & ~F.exists("_l", lambda c: c[value].isNull())
    lines = lines.withColumn("_l", F.when(whole, F.col("_l")).otherwise(F.raise_error(F.lit(f"incomplete grid line along {along}"))))
    fine = lines.withColumn("_first", F.element_at("_l", 1)[along]).withColumn(
        "_v", refine(F.transform("_l", lambda c: c[value])))
    return (fine.select(*keep, "_first", F.posexplode("_v").alias("_p", value))
            .select(*keep, (F.col("_first") * factor + F.col("_p")).alias(out), value))


def regrid_bicubic(df: DataFrame, group: list[str], x: str, y: str, value: str, factor: int) -> DataFrame:
    """Refine a complete grid with an interpolating bicubic spline.

    The spline is a product of two one-axis splines, so rows are refined first and columns second; a task holds single
    lines of cells, never a whole slice.
    """
    rows = _spline_axis(df, [*group, y], x, value, factor, "fx")
    return _spline_axis(rows, [*group, "fx"], y, value, factor, "fy")


def map_variables(wide: DataFrame, key: list[str], variables: list[str], wanted: list[str], year: str, value: int) -> DataFrame:
    """The wanted variables of a wide map for one period, as long cells; the period is filtered before anything is unfolded."""
    return wide.filter(F.col(year) == value).unpivot([*key, year], [v for v in variables if v in wanted], "variable", "value")


def cells_from_rows(df: DataFrame, key: list[str], array: str, value: str = "value", x: str = "x") -> DataFrame:
    """Array rows to long cells."""
    return df.select(*key, F.posexplode(array).alias(x, value))
