"""Trends of yearly series: Theil-Sen line with interval, Mann-Kendall, Yue-Wang correction, least squares.

A series is one row per group with arrays of years and values.  It holds one value per calendar year, so its length is
bounded by the calendar; the pairwise slopes are formed in numpy inside that one row and never become Spark rows.
Groups are spread over tasks by the aggregation that built the series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import categories as cat
from ..functions import numeric as num
from ..session import spread

Z_95 = 1.959963984540054

FIT_COLUMNS = ["x_min", "x_max", "slope", "intercept", "slope_lo", "slope_hi", "intercept_lo", "intercept_hi", "s", "var_s",
               "tau", "correction"]
FIT = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in FIT_COLUMNS]])


def yearly_series(df: DataFrame, group: list[str], year: str, value: str) -> DataFrame:
    """Arrays ``xs`` and ``ys`` ascending in year; the input holds one row per group and year."""
    # collecting reduces nothing on the map side, so the rows are sent to their group's task directly
    packed = (spread(df.filter(F.col(value).isNotNull()), group).groupBy(*group)
              .agg(F.sort_array(F.collect_list(F.struct(F.col(year).cast("double").alias("x"),
                                                        F.col(value).cast("double").alias("y")))).alias("_s")))
    return packed.select(*group, F.transform("_s", lambda p: p["x"]).alias("xs"),
                         F.transform("_s", lambda p: p["y"]).alias("ys"))


def _tie_term(v: np.ndarray) -> np.ndarray:
    """Sum of t(t-1)(2t+5) over the ties of each row."""
    s = np.sort(v, axis=1)
    n = s.shape[1]
    out = np.zeros(len(s))
    same = s[:, 1:] == s[:, :-1]
    for row in np.nonzero(same.any(axis=1))[0]:
        _, t = np.unique(s[row], return_counts=True)
        out[row] = (t * (t - 1.0) * (2 * t + 5)).sum()
    return out if n > 1 else np.zeros(len(s))


def _fit_block(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Fits of several series of equal length; rows are series."""
    m, n = y.shape
    i, j = np.triu_indices(n, 1)
    dy = y[:, j] - y[:, i]
    dx = x[:, j] - x[:, i]
    slopes = dy / dx
    pairs = slopes.shape[1]

    def median(v):
        k = v.shape[1]
        return np.median(v, axis=1) if k else np.full(m, np.nan)

    x_med, y_med = median(x), median(y)
    base = n * (n - 1.0) * (2 * n + 5)
    ties = _tie_term(y)
    var_s = (base - ties) / 18
    sigma = np.sqrt(var_s)
    upper = np.minimum(np.round((pairs + Z_95 * sigma) / 2).astype(int), pairs - 1)
    lower = np.maximum(np.round((pairs - Z_95 * sigma) / 2).astype(int) - 1, 0)
    rows = np.arange(m)
    # only the order statistics that are read are put in place
    mid = [(pairs - 1) // 2, pairs // 2]
    ordered = np.partition(slopes, np.unique(np.concatenate([mid, lower, upper])), axis=1)
    slope = (ordered[:, mid[0]] + ordered[:, mid[1]]) / 2
    hi, lo = ordered[rows, upper], ordered[rows, lower]
    s = np.sign(dy).sum(axis=1)
    gap_free = bool(np.all(x[:, -1] - x[:, 0] == n - 1))  # then the place in the series is the year
    step = slope if gap_free else median(dy / (j - i))
    d = y - step[:, None] * np.arange(1, n + 1)
    d = d - d.mean(axis=1, keepdims=True)
    power = (d * d).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((1 - (j - i) / n) * d[:, i] * d[:, j]).sum(axis=1)
        correction = np.where(power > 0, 1 + 2 * cross / power, np.nan)
    return {"n": np.full(m, n), "x_min": x[:, 0], "x_max": x[:, -1], "slope": slope,
            "intercept": y_med - slope * x_med, "slope_lo": lo, "slope_hi": hi,
            "intercept_lo": y_med - lo * x_med, "intercept_hi": y_med - hi * x_med, "s": s, "var_s": var_s,
            "tau": s / (n * (n - 1) / 2), "correction": correction}


@F.pandas_udf(FIT)
def _robust_fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    columns = ["n", *FIT_COLUMNS]
    for xs, ys in batches:
        out = pd.DataFrame(np.nan, index=range(len(xs)), columns=columns)
        lengths = np.array([len(v) for v in xs])
        for n in np.unique(lengths):
            if n < 2:
                continue
            rows = np.nonzero(lengths == n)[0]
            size = max(1, 4_000_000 // (n * n))
            for k in range(0, len(rows), size):
                part = rows[k:k + size]
                fit = _fit_block(np.stack([np.asarray(xs.iloc[r], float) for r in part]),
                                 np.stack([np.asarray(ys.iloc[r], float) for r in part]))
                for c in columns:
                    out.loc[part, c] = fit[c]
        out["n"] = lengths
        yield out.astype({"n": "int32"})


def _score(s: Column, variance: Column) -> Column:
    shifted = F.when(s > 0, s - 1).when(s < 0, s + 1).otherwise(F.lit(0.0))
    return F.when(variance > 0, shifted / F.sqrt(variance))


def robust_trend(series: DataFrame, min_points: int = 10, drop_short: bool = True) -> DataFrame:
    """Add line, interval, Mann-Kendall (``z_mk``, ``p_mk``) and Yue-Wang (``z_yw``, ``p_yw``) columns.

    Groups with fewer points are dropped, or kept with null columns.  A corrected variance that is not positive gives a
    null score.
    """
    enough = F.size("xs") >= max(min_points, 2)
    rows = series.filter(enough) if drop_short else series
    fit = rows.withColumn("_f", _robust_fit("xs", "ys"))
    wide = fit.select(*series.columns, F.col("_f")["n"].alias("n"),
                      *[F.when(enough, F.nanvl(F.col("_f")[c], F.lit(None))).alias(c) for c in FIT_COLUMNS])
    wide = wide.withColumns({"z_mk": _score(F.col("s"), F.col("var_s")),
                             "z_yw": _score(F.col("s"), F.col("var_s") * F.col("correction"))})
    wide = wide.withColumns({"p_mk": num.two_sided_p("z_mk"), "p_yw": num.two_sided_p("z_yw")})
    return wide.withColumn("verdict", F.when(enough, cat.trend_verdict("z_mk", "p_mk")))


def least_squares(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group by map-side sums; equal x values give slope 0 through the mean."""
    agg = df.groupBy(*group) if group else df.groupBy()
    out = agg.agg(F.count(y).alias("n"), F.regr_slope(y, x).alias("_b"), F.avg(y).alias("_ym"), F.avg(x).alias("_xm"),
                  F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    slope = F.coalesce("_b", F.lit(0.0))
    return out.select(*group, "n", slope.alias("slope"), (F.col("_ym") - slope * F.col("_xm")).alias("intercept"),
                      (slope * 100).alias("per_century"), "x_min", "x_max")
