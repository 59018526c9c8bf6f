"""Kernel density curves of calendar-bounded sample arrays.

The input is one row per group with its sample array (see ``windows.pooled_samples``); Spark spreads the groups.  The
kernel sum itself is a numpy expression over one row's samples and grid, run in Arrow batches: the same formula as
Column expressions would build samples x grid rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as num
from ..session import spread

POINTS = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("d", T.ArrayType(T.DoubleType()))])


def _add_curve(df: DataFrame, samples: str, name: str, body) -> DataFrame:
    @F.pandas_udf(POINTS)
    def curve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            made = [body(np.asarray(s, dtype=float)) for s in values]
            yield pd.DataFrame({"x": [m[0] for m in made], "d": [m[1] for m in made]})
    keys = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    even = spread(df, keys) if keys else df
    return (even.withColumn("_p", curve(F.col(samples)))
            .withColumn(name, F.arrays_zip(F.col("_p")["x"].alias("x"), F.col("_p")["d"].alias("d"))).drop("_p"))


def gaussian_points(s: np.ndarray, points: int = 200) -> tuple[np.ndarray, np.ndarray]:
    pad = max((s.max() - s.min()) * 0.05, 0.5)
    grid = (s.min() - pad) + np.arange(points) * ((s.max() - s.min() + 2 * pad) / (points - 1))
    h = s.std(ddof=1) * len(s) ** -0.2 if len(s) > 1 else 0.0
    if h <= 0:
        return grid, np.zeros(points)
    u = (grid[:, None] - s[None, :]) / h
    return grid, np.exp(-0.5 * u * u).sum(axis=1) / (len(s) * h * np.sqrt(2 * np.pi))


def _epanechnikov(grid: np.ndarray, s: np.ndarray, h: float) -> np.ndarray:
    u = (grid[:, None] - s[None, :]) / h
    return (0.75 * np.clip(1 - u * u, 0, None)).sum(axis=1) / (len(s) * h)


def epanechnikov_points(s: np.ndarray, points: int = 100) -> tuple[np.ndarray, np.ndarray]:
    pad = (s.max() - s.min()) * 0.1
    grid = s.min() - pad + np.arange(points) * ((s.max() - s.min() + 2 * pad) / (points - 1))
    h = 1.06 * s.std(ddof=1) * len(s) ** -0.2 if len(s) > 1 else 0.0
    return grid, (_epanechnikov(grid, s, h) if h > 0 else np.zeros(points))


def histogram_points(s: np.ndarray, step: float = 0.1, pad: float = 2.0,
                     bounds: tuple[float, float] = (0.2, 2.5)) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = s.min() - pad, s.max() + pad
    grid = lo + step * np.arange(int(np.floor((hi - lo) / step + 1e-9)) + 1)
    q25, q75 = np.percentile(s, [25, 75])
    iqr, n = q75 - q25, len(s)
    raw = 2 * iqr / np.cbrt(n) if iqr > 0 else 1.06 * s.std() / np.cbrt(n)
    d = _epanechnikov(grid, s, min(max(raw, bounds[0]), bounds[1]))
    area = d.sum() * step
    return grid, d * (n / area if area > 0 else 1.0)


def gaussian_curve(df: DataFrame, samples: str = "samples", name: str = "distribution", points: int = 200) -> DataFrame:
    """Gaussian kernel curve: bandwidth sd * n^(-1/5), grid padded by max(5 % of the range, 0.5)."""
    return _add_curve(df, samples, name, lambda s: gaussian_points(s, points))


def epanechnikov_curve(df: DataFrame, samples: str = "samples", name: str = "distribution",
                       points: int = 100) -> DataFrame:
    """Epanechnikov curve: bandwidth 1.06 sd n^(-1/5), grid padded by 10 % of the range."""
    return _add_curve(df, samples, name, lambda s: epanechnikov_points(s, points))


def histogram_curve(df: DataFrame, samples: str = "samples", name: str = "distribution", step: float = 0.1,
                    pad: float = 2.0, bounds: tuple[float, float] = (0.2, 2.5)) -> DataFrame:
    """Epanechnikov curve with bandwidth 2 IQR / n^(1/3) held inside ``bounds``, scaled to counts."""
    return _add_curve(df, samples, name, lambda s: histogram_points(s, step, pad, bounds))


def with_cutoffs(df: DataFrame, cuts: dict[str, float], samples: str = "samples") -> DataFrame:
    """Percentile columns and sample count of a sample array."""
    return df.withColumns({"n_samples": F.size(samples),
                           **{n: num.sorted_percentile(samples, p) for n, p in cuts.items()}})


def bin_counts(df: DataFrame, curve: str, n: str, name: str = "bins") -> DataFrame:
    """Expected days in every whole-degree bin a curve touches, as an array."""

    @F.pandas_udf("array<bigint>")
    def count(xs: pd.Series, ds: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for x, d, k in zip(xs, ds, sizes):
            at = np.arange(np.floor(x[0]), np.floor(x[-1]) + 1) + 0.5
            v = np.interp(at, x, d)
            v[(at <= x[0]) | (at >= x[-1])] = 0.0
            out.append(np.floor(v * k + 0.5).astype("int64"))
        return pd.Series(out)

    return df.withColumn(name, count(F.col(curve)["x"], F.col(curve)["d"], F.col(n).cast("double")))


def mixture(df: DataFrame, group: list[str], curve: str, points: int = 200, name: str = "distribution") -> DataFrame:
    """Unweighted mean of the curves of a group on the union of their ranges.

    Each curve is resampled on the group's common grid first and the densities are averaged per grid point, so a group
    of very many curves is summed on the map side.
    """
    usable = df.filter(F.size(curve) >= 2)
    ends = usable.groupBy(*group).agg(F.min(F.element_at(curve, 1)["x"]).alias("_lo"),
                                      F.max(F.element_at(curve, -1)["x"]).alias("_hi"))

    @F.pandas_udf("array<double>")
    def resample(xs: pd.Series, ds: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for x, d, a, b in zip(xs, ds, lo, hi):
            grid = a + (b - a) * np.arange(points) / (points - 1)
            vals = np.interp(grid, x, d)
            vals[(grid <= x[0]) | (grid >= x[-1])] = 0.0
            out.append(vals)
        return pd.Series(out)

    sampled = (usable.join(ends, group)
               .select(*group, "_lo", "_hi", F.posexplode(resample(F.col(curve)["x"], F.col(curve)["d"], "_lo", "_hi")).alias("_i", "_d")))
    mean = (sampled.groupBy(*group, "_i").agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
                                              F.avg("_d").alias("d"))
            .withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / (points - 1)))
    return mean.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("x", "d"))).alias(name))
