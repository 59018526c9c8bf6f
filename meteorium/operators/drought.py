"""Standardised drought index: log-logistic fit of water balances mapped to the standard normal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as num
from ..session import spread

FIT = T.StructType([T.StructField("shape", T.DoubleType()), T.StructField("scale", T.DoubleType())])


def fit_log_logistic(x: np.ndarray, max_iter: int = 200) -> tuple[float, float] | None:
    """Maximum-likelihood shape and scale of a log-logistic with location 0; None when it does not converge.

    With u = ln x the likelihood is logistic and concave in (c, a) where z = c u - a, so Newton with step halving
    finds its only maximum.
    """
    u = np.log(x)
    sd = u.std()
    if len(u) < 2 or not np.isfinite(sd) or sd <= 0:
        return None
    c = np.pi / (np.sqrt(3) * sd)
    a = c * np.median(u)
    n = len(u)

    def state(c, a):
        z = c * u - a
        ll = n * np.log(c) - np.logaddexp(0, -z).sum() - np.logaddexp(0, z).sum()
        f = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        g = 1 - 2 * f
        w = 2 * f * (1 - f)
        grad = np.array([n / c + (g * u).sum(), -g.sum()])
        hess = np.array([[-n / c**2 - (w * u * u).sum(), (w * u).sum()], [(w * u).sum(), -w.sum()]])
        return ll, grad, hess

    ll, g, h = state(c, a)
    for _ in range(max_iter):
        if np.max(np.abs(g)) < 1e-9 * n:
            return float(c), float(np.exp(a / c))
        try:
            step = np.linalg.solve(h, -g)
        except np.linalg.LinAlgError:
            return None
        size = 1.0
        while size > 1e-12:
            cn, an = c + size * step[0], a + size * step[1]
            if cn > 0:
                lln, gn, hn = state(cn, an)
                if lln >= ll - 1e-13 * abs(ll):
                    break
            size /= 2
        else:
            return (float(c), float(np.exp(a / c))) if np.max(np.abs(g)) < 1e-6 * n else None
        c, a, ll, g, h = cn, an, lln, gn, hn
    return None


@F.pandas_udf(FIT)
def _fit(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for values in batches:
        rows = [fit_log_logistic(np.asarray(v, float)) if v is not None and len(v) else None for v in values]
        yield pd.DataFrame([r or (None, None) for r in rows], columns=["shape", "scale"]).astype(float)


def fit_series(balances: DataFrame, group: list[str], value: str, baseline: Column, min_baseline: int = 5) -> DataFrame:
    """One row per series: its rows as an array, and shift, shape and scale of the fit.

    The fit uses the baseline years when there are at least ``min_baseline`` of them, else all years.  A series holds
    one balance per year, so the array is bounded by the calendar.
    """
    rest = [c for c in balances.columns if c not in group]
    sets = spread(balances.filter(F.col(value).isNotNull()), group).groupBy(*group).agg(F.collect_list(F.struct(*rest)).alias("_rows"),
                                        F.collect_list(F.when(baseline, F.col(value))).alias("_b"))
    everything = F.transform("_rows", lambda r: r[value])
    used = sets.withColumn("_u", F.sort_array(F.when(F.size("_b") >= min_baseline, F.col("_b")).otherwise(everything)))
    shifted = used.withColumn("shift", F.array_min("_u") - 1e-6)
    return (shifted.withColumn("_f", _fit(F.transform("_u", lambda x: x - F.col("shift"))))
            .select(*group, "_rows", "shift", "_f.*"))


def probability(balance: Column, shift: Column, shape: Column, scale: Column) -> Column:
    """Clipped log-logistic distribution function of a balance."""
    x = F.greatest(balance - shift, F.lit(1e-9))
    p = 1 / (1 + F.pow(x / scale, -shape))
    return F.when(balance.isNotNull(), num.clamp(p, 1e-6, 1 - 1e-6))


def standardise(balances: DataFrame, group: list[str], value: str, baseline: Column, name: str = "spei",
                min_baseline: int = 5) -> DataFrame:
    """Add the index to every balance; series whose fit failed are left out."""
    fits = fit_series(balances, group, value, baseline, min_baseline)
    good = fits.filter(F.col("shape").isNotNull() & ~F.isnan("shape"))
    rows = good.select(*group, "shift", "shape", "scale", F.inline("_rows"))
    # the probability is its own column: the quantile polynomial reads it many times
    indexed = (rows.withColumn("_p", probability(F.col(value), F.col("shift"), F.col("shape"), F.col("scale")))
               .withColumn(name, num.clamp(num.norm_ppf("_p"), -3.0, 3.0)))
    return indexed.select(*balances.columns, name)
