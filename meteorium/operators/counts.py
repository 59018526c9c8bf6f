"""Threshold-day counts, run lengths and the count regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as num
from ..session import spread


def runs(daily: DataFrame, entity: list[str], date: str, values: dict[str, tuple[str, list[float]]],
         mark_years: bool = False) -> DataFrame:
    """Days above each threshold with the length of the run of consecutive rows they belong to.

    ``values`` maps a kind to (column, thresholds).  Only days above a threshold leave the entity's ordered scan; the
    run of a day is the difference between its row number among all days and among the qualifying days.
    Output per run and year: entity, kind, threshold, year, days (of the run in that year), run_length.
    ``mark_years`` adds one row with a null kind for every entity and year that has any day.
    """
    line = Window.partitionBy(*entity).orderBy(date)
    numbered = daily.withColumn("_rn", F.row_number().over(line)).withColumn("_y", F.year(date))
    numbered = numbered.withColumn("_new", ~F.lag("_y").over(line).eqNullSafe(F.col("_y")))
    cells = [F.when(F.col(column) > t, F.struct(F.lit(kind).alias("kind"), F.lit(float(t)).alias("threshold")))
             for kind, (column, thresholds) in values.items() for t in thresholds]
    if mark_years:
        cells.append(F.when(F.col("_new"), F.struct(F.lit(None).cast("string").alias("kind"),
                                                    F.lit(None).cast("double").alias("threshold"))))
    hot = (numbered.select(*entity, F.col("_y").alias("year"), "_rn",
                           F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("_c"))
           .select(*entity, "year", "_rn", F.col("_c")["kind"].alias("kind"), F.col("_c")["threshold"].alias("threshold")))
    group = [*entity, "kind", "threshold"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_rn"))
    per_run = (hot.withColumn("_run", F.col("_rn") - place).groupBy(*group, "_run", "year")
               .agg(F.count(F.lit(1)).alias("days")))
    return per_run.withColumn("run_length", F.sum("days").over(Window.partitionBy(*group, "_run"))).drop("_run")


def threshold_counts(daily: DataFrame, entity: list[str], date: str, values: dict[str, tuple[str, list[float]]],
                     streaks: list[int]) -> DataFrame:
    """Days per year above each threshold in runs of at least each streak, zero-filled over the entity's years.

    The daily rows are read once: the year markers travel with the runs, and years without any day are filled in from
    the marker before them.
    """
    found = runs(daily, entity, date, values, mark_years=True)
    per = found.groupBy(*entity, "year", "kind", "threshold").agg(*[
        F.sum(F.when(F.col("run_length") >= k, F.col("days")).otherwise(0)).alias(f"k{k}") for k in streaks])
    # at most one entry per threshold and year
    packed = per.groupBy(*entity, "year").agg(F.collect_list(
        F.when(F.col("kind").isNotNull(), F.struct("kind", "threshold", *[f"k{k}" for k in streaks]))).alias("_h"))
    after = F.lead("year").over(Window.partitionBy(*entity).orderBy("year"))
    filled = packed.withColumn("_next", F.coalesce(after - 1, F.col("year"))).withColumn(
        "_y", F.explode(F.sequence("year", "_next")))
    grid = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(float(t)).alias("threshold"))
                     for kind, (_, ts) in values.items() for t in ts])
    own = F.when(F.col("_y") == F.col("year"), F.col("_h"))
    cells = filled.select(*entity, F.col("_y").alias("year"), own.alias("_h"), F.explode(grid).alias("_g"))
    hit = F.get(F.filter("_h", lambda h: (h["kind"] == F.col("_g")["kind"]) & (h["threshold"] == F.col("_g")["threshold"])), F.lit(0))
    with_hit = cells.withColumn("_hit", hit)
    counts = F.array(*[F.struct(F.lit(k).alias("streak"), F.coalesce(F.col("_hit")[f"k{k}"], F.lit(0)).cast("bigint").alias("count"))
                       for k in streaks])
    return (with_hit.select(*entity, F.col("_g")["kind"].alias("kind"), F.col("_g")["threshold"].alias("threshold"), "year",
                            F.explode(counts).alias("_s"))
            .select(*entity, "kind", "threshold", F.col("_s")["streak"].alias("streak"), "year", F.col("_s")["count"].alias("count")))


def streak_days(daily: DataFrame, entity: list[str], date: str, value: str, threshold: float, streak: int) -> DataFrame:
    """The qualifying days themselves: above the threshold inside a run of at least ``streak`` rows."""
    line = Window.partitionBy(*entity).orderBy(date)
    hot = daily.withColumn("_rn", F.row_number().over(line)).filter(F.col(value) > threshold)
    run = F.col("_rn") - F.row_number().over(line)
    return (hot.withColumn("_run", run)
            .withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy(*entity, "_run")))
            .filter(F.col("run_length") >= streak).drop("_rn", "_run"))


FIT = T.StructType([T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType()),
                    T.StructField("alpha", T.DoubleType()), T.StructField("v00", T.DoubleType()),
                    T.StructField("v01", T.DoubleType()), T.StructField("v11", T.DoubleType()),
                    T.StructField("loglik", T.DoubleType()), T.StructField("fit_ok", T.BooleanType())])


def nb2_loglik(theta: np.ndarray, t: np.ndarray, y: np.ndarray, ks: np.ndarray, lfact: float):
    """Log likelihood, gradient and Hessian in (a, b, alpha); ``ks`` holds 0..y-1 of every count in one vector.

    For whole counts the gamma ratio is a product, so no gamma function is needed:
    Gamma(y + 1/alpha) / Gamma(1/alpha) * alpha^y = prod over k < y of (1 + alpha k).
    """
    a, b, al = theta
    mu = np.exp(a + b * t)
    q = 1 + al * mu
    lq = np.log(q)
    kk = 1 + al * ks
    ll = np.log(kk).sum() - lfact + (y * (a + b * t) - (y + 1 / al) * lq).sum()
    ge = (y - mu) / q
    ga = (ks / kk).sum() + (lq / al**2 - (y + 1 / al) * mu / q).sum()
    hee = -mu * (1 + al * y) / q**2
    hea = -(y - mu) * mu / q**2
    haa = (-(ks / kk) ** 2).sum() + (-2 * lq / al**3 + 2 * mu / (al**2 * q) + (y + 1 / al) * (mu / q) ** 2).sum()
    grad = np.array([ge.sum(), (ge * t).sum(), ga])
    hess = np.array([[hee.sum(), (hee * t).sum(), hea.sum()],
                     [(hee * t).sum(), (hee * t * t).sum(), (hea * t).sum()],
                     [hea.sum(), (hea * t).sum(), haa]])
    return ll, grad, hess


#: Log dispersion below which a fit is given up: the counts vary less than a Poisson count, and rounding alone would decide.
NO_DISPERSION = -11.0


def fit_nb2(t: np.ndarray, y: np.ndarray, max_iter: int = 200) -> tuple:
    """Maximum-likelihood NB2 regression log mu = a + b t by damped Newton steps in (a, b, log alpha).

    ``fit_ok`` is true only for a converged fit whose covariance is finite and positive definite.
    """
    ks = np.concatenate([np.arange(int(v)) for v in y]) if y.sum() else np.zeros(0)
    lfact = np.log(ks + 1).sum()
    theta = np.array([np.log(max(y.mean(), 1e-8)), 0.0, 0.0])

    def evaluate(th):
        with np.errstate(all="ignore"):
            return nb2_loglik(np.array([th[0], th[1], np.exp(th[2])]), t, y, ks, lfact)

    ll, g, h = evaluate(theta)
    ok = False
    for _ in range(max_iter):
        al = np.exp(theta[2])
        grad = g * np.array([1, 1, al])
        if not np.all(np.isfinite(grad)):
            break
        scale = np.array([1.0, max(1.0, np.abs(t).max()), 1.0])
        if np.max(np.abs(grad) / scale) < 1e-7 * max(1.0, abs(ll)):
            ok = True
            break
        j = np.diag([1.0, 1.0, al])
        info = -(j @ h @ j)
        info[2, 2] -= al * g[2]
        damp, moved = 0.0, False
        for _ in range(40):
            try:
                trial_info = info + damp * np.diag(np.maximum(np.abs(np.diag(info)), 1e-8))
                np.linalg.cholesky(trial_info)
                step = np.linalg.solve(trial_info, grad)
            except np.linalg.LinAlgError:
                damp = max(damp * 10, 1e-6)
                continue
            new = theta + np.clip(step, -2, 2)
            out = evaluate(new)
            if np.isfinite(out[0]) and out[0] >= ll - 1e-12 * abs(ll):
                theta, (ll, g, h), moved = new, out, True
                break
            damp = max(damp * 10, 1e-6)
        if not moved or theta[2] < NO_DISPERSION:
            break
    al = float(np.exp(theta[2]))
    try:
        cov = np.linalg.inv(-h)
        ok = bool(ok and np.all(np.isfinite(cov)) and np.all(np.linalg.eigvalsh((cov + cov.T) / 2) > 0))
    except np.linalg.LinAlgError:
        return (None,) * 7 + (False,)
    return (float(theta[0]), float(theta[1]), al, float(cov[0, 0]), float(cov[0, 1]), float(cov[1, 1]), float(ll), ok)


@F.pandas_udf(FIT)
def _nb2(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = [f.name for f in FIT.fields]
    for xs, ys in batches:
        rows = []
        for x, y in zip(xs, ys):
            if x is None or len(x) == 0:
                rows.append((None,) * 7 + (True,))
                continue
            t = np.asarray(x, float)
            rows.append(fit_nb2(t - t[0], np.asarray(y, float)))
        yield pd.DataFrame(rows, columns=names).astype({"fit_ok": bool})


def count_trend(series: DataFrame, exclude_year: int | None = None, min_years: int = 10,
                min_nonzero: int = 10) -> DataFrame:
    """Add the count regression of each series (arrays ``years`` and ``counts``, one value per year).

    The excluded year (the running one) is shown but not fitted.  ``trend`` is null, never invented, when there are
    too few years, the fit is not trustworthy, or its curves are not finite.  ``fit_ok`` repeats the fit's own verdict
    so that a quality rule can check that no untrusted trend is published.
    """
    pairs = F.zip_with("years", "counts", lambda y, c: F.struct(y.alias("y"), c.alias("c")))
    used = F.filter(pairs, lambda p: p["y"] != exclude_year) if exclude_year is not None else pairs
    keys = [f.name for f in series.schema.fields if isinstance(f.dataType, T.AtomicType)]
    prepared = (spread(series, keys) if keys else series).withColumn("_u", used)
    enough = (F.size("_u") >= min_years) & (F.size(F.filter("_u", lambda p: p["c"] > 0)) >= min_nonzero)
    empty = F.array().cast("array<double>")
    fx = F.when(enough, F.transform("_u", lambda p: p["y"].cast("double"))).otherwise(empty)
    fy = F.when(enough, F.transform("_u", lambda p: p["c"].cast("double"))).otherwise(empty)
    fitted = prepared.withColumn("_f", _nb2(fx, fy))
    f = F.col("_f")
    t0 = F.get("_u", F.lit(0))["y"]
    years_fit = F.sort_array(F.transform("_u", lambda p: p["y"].cast("double")))
    n = F.size(years_fit)
    mid = (F.get(years_fit, F.floor((n - 1) / 2).cast("int")) + F.get(years_fit, F.floor(n / 2).cast("int"))) / 2
    mid_mu = F.exp(f["intercept"] + f["slope"] * (mid - t0))

    def r(x, d):
        k = float(10 ** d)
        return F.rint(x * k) / k

    def curve(term):
        return F.transform("years", lambda y: r(term(y - t0), 2))

    def mu(t):
        return F.exp(f["intercept"] + f["slope"] * t)

    def half(t):
        return 1.959963984540054 * F.sqrt(f["v00"] + 2 * t * f["v01"] + t * t * f["v11"])

    def band(t):
        return 1.96 * F.sqrt(mu(t) + mu(t) * mu(t) * r(f["alpha"], 3))

    p = num.two_sided_p(f["slope"] / F.sqrt(f["v11"]))
    trend = F.struct(
        F.lit("nb").alias("model_used"),
        r(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), (F.exp(f["slope"]) - 1) * 100)), 2).alias("rate_per_year"),
        r(mid_mu * (F.exp(f["slope"] * 10) - 1), 1).alias("days_per_decade"),
        r(F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), p)), 3).alias("p_value"),
        r(f["alpha"], 3).alias("alpha"), r(6 - 2 * f["loglik"], 1).alias("aic"),
        F.element_at("_u", -1)["y"].cast("int").alias("fit_year_max"),
        F.transform("years", lambda y: y.cast("double")).alias("x_line"), curve(mu).alias("y_line"),
        curve(lambda t: mu(t) * F.exp(-half(t))).alias("ci_low"), curve(lambda t: mu(t) * F.exp(half(t))).alias("ci_high"),
        curve(lambda t: F.greatest(F.lit(0.0), mu(t) - band(t))).alias("pi_low"),
        curve(lambda t: mu(t) + band(t)).alias("pi_high"))
    finite = F.forall(trend["ci_high"], lambda v: v.isNotNull() & ~F.isnan(v) & (v < float("inf")))
    publish = enough & f["fit_ok"] & finite
    return (fitted.withColumn("trend", F.when(publish, trend)).withColumn("fit_ok", f["fit_ok"]).drop("_u", "_f"))
