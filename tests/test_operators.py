import datetime as dt
import math
import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


from catalog import ranks
from meteorium.operators import counts, density, drought, flood, grids, quantiles, seasons, series, trends, windows
from meteorium.plans import grids as grid_plans
from meteorium.plans import serve

CUM = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]


def slot(d):
    return CUM[d.month - 1] + (28 if (d.month, d.day) == (2, 29) else d.day)


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(7)
    rows = []
    for e in ("a", "b"):
        day = dt.date(1999, 11, 3)
        while day < dt.date(2004, 3, 20):
            if rng.random() > 0.2:
                rows.append((e, day, float(rng.integers(0, 400)) / 8, None if rng.random() < 0.1 else float(rng.integers(0, 9))))
            day += dt.timedelta(days=1)
    return rows, spark.createDataFrame(rows, "e string, d date, v double, w double").repartition(5)


def brute_windows(rows, half):
    out = {}
    for e, d, v, w in rows:
        for target in range(1, 366):
            raw = slot(d) - target
            if abs((raw + 182) % 365 - 182) <= half:
                year = d.year + (1 if raw > 182 else -1 if raw < -182 else 0)
                out.setdefault((e, half, target, year), []).append((v, w))
    return out


def test_window_years_equal_brute_force(daily):
    rows, df = daily
    got = {(r.e, r.half, r.slot, r.window_year): (r.n_rows, r.v, r.w)
           for r in windows.window_years(df, ["e"], "d", {"v": "avg", "w": "sum"}, [0, 7, 45]).collect()}
    want = {}
    for h in (0, 7, 45):
        for k, vs in brute_windows(rows, h).items():
            want[k] = (len(vs), sum(v for v, _ in vs) / len(vs), sum(w for _, w in vs if w is not None))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:]) for k in want)


def test_pooled_samples_equal_brute_force(daily):
    rows, df = daily
    got = {(r.e, r.slot): r.samples for r in windows.pooled_samples(df, ["e"], "d", "v", 7).collect()}
    want = {}
    for (e, _, target, _), vs in brute_windows(rows, 7).items():
        want.setdefault((e, target), []).extend(v for v, _ in vs)
    assert got == {k: sorted(v) for k, v in want.items()}


def test_window_half_is_limited(daily):
    with pytest.raises(ValueError):
        windows.window_years(daily[1], ["e"], "d", {"v": "avg"}, [183])


@pytest.mark.parametrize("levels,task_rows", [(8, 1_000_000), (4, 300), (2, 40)])
def test_exact_percentiles_with_hot_group_and_ties(spark, levels, task_rows):
    rng = np.random.default_rng(0)
    hot = np.concatenate([rng.lognormal(size=20000), np.full(9000, 1.5)])
    pdf = pd.DataFrame({"g": ["hot"] * len(hot) + ["small"] * 3 + ["one"], "v": list(hot) + [3.0, 1.0, 2.0, 5.0]})
    cuts = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in quantiles.exact_percentiles(spark.createDataFrame(pdf).repartition(6), ["g"], "v", cuts, levels, task_rows).collect()}
    for g, part in pdf.groupby("g"):
        want = np.percentile(part.v, [0, 5, 50, 95, 100])
        assert [got[g][c] for c in cuts] == pytest.approx(list(want)), g
        assert got[g].n_samples == len(part)


def test_strict_percent_rank_uses_baseline(spark):
    df = spark.createDataFrame([(1, 1990, 1.0), (1, 1991, 2.0), (1, 1992, 2.0), (1, 2000, 3.0), (2, 2000, 1.0), (2, 2001, 4.0)], "g int, y int, v double")
    got = {(r.g, r.y): r.p for r in quantiles.strict_percent_rank(df, ["g"], "v", "p", F.col("y") < 1995).collect()}
    assert got[(1, 1991)] == pytest.approx(100 / 3) and got[(1, 2000)] == 100 and got[(1, 1990)] == 0
    assert got[(2, 2001)] == 50  # no baseline year: all values count


def _fit(spark, ys, xs=None, **kw):
    xs = xs or list(range(2000, 2000 + len(ys)))
    df = spark.createDataFrame([("g", x, float(y)) for x, y in zip(xs, ys)], "g string, x int, y double")
    return trends.robust_trend(trends.yearly_series(df, ["g"], "x", "y"), **kw)


def test_theil_sen_against_pairs(spark):
    rng = np.random.default_rng(5)
    xs = sorted(rng.choice(np.arange(1950, 2025), 40, replace=False).tolist())
    ys = (0.03 * np.array(xs) + rng.normal(size=40)).round(1).tolist()
    r = _fit(spark, ys, xs).first()
    s = sorted((ys[j] - ys[i]) / (xs[j] - xs[i]) for i in range(40) for j in range(i + 1, 40))
    assert r.slope == pytest.approx(np.median(s))
    assert r.intercept == pytest.approx(np.median(ys) - np.median(s) * np.median(xs))
    assert r.slope_lo in [pytest.approx(v) for v in s] and r.slope_lo < r.slope < r.slope_hi
    sign = sum(np.sign(ys[j] - ys[i]) for i in range(40) for j in range(i + 1, 40))
    ties = pd.Series(ys).value_counts()
    var = (40 * 39 * 85 - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
    z = (sign - np.sign(sign)) / math.sqrt(var)
    assert (r.s, r.var_s) == (sign, pytest.approx(var))
    assert r.p_mk == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_yue_wang_equals_lag_sum(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=30))
    r = _fit(spark, y.tolist()).first()
    n, i = 30, np.arange(1, 31)
    b = np.median([(y[k] - y[j]) / (k - j) for j in range(n) for k in range(j + 1, n)])
    d = y - b * i
    d = d - d.mean()
    acf = [np.sum(d[:n - lag] * d[lag:]) / np.sum(d * d) for lag in range(n)]
    assert r.correction == pytest.approx(1 + 2 * sum((1 - lag / n) * acf[lag] for lag in range(1, n)))


def test_trend_properties(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=20)
    base = _fit(spark, y.tolist()).first()
    scaled = _fit(spark, (3 * y + 10).tolist()).first()
    back = _fit(spark, y[::-1].tolist()).first()
    assert scaled.slope == pytest.approx(3 * base.slope) and scaled.s == base.s and back.s == -base.s
    assert _fit(spark, [1.0] * 12).first().z_mk is None
    assert _fit(spark, [1.0, 2.0, 3.0]).count() == 0
    assert _fit(spark, [1.0, 2.0, 3.0], drop_short=False).first().slope is None


def test_verdict(spark):
    assert _fit(spark, list(range(12))).first().verdict == "increasing"
    assert _fit(spark, list(range(12, 0, -1))).first().verdict == "decreasing"


def test_least_squares_degenerate(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0)], "g string, x double, y double")
    r = trends.least_squares(df, ["g"], "x", "y").first()
    assert (r.slope, r.intercept) == (0.0, 3.0)


def test_streaks_cross_year_end(spark):
    days = [dt.date(2000, 12, 30) + dt.timedelta(days=k) for k in range(8)]
    vals = [30, 31, 32, 5, 30, 30, 5, 30]
    df = spark.createDataFrame([("s", d, float(v)) for d, v in zip(days, vals)], "e string, d date, v double")
    got = {(r.threshold, r.streak, r.year): r["count"] for r in counts.threshold_counts(df, ["e"], "d", {"days": ("v", [25, 31])}, [1, 2, 3]).collect()}
    assert got[(25.0, 1, 2000)] == 2 and got[(25.0, 1, 2001)] == 4
    assert got[(25.0, 3, 2000)] == 2 and got[(25.0, 3, 2001)] == 1
    assert got[(25.0, 2, 2001)] == 3
    assert got[(31.0, 1, 2001)] == 1 and got[(31.0, 2, 2001)] == 0


def test_threshold_counts_fill_empty_years(spark):
    df = spark.createDataFrame([("s", dt.date(2000, 7, 1), 40.0), ("s", dt.date(2003, 7, 1), 10.0), ("cold", dt.date(2001, 1, 1), 0.0)], "e string, d date, v double")
    got = {(r.e, r.year): r["count"] for r in counts.threshold_counts(df, ["e"], "d", {"days": ("v", [25])}, [1]).collect()}
    assert got == {("s", 2000): 1, ("s", 2001): 0, ("s", 2002): 0, ("s", 2003): 0, ("cold", 2001): 0}


# 41 yearly counts with a rising mean and more spread than Poisson counts have; the last year is far out
_RISING = np.random.default_rng(11)
COUNTS = [int(v) for v in _RISING.poisson(np.exp(1.2 + 0.03 * np.arange(40)) * _RISING.gamma(4.0, 0.25, size=40))] + [40]


def _count_trend(spark, years, values, **kw):
    df = spark.createDataFrame([("s", years, values)], "e string, years array<int>, counts array<int>")
    return counts.count_trend(df, **kw).first()


def test_count_regression_is_trusted(spark):
    years = list(range(1980, 2021))
    r = _count_trend(spark, years, COUNTS, exclude_year=2020)
    assert r.fit_ok and r.trend.model_used == "nb" and r.trend.fit_year_max == 2019
    assert r.trend.rate_per_year > 0 and r.trend.p_value < 0.05 and len(r.trend.y_line) == 41
    assert all(a <= b <= c for a, b, c in zip(r.trend.ci_low, r.trend.y_line, r.trend.ci_high))


def test_count_regression_is_at_the_maximum():
    t, y = np.arange(40.0), np.array(COUNTS[:-1], float)
    a, b, al, *_rest, ll, ok = counts.fit_nb2(t, y)
    ks = np.concatenate([np.arange(int(v)) for v in y])
    lf = np.log(ks + 1).sum()
    assert ok
    for da, db, dl in ((1e-3, 0, 0), (-1e-3, 0, 0), (0, 1e-4, 0), (0, -1e-4, 0), (0, 0, 1e-3), (0, 0, -1e-3)):
        assert counts.nb2_loglik(np.array([a + da, b + db, al + dl]), t, y, ks, lf)[0] < ll


def test_count_regression_recovers_parameters():
    rng = np.random.default_rng(4)
    t = np.arange(2000) / 100.0
    mu = np.exp(1.0 + 0.05 * t)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, size=2000)).astype(float)
    a, b, al, *_, ok = counts.fit_nb2(t, y)
    assert ok and abs(b - 0.05) < 0.02 and abs(al - 0.5) < 0.1 and abs(a - 1.0) < 0.2


def test_count_regression_is_withheld(spark):
    few = _count_trend(spark, list(range(2000, 2021)), [0] * 16 + [1, 2, 3, 4, 5])
    assert few.trend is None and few.fit_ok
    flat = _count_trend(spark, list(range(2000, 2030)), [5] * 30)  # no overdispersion: alpha runs to its bound
    assert flat.trend is None and not flat.fit_ok


def test_drought_index_is_monotone(spark):
    df = spark.createDataFrame([("s", 2000 + k, float(k)) for k in range(1, 8)], "g string, y int, b double")
    got = [r.spei for r in drought.standardise(df, ["g"], "b", F.col("y") <= 2006).orderBy("b").collect()]
    assert len(got) == 7 and all(x <= y for x, y in zip(got, got[1:])) and max(map(abs, got)) <= 3


def test_drought_fit_is_at_the_maximum_and_withheld_when_flat(spark):
    x = np.random.default_rng(1).lognormal(2, 0.5, 60)
    c, s = drought.fit_log_logistic(x)

    def ll(c, s):
        z = (x / s) ** c
        return np.sum(np.log(c / s) + (c - 1) * np.log(x / s) - 2 * np.log1p(z))
    assert all(ll(c, s) > ll(c + dc, s + ds) for dc, ds in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))
    flat = spark.createDataFrame([("s", 2000 + k, 5.0) for k in range(8)], "g string, y int, b double")
    assert drought.standardise(flat, ["g"], "b", F.lit(True)).count() == 0


def test_season_rules(spark):
    day, rows = dt.date(2000, 1, 1), []
    while day <= dt.date(2002, 5, 30):
        rows.append(("s", day, 1.0))
        day += dt.timedelta(days=1)
    got = {(r.season, r.y): r.n_days for r in seasons.season_aggregate(spark.createDataFrame(rows, "e string, d date, v double"), ["e"], "d", F.sum("v"), "t").collect()}
    assert got[("Winter", 2000)] == 60 and got[("Winter", 2001)] == 90 and ("Spring", 2002) not in got and ("Winter", 2003) not in got


def test_shared_ranks(spark):
    df = spark.createDataFrame([(2000, 3.0), (2001, 5.0), (2002, 5.0), (2003, 1.0)], "y int, v double").withColumn("g", F.lit(1))
    r = {x.y: (x["rank"], x.total) for x in seasons.rank_seasons(df, ["g"], "v", F.lit(True)).collect()}
    assert r == {2000: (3, 4), 2001: (1, 4), 2002: (1, 4), 2003: (4, 4)}


def test_gaussian_curve_integrates_to_one(spark):
    s = np.random.default_rng(0).normal(10, 3, 300)
    c = density.gaussian_curve(spark.createDataFrame([(s.tolist(),)], "samples array<double>")).first().distribution
    x, d = np.array([p.x for p in c]), np.array([p.d for p in c])
    assert len(c) == 200 and 0.95 < np.trapezoid(d, x) <= 1.001
    flat = density.gaussian_curve(spark.createDataFrame([([4.0] * 60,)], "samples array<double>")).first().distribution
    assert all(p.d == 0 for p in flat)


def test_mixture_is_the_mean(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]), (1, [(1.0, 0.0), (2.0, 1.0), (3.0, 0.0)]), (1, [(0.0, 1.0)])],
                               "g int, c array<struct<x:double,d:double>>")
    m = density.mixture(df, ["g"], "c", points=7, name="m").first().m
    assert [p.x for p in m] == pytest.approx([0, 0.5, 1, 1.5, 2, 2.5, 3])
    assert [p.d for p in m] == pytest.approx([0, 0.25, 0.5, 0.5, 0.5, 0.25, 0])


def test_centred_mean_offsets(spark):
    v = np.arange(30.0) ** 2
    df = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(v)], "g int, t int, v double")
    got = [r.m for r in grids.centred_mean(df, ["g"], "t", "v", "m", 10).orderBy("t").collect()]
    assert got == pytest.approx(list(pd.Series(v).rolling(10, min_periods=1, center=True).mean()))


def test_spline_reproduces_a_cubic(spark):
    f = lambda x, y: x**3 - 2 * x * y + 0.5 * y**3 - 1
    df = spark.createDataFrame([(1, x, y, float(f(x, y))) for x in range(6) for y in range(5)], "g int, x int, y int, v double")
    got = grids.regrid_bicubic(df, ["g"], "x", "y", "v", 4).collect()
    assert len(got) == 21 * 17 and max(abs(r.v - f(r.fx / 4, r.fy / 4)) for r in got) < 1e-9


def brute_extent(elev, water):
    h, w = elev.shape
    seen, todo = set(), deque()
    for r, c in [(r, 0) for r in range(h)] + [(h - 1, c) for c in range(w)]:
        if elev[r, c] <= 0 and elev[r, c] < water and (r, c) not in seen:
            seen.add((r, c))
            todo.append((r, c))
    while todo:
        r, c = todo.popleft()
        for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= a < h and 0 <= b < w and (a, b) not in seen and elev[a, b] < water:
                seen.add((a, b))
                todo.append((a, b))
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_flood_equals_search_over_many_tiles(spark, seed):
    elev = np.random.default_rng(seed).integers(-20, 40, size=(23, 19)) / 20
    df = spark.createDataFrame([(c, r, float(elev[r, c])) for r in range(23) for c in range(19)], "x int, y int, elevation double")
    got = {(r.y, r.x): r.connect for r in flood.connect_levels(df, size=5).collect()}
    for water in (0.01, 0.3, 0.8, 1.5):
        assert {k for k, v in got.items() if v < water} == brute_extent(elev, water)
    base = brute_extent(elev, 0.01)
    lc = {r.level_cm: r.px for r in flood.level_counts(flood.connect_levels(df, size=8), [30, 80, 150]).collect()}
    assert lc == {cm: len(brute_extent(elev, cm / 100) - base) for cm in (30, 80, 150)}


def test_keep_last_and_latest(spark):
    df = spark.createDataFrame([("a", 1, 1, "old"), ("a", 1, 3, "new"), ("a", 2, 2, "x"), ("b", 1, 1, "y")], "e string, d int, n int, v string")
    assert {(r.e, r.d): r.v for r in series.keep_last(df, ["e", "d"], ["n"]).collect()} == {("a", 1): "new", ("a", 2): "x", ("b", 1): "y"}
    assert [(r.d, r.recency) for r in series.latest_rows(df.filter("e = 'a' and n > 1"), ["e"], "d", 1).collect()] == [(2, 1)]


def test_interpolation(spark):
    df = spark.createDataFrame([("a", 2020, 10.0), ("a", 2025, 20.0), ("a", 2030, 0.0)], "g string, y int, v double")
    got = {r.y: r.v for r in series.interpolate_yearly(df, ["g"], "y", ["v"]).collect()}
    assert len(got) == 11 and got[2022] == 14 and got[2027] == 12 and got[2030] == 0
    req = spark.createDataFrame([("a", 2010.0), ("a", 2022.5), ("a", 2040.0), ("a", 2025.0)], "g string, at double")
    assert {r.at: r.o for r in series.lookup_piecewise(req, df, ["g"], "y", "at", {"o": "v"}).collect()} == {2010.0: 10, 2022.5: 15, 2040.0: 0, 2025.0: 20}


def test_piecewise_lookup_of_several_values_over_many_ranges(spark):
    rng = random.Random(4)
    knots = [(g, x, rng.random(), rng.random()) for g in ("hot", "cold", "one") for x in sorted(rng.sample(range(200), {"hot": 90, "cold": 4, "one": 1}[g]))]
    asks = [("hot", rng.choice([rng.uniform(-5, 205), float(rng.randrange(200))])) for _ in range(700)] + [(g, float(x)) for g in ("cold", "one", "none") for x in (-1, 0, 50, 77.5, 300)]
    asks += [("hot", None), (None, 3.0), ("hot", 50.0), ("hot", 50.0)]
    k = spark.createDataFrame(knots, "g string, x int, a double, b double").repartition(5)
    r = spark.createDataFrame(asks, "g string, at double").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = series.lookup_piecewise(r, k, ["g"], "x", "at", {"va": "a", "vb": "b"})
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.columns == ["g", "at", "va", "vb"] and len(got) == len(asks)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    for row in got:
        own = [t for t in knots if t[0] == row.g]
        if row.at is None or not own:
            assert row.va is None and row.vb is None
            continue
        xs = [t[1] for t in own]
        assert row.va == pytest.approx(np.interp(row.at, xs, [t[2] for t in own])) and row.vb == pytest.approx(np.interp(row.at, xs, [t[3] for t in own]))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9, 40])
def test_banded_spline_equals_the_dense_system(n):
    y = np.random.default_rng(n).normal(size=(n, 3))
    at = np.linspace(0, n - 1, 7 * n)
    got = grids.not_a_knot_spline(y, at)
    if n < 4:
        want = np.stack([np.polyval(np.polyfit(np.arange(n), c, n - 1), at) for c in y.T], axis=1)
    else:  # all cubic pieces at once: values, two derivatives at inner knots, third derivatives at the two outer ones
        m, rhs = [], []
        power = lambda t, d: [0.0 if k < d else np.prod(range(k - d + 1, k + 1)) * t ** (k - d) for k in range(4)]
        def row(parts, value):
            line = np.zeros(4 * (n - 1))
            for piece, coefs in parts:
                line[4 * piece:4 * piece + 4] += coefs
            m.append(line)
            rhs.append(value)
        for p in range(n - 1):
            row([(p, power(0.0, 0))], y[p])
            row([(p, power(1.0, 0))], y[p + 1])
        for p in range(n - 2):
            for d in (1, 2):
                row([(p, power(1.0, d)), (p + 1, [-c for c in power(0.0, d)])], np.zeros(3))
        for p in (0, n - 3):
            row([(p, power(1.0, 3)), (p + 1, [-c for c in power(0.0, 3)])], np.zeros(3))
        c = np.linalg.solve(np.array(m), np.array(rhs)).reshape(n - 1, 4, 3)
        i = np.clip(at.astype(int), 0, n - 2)
        want = sum(c[i, k] * ((at - i) ** k)[:, None] for k in range(4))
    assert np.allclose(got, want)


def test_model_map_closes_the_circle(spark):
    cells = [("v", year, x, y, 273.15 + x + 10 * y) for year in range(1850, 1862) for x in range(8) for y in range(5)]
    df = spark.createDataFrame(cells, "variable string, year int, x int, y int, value double")
    from meteorium.functions import geo
    made = grid_plans.model_map(df, 1850, geo.Box(-91, 91, -181, 181), 2, ["v"], around=8, step=45.0, south=-90.0).collect()
    assert len(made) == len({(r.latitude, r.longitude) for r in made}) == 15 * 9
    assert {(r.latitude, r.longitude): r.v for r in made}[0.0, 0.0] == pytest.approx(20.0) and {r.year_start for r in made} == {1850}
    assert {(r.latitude, r.longitude): r.v for r in made}[-67.5, 22.5] == pytest.approx(5.5)


def test_places_in_a_total_order(spark):
    names = ["čaj", "cvet", "Dan", "žaba", "zima", "šal", "sol", "", "cvet 2"] + [f"ime {k:03d}" for k in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(7)
    got = [(r.n, r["rank"]) for r in serve.sorted_names(df, "n").collect()]
    assert [r for _, r in got] == list(range(1, len(names) + 1))
    order = [n for n, _ in got]
    assert order.index("cvet") < order.index("cvet 2") < order.index("čaj") < order.index("Dan") and order.index("sol") < order.index("šal") < order.index("zima") < order.index("žaba")


def test_gaps_and_order(spark):
    d = lambda k: dt.date(2000, 1, k)
    df = spark.createDataFrame([("a", 0, d(1)), ("a", 1, d(2)), ("a", 2, d(2)), ("a", 3, d(6)), ("a", 4, d(5))], "e string, q long, d date")
    c = series.continuity(df, ["e"], "d").first()
    assert (c.n_rows, c.duplicates, c.missing) == (5, 1, 2)
    assert [(str(r.d), r.missing) for r in series.date_gaps(df, ["e"], "d").collect()] == [("2000-01-05", 2)]
    for block in (1, 2, 4, 100):
        assert [r.q for r in series.order_inversions(df, ["e"], "q", "d", block).collect()] == [4]


def test_sum_of_inversions_beyond_64_bits(spark, tmp_path):
    columns = ("l_returnflag string, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_discount double, l_suppkey long, l_orderkey long, "
               "l_linenumber int, l_partkey long")
    for name, key, kind in (("small", 10, "bigint"), ("large", 9_000_000_000_000, "decimal(30,0)")):
        rows = [("A", dt.datetime(2000, 1, 9 - k), 1.0, 1.0, 0.0, 1, key + k, 1, 2) for k in range(4)]
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        got = ranks.order_inversions(spark, str(tmp_path / name))
        assert dict(got.dtypes) == {"entity": "string", "n": "bigint", "seqs": kind}
        assert [(r.entity, r.n, int(r.seqs)) for r in got.collect()] == [("A", 3, sum((key + k) * 1_000_000 + 17 for k in (1, 2, 3)))]
