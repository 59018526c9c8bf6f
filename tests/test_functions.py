import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from meteorium.functions import calendar as cal
from meteorium.functions import categories as cat
from meteorium.functions import curves, geo
from meteorium.functions import numeric as num
from meteorium.functions import text as txt


@pytest.mark.parametrize("date,slot", [("2003-01-01", 1), ("2004-02-28", 59), ("2004-02-29", 59), ("2004-03-01", 60), ("2003-03-01", 60),
                                       ("2004-12-31", 365), ("2003-12-31", 365)])
def test_slots(spark, date, slot):
    row = spark.sql(f"select date'{date}' d").select(cal.slot("d").alias("s"), cal.position_slot(cal.position("d")).alias("p")).first()
    assert (row.s, row.p) == (slot, slot)


def test_slot_inverse(spark):
    rows = spark.range(1, 366).select("id", cal.slot_month("id").cast("int").alias("m"), cal.slot_day("id").alias("d")).collect()
    assert [(r.m, r.d) for r in rows if r.id in (60, 61)] == [(3, 1), (3, 2)]
    assert all((dt.date(2001, r.m, r.d) - dt.date(2000, 12, 31)).days == r.id for r in rows)


@pytest.mark.parametrize("target,half,dates,want", [
    (182, 0, ["1987-06-30", "1987-07-01", "1988-07-01", "1988-07-02"], {"1987-07-01": 1987, "1988-07-01": 1988}),
    (3, 5, ["1995-12-28", "1995-12-29", "1996-01-08", "1996-01-09"], {"1995-12-29": 1996, "1996-01-08": 1996}),
    (362, 4, ["1995-12-23", "1995-12-24", "1996-01-01", "1996-01-02"], {"1995-12-24": 1995, "1996-01-01": 1995}),
    (58, 1, ["1992-02-26", "1992-02-29", "1992-03-01"], {"1992-02-26": 1992, "1992-02-29": 1992})])
def test_window_membership(spark, target, half, dates, want):
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in dates], "d date").withColumn("s", cal.slot("d"))
    got = df.filter(F.abs(cal.circular_distance("s", F.lit(target))) <= half).select(
        "d", cal.window_year(F.year("d"), "s", F.lit(target)).alias("y")).collect()
    assert {str(r.d): r.y for r in got} == want


@pytest.mark.parametrize("offset", [3600, 7200])
def test_local_dates(spark, offset):
    start = int(dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc).timestamp()) - offset
    df = spark.createDataFrame([(start, start + 3 * 86400, 86400, offset)], "a long, b long, i long, o long")
    assert df.select(cal.local_dates("a", "b", "i", "o").alias("x")).first().x == [dt.date(2024, 7, k) for k in (1, 2, 3)]


def test_month_day_window():
    assert cal.month_day_window("12-31", 3) == ["12-30", "12-31", "01-01"]
    assert cal.month_day_window("03-15", 5) == ["03-13", "03-14", "03-15", "03-16", "03-17"]


def test_normal_functions(spark):
    xs = [x / 10 for x in range(-90, 91)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", num.norm_cdf("x").alias("p")).collect()
    assert max(abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) for r in got) < 1e-14
    ps = [1e-9, 1e-6, 0.01, 0.07, 0.5, 0.6, 0.93, 0.999, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", num.norm_ppf("p").alias("z")).collect()
    assert max(abs(r.z - NormalDist().inv_cdf(r.p)) for r in got) < 1e-12
    assert spark.sql("select 0.0D p").select(num.norm_ppf("p").alias("z")).first().z is None


def test_lapse_correction(spark):
    df = spark.createDataFrame([(-3.0, 0.0), (4.0, 200.0), (15.5, -40.0)], "t double, d double")
    got = [r.x for r in df.select(num.lapse_corrected("t", "d").alias("x")).collect()]
    assert got == pytest.approx([-3.0, 4.0 + 1.3, 15.5 - 0.26])


def test_ladders(spark):
    df = spark.createDataFrame([(9.99,), (10.0,), (79.0,), (80.0,), (95.0,)], "p double")
    assert [r.c for r in df.select(cat.season_category("p").alias("c")).collect()] == ["cold", "cool", "normal", "hot", "extreme"]
    el = spark.createDataFrame([(0,), (400,), (401,), (801,), (2514,)], "e int")
    assert [r.c for r in el.select(cat.elevation_band("e").alias("c")).collect()] == ["lowland", "lowland", "foothill", "mountain", "alpine"]
    v = spark.createDataFrame([(-1.0,), (5.0,), (25.0,), (99.0,)], "v double")
    cuts = {"p05": F.lit(0.0), "p20": F.lit(10.0), "p95": F.lit(50.0)}
    assert [r.c for r in v.select(cat.percentile_bucket("v", cuts).alias("c")).collect()] == ["p00", "p05", "p20", "p95"]


def test_curve_round_trip(spark):
    rng = random.Random(3)
    shapes = {"uniform": [(x / 10, 1.0) for x in range(11)], "triangle": [(x, 10 - abs(10 - x)) for x in range(21)],
              "uneven": sorted((rng.uniform(0, 30), rng.random()) for _ in range(40))}
    rows = [(n, [(float(x), float(d)) for x, d in c], float(p)) for n, c in shapes.items() for p in (1, 5, 20, 50, 80, 95, 99)]
    df = spark.createDataFrame(rows, "n string, c array<struct<x:double,d:double>>, p double")
    got = df.withColumn("c", curves.prepared("c")).withColumn("q", curves.quantile("c", "p")).withColumn("back", curves.cdf_percent("c", "q")).collect()
    assert max(abs(r.back - r.p) for r in got) < 1e-9
    assert next(r.q for r in got if r.n == "triangle" and r.p == 50) == pytest.approx(10.0)


def test_curve_edges(spark):
    df = spark.createDataFrame([([(0.0, 1.0), (1.0, 1.0)], -1.0), ([(0.0, 1.0), (1.0, 1.0)], 2.0), ([(0.0, 1.0)], 0.0), ([(0.0, 0.0), (1.0, 0.0)], 0.5)],
                               "c array<struct<x:double,d:double>>, v double")
    short = df.filter("size(c) = 1").select(curves.quantile(curves.prepared("c"), F.lit(50.0)).alias("x"))
    df = df.withColumn("c", curves.prepared("c"))
    assert [r.x for r in df.select(curves.cdf_percent("c", "v").alias("x")).collect()] == [0.0, 100.0, 0.0, 0.0]
    assert [r.x for r in df.select(curves.density_at("c", "v").alias("x")).collect()] == [0.0] * 4
    assert short.first().x is None
    odd = spark.createDataFrame([(None, 1.0), ([(0.0, 1.0), (1.0, 1.0)], None), ([(0.0, 1.0), (1.0, 1.0)], float("nan"))], "c array<struct<x:double,d:double>>, v double")
    odd = odd.withColumn("c", curves.prepared("c"))
    assert [tuple(r) for r in odd.select(curves.cdf_percent("c", "v"), curves.density_at("c", "v"), curves.quantile("c", "v")).collect()] == [(0.0, 0.0, None)] * 3


def test_curve_readouts_match_a_fine_sum(spark):
    """Percent, density and quantile against trapezoids over a fine grid; curves of many sizes, with steps and gaps."""
    rng = random.Random(8)
    rows = []
    for n in (2, 3, 4, 7, 8, 9, 100, 200, 257):
        xs = sorted(rng.choice([rng.uniform(-5, 5), float(rng.randrange(-5, 5))]) for _ in range(n))
        points = [(x, rng.choice([0.0, rng.random()])) for x in xs]
        if sum((b[1] + a[1]) * (b[0] - a[0]) for a, b in zip(points, points[1:])) > 0:
            rows += [(n, points, v) for v in [*xs[:5], xs[-1], *(rng.uniform(-6, 6) for _ in range(12))]]
    df = spark.createDataFrame(rows, "n int, points array<struct<x:double,d:double>>, v double").withColumn("c", curves.prepared("points"))
    got = df.select("points", "v", curves.cdf_percent("c", "v").alias("pct"), curves.density_at("c", "v").alias("den"),
                    curves.quantile("c", F.lit(30.0)).alias("q")).collect()
    for r in got:
        at = lambda v: next((a.d + (v - a.x) / (b.x - a.x) * (b.d - a.d) for a, b in zip(r.points, r.points[1:]) if a.x <= v < b.x), 0.0)
        whole = lambda to: sum((a.d + (b.d if b.x <= to else at(to))) / 2 * (min(b.x, to) - a.x) for a, b in zip(r.points, r.points[1:]) if a.x < to and b.x > a.x)
        assert r.den == pytest.approx(at(r.v) if r.points[0].x < r.v else 0.0)
        assert r.pct == pytest.approx(whole(r.v) / whole(1e9) * 100)
        assert whole(r.q) / whole(1e9) == pytest.approx(0.3)


def test_tiles(spark):
    df = spark.createDataFrame([(45.5, 13.6), (-33.9, 151.2)], "lat double, lon double")
    for r in df.select("lat", "lon", geo.tile_x("lon", 12).alias("x"), geo.tile_y("lat", 12).alias("y")).withColumns(
            {"w": geo.tile_lon("x", 12), "n": geo.tile_lat("y", 12)}).collect():
        n = 2 ** 12
        assert r.x == int((r.lon + 180) / 360 * n)
        assert r.y == int((1 - math.asinh(math.tan(math.radians(r.lat))) / math.pi) / 2 * n)
        assert r.w <= r.lon and r.n >= r.lat


def test_tiles_near_the_poles_and_beyond(spark):
    lats = [-89.999999, -90.0, 90.0, -90 + 1e-7, 89.999999, 270.0, 90.25, 450.0, -0.0]
    df = spark.createDataFrame([(x,) for x in lats], "lat double").withColumn("y", geo.tile_y("lat", 10))
    got = {r.lat: (r.y, r.n) for r in df.withColumn("n", geo.tile_lat("y", 10)).collect()}
    for x in lats:
        y = math.floor((1 - math.asinh(math.tan(math.radians(x))) / math.pi) / 2 * 1024)
        assert got[x][0] == y and got[x][1] == pytest.approx(math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 1024)))))


def test_northern_edge_of_a_far_tile(spark):
    df = spark.createDataFrame([(2 ** 63 - 1,), (-2 ** 63,)], "y long")
    assert [r.n for r in df.select(geo.tile_lat("y", 10).alias("n")).collect()] == [-90.0, 90.0]


def test_snap_and_terrain(spark):
    df = spark.createDataFrame([(3.0,), (14.9,), (15.0,), (999.0,)], "v double")
    assert [r.x for r in df.select(geo.snap_level("v").alias("x")).collect()] == [10, 10, 20, 250]
    t = spark.createDataFrame([(128, 10, 128)], "r int, g int, b int")
    assert t.select(geo.terrain_metres("r", "g", "b").alias("x")).first().x == 10.5
    assert spark.createDataFrame([(0, 0, 100)], "r int, g int, b int").select(geo.packed_height("r", "g", "b").alias("x")).first().x is None


def test_text(spark):
    df = spark.createDataFrame([("<td>14 Apr 2023</td>", "[ a b ]"), ("nothing", "x")], "h string, b string")
    rows = df.select(txt.compact_date("h").alias("d"), txt.strip_tags("h").alias("t"), txt.strip_brackets("b").alias("s")).collect()
    assert [(r.d, r.t, r.s) for r in rows] == [("20230414", "14 Apr 2023", "ab"), (None, "nothing", "x")]


def test_sorted_percentile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    samples = [sorted(rng.normal(size=n).tolist()) for n in (1, 2, 7, 50)]
    df = spark.createDataFrame([(s,) for s in samples], "s array<double>").select("s", *[num.sorted_percentile("s", p).alias(f"p{int(p * 100)}") for p in (0.05, 0.5, 0.95)])
    for r in df.collect():
        assert [r.p5, r.p50, r.p95] == pytest.approx(np.percentile(r.s, [5, 50, 95]))
