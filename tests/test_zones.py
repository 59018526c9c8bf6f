import random

import pytest

from meteorium.operators import zones


def data(seed):
    rng = random.Random(seed)
    spot = lambda: rng.choice([None, 0.0, float(rng.randrange(-9, 9)), rng.uniform(-1000, 1000), rng.uniform(-1, 1)])
    boxes = []
    for k in range(60):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        w, h = (rng.choice([0.0, 1e-9, 0.5, 1.0, 4.0, 64.0, 3000.0, -1.0, rng.uniform(0, 100)]) for _ in "ab")
        boxes.append((k, x if k % 9 else 0.0, (x if k % 9 else 0.0) + w, y if k % 7 else None, y + h))
    return [(k, spot(), spot()) for k in range(300)], boxes


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_zone_join_equals_all_comparisons(spark, seed, closed):
    points, boxes = data(seed)
    got = zones.zone_join(spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(boxes, "z int, west double, east double, south double, north double"), "x", "y", closed=closed)
    le = (lambda a, b: a <= b) if closed else (lambda a, b: a < b)
    want = sorted((p, z) for p, x, y in points for z, w, e, s, n in boxes
                  if None not in (x, y, s) and w <= e and s <= n and le(w, x) and le(x, e) and le(s, y) and le(y, n))
    assert sorted((r.p, r.z) for r in got.collect()) == want and len(want) > 50
    assert got.columns == ["p", "x", "y", "z", "west", "east", "south", "north"]


def test_no_nested_loop_and_empty_tables(spark):
    points, boxes = data(3)
    p, z = spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(boxes, "z int, west double, east double, south double, north double")
    plan = zones.zone_join(p, z, "x", "y")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan.split("Physical Plan")[1] and "Cartesian" not in plan.split("Physical Plan")[1]
    assert zones.zone_join(p.limit(0), z, "x", "y").count() == 0 and zones.zone_join(p, z.limit(0), "x", "y").count() == 0


def test_a_point_takes_few_rows_for_boxes_of_few_sizes(spark):
    boxes = [(k, float(k), k + 0.9, 0.0, 0.9) for k in range(500)]
    z = spark.createDataFrame(boxes, "z int, west double, east double, south double, north double")
    p = spark.createDataFrame([(k, k + 0.5, 0.5) for k in range(500)], "p int, x double, y double")
    assert sorted((r.p, r.z) for r in zones.zone_join(p, z, "x", "y").collect()) == [(k, k) for k in range(500)]
    assert z.select(zones._size(z.east - z.west).alias("k")).distinct().count() == 1
