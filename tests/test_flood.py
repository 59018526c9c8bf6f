import heapq
import itertools
import os

import numpy as np
import pytest

from meteorium.operators import flood


def brute(n, edges, roots):
    """Least highest edge from any root to each node."""
    near = {k: [] for k in range(n)}
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    level = dict.fromkeys(roots, -np.inf)
    heap = [(-np.inf, r) for r in roots]
    while heap:
        v, k = heapq.heappop(heap)
        if v > level[k]:
            continue
        for o, w in near[k]:
            if max(v, w) < level.get(o, np.inf):
                level[o] = max(v, w)
                heapq.heappush(heap, (level[o], o))
    return level


def graph(seed, n=40, m=90):
    rng = np.random.default_rng(seed)
    return rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 12, m).astype(float)


@pytest.mark.parametrize("seed", range(8))
def test_nearest_root_is_the_lowest_pass(seed):
    a, b, w = graph(seed)
    root = np.zeros(40, dtype=bool)
    root[np.random.default_rng(seed).choice(40, seed, replace=False)] = True
    home, up, _ = flood.nearest_root(40, a, b, w, root)
    want = brute(40, list(zip(a, b, w)), np.flatnonzero(root).tolist())
    assert {k: up[k] for k in range(40) if root[home[k]]} == want
    for k in range(40):  # the root that is named is reached at that height
        if root[home[k]]:
            assert brute(40, list(zip(a, b, w)), [int(home[k])])[k] == up[k]


@pytest.mark.parametrize("seed", range(8))
def test_contracted_graph_keeps_every_pass(seed):
    a, b, w = graph(seed)
    keep = np.random.default_rng(seed).choice(40, 12, replace=False)
    ca, cb, cw = flood.contract(a, b, w, lambda nodes: np.isin(nodes, keep))
    assert len(ca) <= 11 and set(ca) | set(cb) <= set(keep)
    for s in keep:
        before, after = brute(40, list(zip(a, b, w)), [int(s)]), brute(40, list(zip(ca, cb, cw)), [int(s)])
        assert {k: before.get(k) for k in keep} == {k: after.get(k) for k in keep}


def solve(cells):
    """Connect level of each cell by one flood over the whole grid; of rows for a cell the lowest counts."""
    elev = {}
    for x, y, e in cells:
        if x is not None and y is not None and e is not None and not np.isnan(e):
            elev[x, y] = min(e, elev.get((x, y), np.inf))
    west, south = min(x for x, _, _ in cells if x is not None), max(y for _, y, _ in cells if y is not None)
    level = {p: e for p, e in elev.items() if (p[0] == west or p[1] == south) and e <= 0}
    heap = [(e, p) for p, e in level.items()]
    heapq.heapify(heap)
    while heap:
        v, (x, y) = heapq.heappop(heap)
        if v > level[x, y]:
            continue
        for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if q in elev and max(v, elev[q]) < level.get(q, np.inf):
                level[q] = max(v, elev[q])
                heapq.heappush(heap, (level[q], q))
    return level


def grid(h, w, seed, x0=0, y0=0, holes=0.1):
    rng = np.random.default_rng(seed)
    elev = rng.integers(-8, 30, size=(h, w)) / 8
    elev[rng.random((h, w)) < holes] = np.nan
    elev[-1, : w // 3] = -1
    return [(c + x0, r + y0, float(elev[r, c])) for r in range(h) for c in range(w) if rng.random() > holes]


@pytest.mark.parametrize("h,w,size,x0,y0", [(20, 17, 32, 0, 0), (20, 17, 4, 0, 0), (23, 31, 2, -7, -40), (9, 40, 1, 3, 5), (40, 3, 3, 10**9, -10**9)])
def test_levels_equal_one_flood_over_the_grid(spark, h, w, size, x0, y0):
    cells = grid(h, w, h + size, x0, y0)
    df = spark.createDataFrame(cells, "x long, y long, elevation double")
    got = {(r.x, r.y): r.connect for r in flood.connect_levels(df, size=size).collect()}
    assert got == solve(cells) and len(got) > 10


def test_a_winding_channel_through_many_tiles(spark):
    elev = np.full((31, 31), 9.0)
    for r in range(0, 31, 2):
        elev[r, :] = r / 100
        if r:
            elev[r - 1, 30 if r % 4 == 2 else 0] = r / 100
    elev[0, 0] = -1
    cells = [(c, r, float(elev[r, c])) for r in range(31) for c in range(31)]
    got = {(r.x, r.y): r.connect for r in flood.connect_levels(spark.createDataFrame(cells, "x int, y int, elevation double"), size=3).collect()}
    assert got == solve(cells) and got[15, 30] == 0.3


def test_other_columns_and_repeated_cells_stay(spark):
    cells = [(0, 0, -1.0, "a"), (1, 0, 0.5, "b"), (1, 0, 0.2, "c"), (2, 0, None, "d"), (3, 0, 0.1, "e"), (None, 0, 0.0, "f"), (1, 1, 2.0, "g"), (2, 1, float("nan"), "h")]
    df = spark.createDataFrame(cells, "x int, y int, elevation double, rows string").selectExpr("*", "1 AS level", "2 AS p")
    for size in (1, 8):
        out = flood.connect_levels(df, size=size)
        assert out.columns == [*df.columns, "connect"]
        assert sorted((r.rows, r.connect) for r in out.collect()) == [("a", -1.0), ("b", 0.2), ("c", 0.2), ("g", 2.0)]


def test_no_cells_and_no_sea(spark):
    df = spark.createDataFrame([], "x int, y int, elevation double")
    assert flood.connect_levels(df).collect() == []
    dry = spark.createDataFrame([(x, y, 1.0) for x, y in itertools.product(range(9), range(9))], "x int, y int, elevation double")
    assert flood.connect_levels(dry, size=2).collect() == []


def test_each_tile_is_solved_twice_at_most_and_cells_are_not_joined(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "calls")

    def counted(name):
        inner = getattr(flood, name)

        def run(size, places, *rest):
            handle = os.open(log, os.O_APPEND | os.O_CREAT | os.O_WRONLY)
            os.write(handle, f"{name} {len(places)}\n".encode())
            os.close(handle)
            return inner(size, places, *rest)
        monkeypatch.setattr(flood, name, run)
    counted("contract_tile")
    counted("fill_tile")
    cells = grid(24, 24, 3, holes=0)
    out = flood.connect_levels(spark.createDataFrame(cells, "x int, y int, elevation double"), size=4)
    plan = out._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Join") == 1  # tiles with the levels of their edges
    assert len(out.collect()) == len(solve(cells))
    calls = open(log).read().split("\n")[:-1]
    assert len(calls) == 72 and sum(c.startswith("fill") for c in calls) == 36
