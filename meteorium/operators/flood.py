"""Sea-connected flood levels on a cell grid.

A cell floods at water level w when a 4-neighbour path leads to it from a sea seed with every cell below w.  The
``connect`` level of a cell is therefore the least, over all such paths, of the highest cell on the path; one solution
answers every water level.

The grid is cut into square tiles.  Each tile is contracted once to a graph between its edge cells that keeps the least
highest level between any two of them.  Tiles come together ``JOIN`` by ``JOIN``: their graphs and the steps across their
common edges are contracted to the outer edge of the square, and so on until one square is left.  The levels found there
go down again, square by square, to the edges of the tiles, and each tile is filled once.  A graph of a square follows the
length of its edges, not its number of cells, so the one graph at the top grows with the side of the grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

#: The node that all seeds hang on, and the number of squares that come together along each side.
SEA, JOIN = -1, 4

_EDGE = "sx bigint, sy bigint, a bigint, b bigint, w double"
_NODE = "node bigint, v double"


def nearest_root(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``n`` nodes the root it reaches by the lowest pass, the height of that pass, and the edges of the forest.

    All components without a root hook on by their lowest edge at once, round by round.  Hook heights fall along a chain of
    hooks, so the pass from a node is the highest hook on its way.  Nodes without a way keep a component that is no root.
    """
    order = np.argsort(w, kind="stable")
    ca, cb, height, number = a[order], b[order], w[order], order
    comp, up, used = np.arange(n), np.full(n, -np.inf), []
    while True:
        live = (ca != cb) & ~(root[ca] & root[cb])
        ca, cb, height, number = ca[live], cb[live], height[live], number[live]
        if not len(ca):
            return comp, up, np.unique(np.concatenate(used)) if used else np.zeros(0, dtype=np.int64)
        at, none = np.arange(len(ca)), len(ca)
        low, other = np.full(n, none), np.full(n, none)
        low[ca[::-1]], other[cb[::-1]] = at[::-1], at[::-1]  # the last to be written is the lowest edge
        low = np.minimum(low, other)
        hooks = np.flatnonzero((low < none) & ~root)
        edge = low[hooks]
        parent, off = np.arange(n), np.full(n, -np.inf)
        parent[hooks], off[hooks] = np.where(ca[edge] == hooks, cb[edge], ca[edge]), height[edge]
        used.append(number[edge])
        both = hooks[(parent[parent[hooks]] == hooks) & (hooks < parent[hooks])]  # two that chose the same edge
        parent[both], off[both] = both, -np.inf
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            off, parent = np.maximum(off, off[parent]), further
        up, comp = np.maximum(up, off[comp]), parent[comp]
        ca, cb = parent[ca], parent[cb]


def contract(a: np.ndarray, b: np.ndarray, w: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest between the nodes for which ``keep`` holds, with the lowest pass between any two of them as before.

    Every node goes to the kept node it reaches by the lowest pass; an edge between the regions of two kept nodes stands for
    the way over it.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib, kept = at[:len(a)], at[len(a):], keep(nodes)
    home, up, _ = nearest_root(len(nodes), ia, ib, w, kept)
    u, v, height = home[ia], home[ib], np.maximum(w, np.maximum(up[ia], up[ib]))
    between = (u != v) & kept[u] & kept[v]
    u, v, height = u[between], v[between], height[between]
    _, _, forest = nearest_root(len(nodes), u, v, height, np.zeros(len(nodes), dtype=bool))
    return nodes[u[forest]], nodes[v[forest]], height[forest]


def levels(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that the sea reaches and their levels."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sea = nodes == SEA
    home, up, _ = nearest_root(len(nodes), at[:len(a)], at[len(a):], w, sea)
    there = sea[home] & ~sea
    return nodes[there], up[there]


def _steps(elev: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between neighbouring cells of a square; cells without a height (NaN) are walls."""
    a = np.concatenate([ids[:, :-1].ravel(), ids[:-1].ravel()])
    b = np.concatenate([ids[:, 1:].ravel(), ids[1:].ravel()])
    w = np.concatenate([np.maximum(elev[:, :-1], elev[:, 1:]).ravel(), np.maximum(elev[:-1], elev[1:]).ravel()])
    open_ = ~np.isnan(w)
    return a[open_], b[open_], w[open_]


def _square(size: int, places, elevations) -> np.ndarray:
    """Heights of a tile; of rows for the same cell the lowest counts."""
    flat, heights, places = np.full(size * size, np.nan), np.asarray(elevations, dtype=float), np.asarray(places, dtype=np.int64)
    order = np.argsort(-heights, kind="stable")
    order = order[~np.isnan(heights[order])]
    flat[places[order]] = heights[order]
    return flat.reshape(size, size)


def contract_tile(size: int, places, elevations, seeds) -> tuple[np.ndarray, ...]:
    """Graph of a tile between its edge cells and the sea, by place in the tile, and the edge cells with their heights."""
    elev = _square(size, places, elevations)
    a, b, w = _steps(elev, np.arange(size * size).reshape(size, size))
    seeds = np.unique(np.asarray(seeds, dtype=np.int64))
    flat = elev.ravel()
    a, b, w = np.concatenate([a, np.full(len(seeds), SEA)]), np.concatenate([b, seeds]), np.concatenate([w, flat[seeds]])
    row, col = np.divmod(np.arange(size * size), size)
    rim = (row == 0) | (row == size - 1) | (col == 0) | (col == size - 1)
    edge = np.flatnonzero(rim & ~np.isnan(flat))
    return *contract(a, b, w, lambda nodes: (nodes == SEA) | rim[nodes]), edge, flat[edge]


def fill_tile(size: int, places, elevations, seeds, at, inflow) -> np.ndarray:
    """Connect level of each row of a tile, given the levels of its edge cells; NaN where the sea does not come."""
    elev = _square(size, places, elevations)
    a, b, w = _steps(elev, np.arange(size * size).reshape(size, size))
    seeds, at = np.unique(np.asarray(seeds, dtype=np.int64)), np.asarray(at, dtype=np.int64)
    wet, level = levels(np.concatenate([a, np.full(len(seeds) + len(at), SEA)]), np.concatenate([b, seeds, at]),
                        np.concatenate([w, elev.ravel()[seeds], np.asarray(inflow, dtype=float)]))
    flat = np.full(size * size, np.nan)
    flat[wet] = level
    out = flat[np.asarray(places, dtype=np.int64)]
    out[np.isnan(np.asarray(elevations, dtype=float))] = np.nan
    return out


def _tiles(cells: DataFrame, x: str, y: str, elevation: str, seed: Column, size: int, x0: int, y0: int) -> DataFrame:
    """One row per tile (at most size * size cells): the rows themselves, and the places, heights and seeds among them."""
    px, py = (F.col(x) - x0).cast("bigint"), (F.col(y) - y0).cast("bigint")
    cell = F.struct(F.struct(*cells.columns).alias("row"), (F.pmod(py, F.lit(size)) * size + F.pmod(px, F.lit(size))).cast("int").alias("p"),
                    F.col(elevation).cast("double").alias("e"), F.coalesce(seed, F.lit(False)).alias("s"))
    c = F.col("_c")
    return (cells.groupBy(F.floor(px / size).alias("tx"), F.floor(py / size).alias("ty")).agg(F.collect_list(cell).alias("_c"))
            .select("tx", "ty", c["row"].alias("rows"), c["p"].alias("places"), c["e"].alias("elevations"),
                    F.transform(F.filter(c, lambda v: v["s"]), lambda v: v["p"]).alias("seeds")))


def connect_levels(cells: DataFrame, x: str = "x", y: str = "y", elevation: str = "elevation",
                   seed_level: float = 0.0, size: int = 256, name: str = "connect") -> DataFrame:
    """Add the connect level of every cell; cells the sea cannot reach are left out.

    Seeds are the cells of the westernmost column and the southernmost row (largest y) at or below ``seed_level``.
    """
    span = cells.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if span[0] is None or span[2] is None:
        return cells.withColumn(name, F.lit(None).cast("double")).filter(F.lit(False))
    west, east, north, south = (int(v) for v in span)
    x0, y0 = west // size * size, north // size * size
    across, down = (east - x0) // size + 1, (south - y0) // size + 1
    width, height = across * size, 0
    while JOIN ** height < max(across, down):
        height += 1
    seed = ((F.col(x) == west) | (F.col(y) == south)) & (F.col(elevation) <= seed_level)
    located = cells.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    tiles = materialize(_tiles(located, x, y, elevation, seed, size, x0, y0))
    even = spread(tiles, ["tx", "ty"], 4 * across * down)  # more tasks than tiles, so few tiles share one
    inflow = _edge_levels(even, size, width, height) if height else None

    if inflow is None:
        full = even.withColumns({"at": F.array().cast("array<int>"), "v": F.array().cast("array<double>")})
    else:
        nx, ny = F.pmod("node", F.lit(width)), F.floor(F.col("node") / width)
        place = (F.pmod(ny, F.lit(size)) * size + F.pmod(nx, F.lit(size))).cast("int")
        packed = inflow.groupBy(F.floor(nx / size).alias("tx"), F.floor(ny / size).alias("ty")).agg(F.collect_list(F.struct(place.alias("p"), "v")).alias("_m"))
        full = tiles.join(packed, ["tx", "ty"], "left").withColumns({
            "at": F.coalesce(F.col("_m")["p"], F.array().cast("array<int>")), "v": F.coalesce(F.col("_m")["v"], F.array().cast("array<double>"))})
        full = spread(full.drop("_m"), ["tx", "ty"], 4 * across * down)

    @F.pandas_udf("array<double>")
    def fill(places: pd.Series, elevations: pd.Series, seeds: pd.Series, at: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([fill_tile(size, *row) for row in zip(places, elevations, seeds, at, v)])

    solved = full.select("rows", fill("places", "elevations", "seeds", "at", "v").alias("_level"))
    each = solved.select(F.explode(F.arrays_zip(F.col("rows").alias("row"), F.col("_level").alias("level"))).alias("_z"))
    return each.select("_z.row.*", F.col("_z.level").alias(name)).filter(F.col(name).isNotNull() & ~F.isnan(name))


def _edge_levels(tiles: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """node and level of the edge cells of all tiles that the sea reaches; a node is row * width + column."""

    @F.pandas_udf("struct<a: array<bigint>, b: array<bigint>, w: array<double>, at: array<bigint>, e: array<double>>")
    def graph(tx: pd.Series, ty: pd.Series, places: pd.Series, elevations: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        made = []
        for c, r, *row in zip(tx, ty, places, elevations, seeds):
            a, b, w, edge, e = contract_tile(size, *row)
            nodes = [np.where(p == SEA, SEA, (r * size + p // size) * width + c * size + p % size) for p in (a, b, edge)]
            made.append((nodes[0], nodes[1], w, nodes[2], e))
        return pd.DataFrame(made, columns=["a", "b", "w", "at", "e"])

    graphs = materialize(tiles.select("tx", "ty", graph("tx", "ty", "places", "elevations", "seeds").alias("g")).select("tx", "ty", "g.*"))
    inner = graphs.select("tx", "ty", F.explode(F.arrays_zip("a", "b", "w")).alias("z")).select("tx", "ty", "z.*")
    border = graphs.select(F.explode(F.arrays_zip("at", "e")).alias("z")).select(F.col("z.at").alias("at"), F.col("z.e").alias("e"))
    col, row = F.pmod("at", F.lit(width)), F.floor(F.col("at") / width)
    ahead = border.filter(F.pmod(col, F.lit(size)) == size - 1).filter(col < width - 1).withColumn("next", F.col("at") + 1)
    below = border.filter(F.pmod(row, F.lit(size)) == size - 1).withColumn("next", F.col("at") + width)
    facing = border.select(F.col("at").alias("next"), F.col("e").alias("e2"))
    tile_x, tile_y = F.floor(col / size), F.floor(row / size)
    far_x, far_y = F.floor(F.pmod("next", F.lit(width)) / size), F.floor(F.floor(F.col("next") / width) / size)
    meet = F.lit(height)
    for k in range(height - 1, 0, -1):  # the first square that holds both tiles
        s = JOIN ** k
        meet = F.when((F.floor(tile_x / s) == F.floor(far_x / s)) & (F.floor(tile_y / s) == F.floor(far_y / s)), k).otherwise(meet)
    cross = materialize(ahead.unionByName(below).join(facing, "next").select(
        meet.alias("meet"), tile_x.alias("tx"), tile_y.alias("ty"), F.col("at").alias("a"), F.col("next").alias("b"), F.greatest("e", "e2").alias("w")))

    def in_squares(df: DataFrame, k: int, tx: Column, ty: Column) -> DataFrame:
        s = JOIN ** k
        return df.select(F.floor(tx / s).alias("sx"), F.floor(ty / s).alias("sy"), *[c for c in df.columns if c not in ("tx", "ty", "sx", "sy", "meet")])

    def contracted(k: int):
        side = size * JOIN ** k

        def run(table: pa.Table) -> pa.Table:
            a, b, w = (table[c].to_numpy() for c in "abw")
            def rim(nodes: np.ndarray) -> np.ndarray:
                r, c = nodes // width % side, nodes % width % side
                return (nodes == SEA) | (r == 0) | (r == side - 1) | (c == 0) | (c == side - 1)
            a, b, w = contract(a, b, w, rim)
            sx, sy = (pa.array(np.full(len(a), table[c][0].as_py(), dtype=np.int64)) for c in ("sx", "sy"))
            return pa.table({"sx": sx, "sy": sy, "a": a, "b": b, "w": w})
        return run

    def solved(edges: pa.Table, known: pa.Table) -> pa.Table:
        a, b, w = (edges[c].to_numpy() for c in "abw")
        node, v = known["node"].to_numpy(), known["v"].to_numpy()
        node, v = levels(np.concatenate([a, np.full(len(node), SEA)]), np.concatenate([b, node]), np.concatenate([w, v]))
        return pa.table({"node": node, "v": v})

    here = in_squares(inner, 1, F.col("tx"), F.col("ty"))
    squares = []
    for k in range(1, height + 1):
        joined = materialize(here.unionByName(in_squares(cross.filter(F.col("meet") == k), k, F.col("tx"), F.col("ty"))))
        squares.append(joined)
        if k < height:
            up = materialize(joined.groupBy("sx", "sy").applyInArrow(contracted(k), _EDGE))
            here = up.withColumns({"sx": F.floor(F.col("sx") / JOIN), "sy": F.floor(F.col("sy") / JOIN)})
    known = squares[-1].sparkSession.createDataFrame([], _NODE)
    for k in range(height, 0, -1):
        s = size * JOIN ** k
        placed = known.select(F.floor(F.pmod("node", F.lit(width)) / s).alias("sx"), F.floor(F.floor(F.col("node") / width) / s).alias("sy"), "node", "v")
        known = materialize(squares[k - 1].groupBy("sx", "sy").cogroup(placed.groupBy("sx", "sy")).applyInArrow(solved, _NODE))
    return known


def flooded(connected: DataFrame, water: float, name: str = "connect") -> DataFrame:
    """Cells under water at one level (strict)."""
    return connected.filter(F.col(name) < water)


def newly_flooded(connected: DataFrame, water: float, base: float = 0.01, name: str = "connect") -> DataFrame:
    """Cells under water at ``water`` that are not sea at the base level."""
    return connected.filter((F.col(name) < water) & ~(F.col(name) < base))


def level_counts(connected: DataFrame, levels_cm: list[int], extra: dict[str, Column] | None = None,
                 base: float = 0.01, name: str = "connect") -> DataFrame:
    """Newly flooded cells per water level, all levels in one aggregation.

    Each cell counts from the first level above its connect level on, so cells are summed per first level and a running
    sum over the (fixed) list of levels finishes the job.
    """
    from pyspark.sql import Window
    levels = F.array(*[F.lit(int(c)) for c in sorted(levels_cm)])
    wet = (connected.filter(~(F.col(name) < base))
           .withColumn("_from", F.get(F.filter(levels, lambda c: F.col(name) < c / 100.0), F.lit(0)))
           .filter(F.col("_from").isNotNull()))
    sums = {"px": F.count(F.lit(1)), **(extra or {})}
    first = wet.groupBy("_from").agg(*[c.alias(n) for n, c in sums.items()])
    spine = connected.sparkSession.range(1).select(F.explode(levels).alias("level_cm"))
    w = Window.orderBy("level_cm").rowsBetween(Window.unboundedPreceding, 0)
    return (spine.join(first, F.col("level_cm") == F.col("_from"), "left")
            .select("level_cm", *[F.sum(F.coalesce(n, F.lit(0))).over(w).cast("bigint").alias(n) for n in sums]))
