"""Surfaces made ready for routing: depressions filled, mapped lines cut in.

Filling depends on a global order of cells, which no window or join expresses. `fill` floods each tile
by itself, finds how the borders of tiles spill into each other, and floods again from the levels of
the borders (Barnes, 2016). Borders are put together region by region, so no layer's meet in one task.
What follows is in flow.py.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.lineage import written

_OFFSETS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def _rise(z: np.ndarray, start: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Levels and labels of a flood from start cells (level, cell, label).

    NaN is nodata; cells that no start reaches keep a level of infinity and label -1. Of two starts on a cell the lower holds.
    """
    rows, cols = z.shape
    wide = cols + 2  # a frame of nodata, so that every neighbour is a place in the lists
    padded = np.full((rows + 2, wide), np.nan)
    padded[1:-1, 1:-1] = z
    flat = padded.ravel()
    known, flat = np.isfinite(flat).tolist(), flat.tolist()
    level, label = [math.inf] * len(flat), [-1] * len(flat)
    queue = []
    for h, cell, name in start:
        at = (cell // cols + 1) * wide + cell % cols + 1
        if h < level[at]:
            level[at], label[at], known[at] = h, name, False
            queue.append((h, at))
    heapq.heapify(queue)
    jumps = [r * wide + c for r, c in _OFFSETS]
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        h, cell = pop(queue)
        if h > level[cell]:
            continue
        own, pit = label[cell], [cell]  # what lies no higher is flooded at once, without the queue
        while pit:
            cell = pit.pop()
            for j in jumps:
                near = cell + j
                if known[near]:
                    known[near], label[near] = False, own
                    v = flat[near]
                    if v > h:
                        level[near] = v
                        push(queue, (v, near))
                    else:
                        level[near] = h
                        pit.append(near)
    inner = lambda a: np.array(a).reshape(rows + 2, wide)[1:-1, 1:-1]
    return inner(level), inner(label)


def _spanning(a: np.ndarray, b: np.ndarray, w: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Edges of a least spanning forest of the edges (a, b, w), as their numbers, and such a forest of its marked nodes.

    Where two parts that hold marked nodes meet, an edge of the second forest joins one of each: the least
    highest edge between any two marked nodes stays what it was (Kruskal).
    """
    by = np.argsort(w, kind="stable")
    up, mark = list(range(len(end))), np.where(end, np.arange(len(end)), -1).tolist()
    kept, joined = [], []
    for k, x, y, h in zip(by.tolist(), a[by].tolist(), b[by].tolist(), w[by].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x == y:
            continue
        kept.append(k)
        up[x] = y
        if mark[y] < 0:
            mark[y] = mark[x]
        elif mark[x] >= 0:
            joined.append((mark[x], mark[y], h))
    return np.array(kept, np.int64), joined


def _grid(t: pa.Table, tile: int) -> tuple[np.ndarray, int, int]:
    """A tile's cells as an array, with the row and column of its corner."""
    row, col = t["row"].to_numpy(), t["col"].to_numpy()
    r0, c0 = int(row[0]) // tile * tile, int(col[0]) // tile * tile
    z = np.full((tile, tile), np.nan)
    z[row - r0, col - c0] = t["value"].to_numpy()
    return z, r0, c0


def _border(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a tile's border that have a value, and inner cells beside nodata."""
    known = np.isfinite(z)
    edge = np.zeros(z.shape, bool)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    padded = np.pad(known, 1, constant_values=True)
    whole = np.logical_and.reduce([padded[1 + r : 1 + r + z.shape[0], 1 + c : 1 + c + z.shape[1]] for r, c in _OFFSETS])
    return np.flatnonzero(known & edge), np.flatnonzero(known & ~edge & ~whole)



#: A region of a step of the way up is so many regions of the step before wide and high.
_REGIONS = 8
_EDGE = ["row", "col", "row2", "col2", "level"]


def _meets(level: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of neighbouring cells that differ, and the level at which they meet."""
    n, m = level.shape
    parts = []
    for r, c in ((0, 1), (1, 0), (1, 1), (1, -1)):
        one, two = np.s_[: n - r, max(0, -c) : m - max(0, c)], np.s_[r:, max(0, c) : m - max(0, -c)]
        a, b = label[one].ravel(), label[two].ravel()
        apart = (a != b) & (a >= 0) & (b >= 0)
        parts.append((a[apart], b[apart], np.maximum(level[one].ravel(), level[two].ravel())[apart]))
    a, b, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    return a, b, w


def _nodes(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (row << 32 | col) of edges in order, and the places of both ends among them; an end without a row is the outside, placed after all."""
    cell = lambda r, c: t[r].fillna(0).to_numpy(np.int64) << 32 | t[c].fillna(0).to_numpy(np.int64) & 0xFFFFFFFF
    a, b, out = cell("row", "col"), cell("row2", "col2"), t["row2"].isna().to_numpy()
    names = np.unique(np.concatenate([a, b[~out]]))
    return names, np.searchsorted(names, a), np.where(out, len(names), np.searchsorted(names, b))


def _places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (names >> 32).astype(np.int32), (names & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def _levels(graph: DataFrame, rim: DataFrame, tile: int, kind: str) -> DataFrame:
    """layer, row, col, level: the least level at which each border cell drains, by the path whose highest edge is lowest.

    graph: edges (layer, row, col, row2, col2, level) between border cells; null: to the outside. rim: border cells that drain by themselves
    (layer, row, col, level), which are no ends of edges. On the way up each region keeps a spanning forest of
    its edges and hands on one of the cells at its border, until one region is left; on the way down levels
    of the border give those inside. A region's task holds cells along the borders of 8 by 8 smaller regions.
    """
    lo_r, hi_r, lo_c, hi_c = graph.agg(F.min("row"), F.max(F.greatest("row", "row2")), F.min(F.least("col", "col2")), F.max(F.greatest("col", "col2"))).first()
    if lo_r is None:
        return rim
    lo_r, lo_c = lo_r // tile * tile, lo_c // tile * tile
    sizes = [tile * _REGIONS]
    while max(hi_r - lo_r, hi_c - lo_c) >= sizes[-1]:
        sizes.append(sizes[-1] * _REGIONS)
    region = lambda c, lo, size: F.floor((F.col(c) - lo) / size)

    def gate(row, col, size):
        if size == sizes[-1]:
            return row != row
        r, c = (row - lo_r) % size, (col - lo_c) % size
        return (r == 0) | (r == size - 1) | (c == 0) | (c == size - 1)

    def contract(size: int):
        def work(t: pd.DataFrame) -> pd.DataFrame:
            names, a, b = _nodes(t)
            row, col = _places(names)
            w = t["level"].to_numpy()
            kept, joined = _spanning(a, b, w, np.append(gate(row, col, size), size != sizes[-1]))
            one, two, high = (np.array(x) for x in zip(*joined, strict=True)) if joined else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            one, two = np.minimum(one, two), np.maximum(one, two)  # the outside comes last
            a, b, w = np.concatenate([a[kept], one]), np.concatenate([b[kept], two]), np.concatenate([w[kept], high])
            inside = b < len(names)
            b = np.where(inside, b, 0)
            second = lambda x: pd.array(x[b], "Int32") if inside.all() else pd.Series(x[b], dtype="Int32").where(inside)
            return pd.DataFrame({"layer": t["layer"].iloc[0], "up": np.arange(len(a)) >= len(kept), "row": row[a], "col": col[a], "row2": second(row), "col2": second(col), "level": w})

        return work

    trees = []
    for size in sizes:
        of = [region(c, lo, size) for c, lo in (("row", lo_r), ("col", lo_c))]
        to = [F.coalesce(region(c, lo, size), r) for c, lo, r in (("row2", lo_r, of[0]), ("col2", lo_c, of[1]))]
        marked = graph.withColumns({"rr": of[0], "rc": of[1], "_in": (of[0] == to[0]) & (of[1] == to[1])})
        done = written(marked.where("_in").groupBy("layer", "rr", "rc").applyInPandas(contract(size), f"layer {kind}, up boolean, row int, col int, row2 int, col2 int, level double"))
        trees.append(done.where("not up").select("layer", *_EDGE))
        graph = done.where("up").select("layer", *_EDGE).union(marked.where("not _in").select("layer", *_EDGE))

    def settle(size: int):
        def work(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({"layer": [], "row": np.zeros(0, np.int32), "col": np.zeros(0, np.int32), "level": np.zeros(0)})
            if not len(t):
                return empty
            names, a, b = _nodes(t)
            w = t["level"].to_numpy()
            beside: list[list[tuple[int, float]]] = [[] for _ in range(len(names) + 1)]
            for x, y, h in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
                beside[x].append((y, h))
                beside[y].append((x, h))
            level = [math.inf] * len(beside)
            level[-1] = -math.inf
            known = s["row"].to_numpy(np.int64) << 32 | s["col"].to_numpy(np.int64) & 0xFFFFFFFF
            at = np.minimum(np.searchsorted(names, known), max(0, len(names) - 1))
            for x, ok, h in zip(at.tolist(), (names[at] == known).tolist(), s["level"].tolist(), strict=True):
                if ok:
                    level[x] = h
            queue = [(h, x) for x, h in enumerate(level) if h < math.inf]
            heapq.heapify(queue)
            while queue:
                h, x = heapq.heappop(queue)
                if h > level[x]:
                    continue
                for y, high in beside[x]:
                    new = high if high > h else h
                    if new < level[y]:
                        level[y] = new
                        heapq.heappush(queue, (new, y))
            row, col = _places(names)
            new = ~gate(row, col, size)
            return pd.DataFrame({"layer": t["layer"].iloc[0], "row": row[new], "col": col[new], "level": np.array(level[:-1])[new]}) if new.any() else empty

        return work

    solved = rim.where("false")
    for size, tree in zip(reversed(sizes), reversed(trees), strict=True):
        of = {"rr": region("row", lo_r, size), "rc": region("col", lo_c, size)}
        by = ["layer", "rr", "rc"]
        ends = solved.where(gate(F.col("row"), F.col("col"), size))
        new = tree.withColumns(of).groupBy(*by).cogroup(ends.withColumns(of).groupBy(*by)).applyInPandas(settle(size), f"layer {kind}, row int, col int, level double")
        solved = solved.union(written(new))
    return solved.union(rim)


def fill(cells: DataFrame, tile: int = 512) -> DataFrame:
    """layer, row, col, filled: the surface of (layer, row, col, value) with every depression filled to where it spills.

    Water leaves over the edge of the grid and into nodata (null or missing cells); cells without a value
    are absent. Tiles of tile by tile cells are flooded in parallel, twice; between, the levels of the tiles'
    borders are found by regions that grow from step to step, so the last task holds cells as the side of a layer, not its area.
    """
    kind = dict(cells.dtypes)["layer"]
    known = cells.where("value is not null").select("layer", "row", "col", F.col("value").cast("double").alias("value"), F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))

    def spill(t: pa.Table) -> pa.Table:
        z, r0, c0 = _grid(t, tile)
        edge, leak = _border(z)
        flat, outside = z.ravel(), tile * tile
        level, label = _rise(z, [(flat[x], int(x), int(x)) for x in edge] + [(flat[x], int(x), outside) for x in leak])
        a, b, w = _meets(level, label)
        end = np.zeros(outside + 1, bool)
        end[edge], end[outside] = True, True
        kept, _ = _spanning(a, b, w, end)
        a, b, w = np.minimum(a, b)[kept], np.maximum(a, b)[kept], w[kept]  # the outside comes second
        padded = np.pad(np.isfinite(z), 1)
        around = sum(padded[1 + r : 1 + r + tile, 1 + c : 1 + c + tile].astype(int) for r, c in _OFFSETS).ravel()
        first, second = np.concatenate([edge, a]), np.concatenate([np.full(len(edge), outside), b])
        none, inner = second == outside, np.arange(len(first)) >= len(edge)
        whole = lambda x, mask=None: pa.array(x, pa.int32(), mask=mask)
        return pa.table(
            {
                "layer": pa.repeat(t["layer"][0], len(first)), "row": whole(r0 + first // tile), "col": whole(c0 + first % tile), "row2": whole(r0 + second // tile, none), "col2": whole(c0 + second % tile, none),
                "level": np.concatenate([flat[edge], w]), "around": whole(np.concatenate([around[edge], np.zeros(len(a), int)]), inner),
            }
        )

    schema = f"layer {kind}, row int, col int, row2 int, col2 int, level double, around int"
    found = written(known.groupBy("layer", "tr", "tc").applyInArrow(spill, schema))
    border = found.where("around is not null").select("layer", "row", "col", F.col("level").alias("z"), "around")
    tile_of = lambda c: F.floor(F.col(c) / tile)
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in _OFFSETS]))

    def across(these: DataFrame, *more: str) -> DataFrame:
        """Neighbours in different tiles, both ways."""
        near = these.select("layer", F.col("row").alias("row2"), F.col("col").alias("col2"), *[F.col(c).alias(f"{c}2") for c in more], steps.alias("o"))
        near = near.withColumns({"row": F.col("row2") + F.col("o.r"), "col": F.col("col2") + F.col("o.c")}).drop("o")
        near = near.where((tile_of("row") != tile_of("row2")) | (tile_of("col") != tile_of("col2")))
        return these.join(near, ["layer", "row", "col"])

    beyond = across(border.select("layer", "row", "col")).groupBy("layer", "row", "col").agg(F.count("*").alias("n"))
    border = border.join(beyond, ["layer", "row", "col"], "left")
    border = written(border.select("layer", "row", "col", "z", (F.col("around") + F.coalesce("n", F.lit(0)) < 8).alias("rim")))
    rim = border.where("rim").select("layer", "row", "col", F.col("z").alias("level"))
    # water that reaches the rim is outside: an edge to a cell of the rim is one to the outside
    pairs = across(border, "z", "rim").where("not rim and (rim2 or struct(row, col) < struct(row2, col2))")
    pairs = pairs.select("layer", "row", "col", *[F.when(~F.col("rim2"), F.col(c)).alias(c) for c in ("row2", "col2")], F.greatest("z", "z2").alias("level"))
    inner = found.where("around is null").select("layer", *_EDGE)
    at = lambda r, c: rim.select("layer", F.col("row").alias(r), F.col("col").alias(c), F.lit(True).alias(f"{r}_rim"))
    inner = inner.join(at("row", "col"), ["layer", "row", "col"], "left").join(at("row2", "col2"), ["layer", "row2", "col2"], "left")
    gone, gone2 = F.col("row_rim").isNotNull(), F.col("row2_rim").isNotNull() | F.col("row2").isNull()
    turned = [F.when(gone, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("row", "row2"), ("col", "col2"))]
    inner = inner.where(~(gone & gone2)).select("layer", *turned, *[F.when(~gone & ~gone2, F.col(c)).alias(c) for c in ("row2", "col2")], "level")
    solved = _levels(written(pairs.union(inner)), rim, tile, kind)
    solved = solved.withColumns({"tr": tile_of("row"), "tc": tile_of("col")})

    def raised(t: pa.Table) -> pa.Table:
        solved = t["level"].is_valid()
        border = t.filter(solved)
        z, r0, c0 = _grid(t.filter(pc.invert(solved)), tile)
        flat = z.ravel()
        _, leak = _border(z)
        cell = (border["row"].to_numpy() - r0) * tile + border["col"].to_numpy() - c0
        level, _ = _rise(z, [(h, x, 0) for h, x in zip(border["level"].to_pylist(), cell.tolist(), strict=True)] + [(flat[x], int(x), 0) for x in leak])
        at = np.flatnonzero(np.isfinite(flat))
        return pa.table({"layer": pa.repeat(t["layer"][0], len(at)), "row": pa.array(r0 + at // tile, pa.int32()), "col": pa.array(c0 + at % tile, pa.int32()), "filled": level.ravel()[at]})

    none = F.lit(None).cast("double")
    both = known.withColumn("level", none).unionByName(solved.withColumn("value", none))
    return both.groupBy("layer", "tr", "tc").applyInArrow(raised, f"layer {kind}, row int, col int, filled double")


def burn(cells: DataFrame, paths: DataFrame, depth_m: float = 20.0, drop_m: float = 0.05) -> DataFrame:
    """layer, row, col, value of (layer, row, col, value) with mapped lines cut in: paths (layer, line, seq, row, col), cells in order.

    Every cell on a line is lowered by depth_m; then each line descends from its lower end by at least
    drop_m a cell. Lines don't wait for each other: where they share a cell, the lowest holds. Cells off
    all lines, and all cells if no line meets a value, stay as they are.
    """
    on = paths.select("layer", "line", "seq", "row", "col").join(cells.where("value is not null"), ["layer", "row", "col"])
    on = on.withColumn("z", F.col("value") - depth_m)
    whole = Window.partitionBy("layer", "line")
    ends = on.select("layer", "line", "seq", "row", "col", "z", F.max_by("z", "seq").over(whole).alias("last"), F.min_by("z", "seq").over(whole).alias("first"))
    ends = ends.withColumn("k", F.when(F.col("first") > F.col("last"), -F.col("seq")).otherwise(F.col("seq")))
    down = Window.partitionBy("layer", "line").orderBy("k")  # a line's cells, sorted in one task
    step = F.row_number().over(down) * drop_m
    carved = ends.select("layer", "line", "row", "col", "k", step.alias("fall"), "z").withColumn("low", F.min(F.col("z") + F.col("fall")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    low = carved.groupBy("layer", "row", "col").agg(F.min(F.col("low") - F.col("fall")).alias("low"))
    return cells.join(low, ["layer", "row", "col"], "left").select("layer", "row", "col", F.coalesce("low", "value").alias("value"))
