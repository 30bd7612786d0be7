"""Flow over a filled surface, by tiles: directions, upstream cells, streams, basins, height above drainage.

A cell drains to its steepest lower neighbour. On a flat it takes the neighbour with the least value of
twice the steps to where the flat drains, less the steps from higher ground (two gradients, after
Garbrecht and Martz, 1997). Tiles are rows of packed arrays. What crosses their borders is a table: steps
on flats go from tile to tile until none gets shorter, and the cells that drain into another tile form a
tree of their own, which carries counts and ends across tiles by doubling pointers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.lineage import written
from freshet.operators.network import accumulate, path_sums

OFFSETS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
_FAR = 1 << 30
_AT = ["layer", "tr", "tc"]


def _shifted(a: np.ndarray, k: int) -> np.ndarray:
    """The k-th neighbours of the inner cells of windows."""
    r, c = OFFSETS[k]
    return a[..., 1 + r : a.shape[-2] - 1 + r, 1 + c : a.shape[-1] - 1 + c]


def _windows(filled: DataFrame, tile: int) -> DataFrame:
    """layer, tr, tc, z: each tile with a frame of one cell, as bytes; NaN is nodata. A tile of the frame alone is left out."""
    kind = dict(filled.dtypes)["layer"]
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile).cast("int") for d in (-1, 0, 1)]))
    each = filled.select("layer", "row", "col", "filled", F.explode(near("row")).alias("tr")).select("*", F.explode(near("col")).alias("tc"))

    def pack(t: pa.Table) -> pa.Table:
        tr, tc = t["tr"][0].as_py(), t["tc"][0].as_py()
        z = np.full((tile + 2, tile + 2), np.nan)
        z[t["row"].to_numpy() - tr * tile + 1, t["col"].to_numpy() - tc * tile + 1] = t["filled"].to_numpy()
        out = pa.table({**{c: t[c].slice(0, 1) for c in _AT}, "z": pa.array([z.tobytes()], pa.binary())})
        return out if np.isfinite(z[1:-1, 1:-1]).any() else out.slice(0, 0)

    return each.groupBy(*_AT).applyInArrow(pack, f"layer {kind}, tr int, tc int, z binary")


def _steps(z: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Fewest steps over cells of one level from cells with a start value, those counted in; _FAR where there is no way.

    The frame only starts, it is never entered, so windows (window, row, col) don't meet.
    """
    wide = z.shape[-1]
    flat, out = z.ravel(), start.ravel().copy()
    inner = np.zeros(z.shape, bool)
    inner[..., 1:-1, 1:-1] = True
    inner = inner.ravel()
    jumps = [r * wide + c for r, c in OFFSETS]
    known = np.flatnonzero(out < _FAR)
    by = known[np.argsort(out[known], kind="stable")]
    values, edges = np.unique(out[by], return_index=True)
    edges = np.append(edges, len(by))
    at, front, d = 0, np.zeros(0, np.int64), 0
    while at < len(values) or len(front):
        d = int(values[at]) if not len(front) else d
        if at < len(values) and values[at] == d:
            new = by[edges[at] : edges[at + 1]]
            front = np.concatenate([front, new[out[new] == d]])
            at += 1
        reached = []
        for j in jumps:
            to = front + j
            ok = (to >= 0) & (to < out.size)
            a, to = front[ok], to[ok]
            ok = inner[to] & (flat[to] == flat[a]) & (out[to] > d + 1)
            out[to[ok]] = d + 1
            reached.append(to[ok])
        front, d = np.unique(np.concatenate(reached)), d + 1
    return out.reshape(z.shape)


def _flats(z: np.ndarray, low0: np.ndarray, high0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which inner cells drain at once, and for the windows the steps to such cells and from cells beside higher ground."""
    own = z[..., 1:-1, 1:-1]
    with np.errstate(invalid="ignore"):
        near = [_shifted(z, k) for k in range(8)]
        lower = np.logical_or.reduce([n < own for n in near])
        higher = np.logical_or.reduce([n > own for n in near])
        level = np.logical_or.reduce([n == own for n in near])
    rim = np.isfinite(own) & np.logical_or.reduce([np.isnan(n) for n in near])
    low, high = low0.copy(), high0.copy()
    low[..., 1:-1, 1:-1][lower | rim] = 0
    high[..., 1:-1, 1:-1][higher] = 0
    low[..., 1:-1, 1:-1][~level & (low[..., 1:-1, 1:-1] > 0)] = _FAR
    return lower, _steps(z, low), _steps(z, high)


#: Cells of the windows that a task works on at once.
_AT_ONCE = 1 << 18


def _few(batches, tile: int):
    """Batches cut into few tiles, as many as are held as Python rows or arrays at once."""
    few = max(1, _AT_ONCE // (tile + 2) ** 2)
    for b in batches:
        for lo in range(0, b.num_rows, few):
            yield b.slice(lo, few)


def _read(batches, tile: int):
    """Batches of few tiles with their windows and what the frames know of steps, as arrays (window, row, col)."""
    for b in _few(batches, tile):
        z = np.stack([np.frombuffer(x.as_buffer()) for x in b["z"]]).reshape(-1, tile + 2, tile + 2)
        low, high = np.full((2, *z.shape), _FAR, np.int64)
        of, frame = pc.list_parent_indices(b["frame"]).to_numpy(), pc.list_flatten(b["frame"])
        r, c = (pc.struct_field(frame, n).to_numpy() - b[t].to_numpy()[of] * tile + 1 for n, t in (("row", "tr"), ("col", "tc")))
        for steps, n in ((low, "low"), (high, "high")):
            steps[of, r, c] = pc.struct_field(frame, n).to_numpy()
        yield b, z, low, high


def _borders(tile: int):
    """Steps of the cells of a tile's border that have a neighbour of their level in another tile."""

    def work(batches):
        for b, z, low, high in _read(batches, tile):
            _, low, high = _flats(z, low, high)
            frame = np.ones(z.shape, bool)
            frame[..., 1:-1, 1:-1] = False
            across = np.logical_or.reduce([_shifted(frame, k) & (_shifted(z, k) == z[..., 1:-1, 1:-1]) for k in range(8)])
            of, r, c = np.nonzero(across)
            place = [b[t].to_numpy()[of] * tile + x for t, x in (("tr", r), ("tc", c))]
            yield pa.RecordBatch.from_arrays([b["layer"].take(pa.array(of)), *[pa.array(x, pa.int32()) for x in (*place, low[of, r + 1, c + 1], high[of, r + 1, c + 1])]], ["layer", "row", "col", "low", "high"])

    return work


def _framed(windows: DataFrame, steps: DataFrame | None, tile: int) -> DataFrame:
    """windows with frame: the steps that cells around each tile have."""
    if steps is None:
        return windows.withColumn("frame", F.lit(None).cast("array<struct<row:int,col:int,low:int,high:int>>"))
    near = steps
    for c, t in (("row", "tr"), ("col", "tc")):
        near = near.withColumn(t, F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile).cast("int") for d in (-1, 0, 1)]))))
    near = near.where((F.floor(F.col("row") / tile) != F.col("tr")) | (F.floor(F.col("col") / tile) != F.col("tc")))
    near = near.groupBy(*_AT).agg(F.collect_list(F.struct("row", "col", "low", "high")).alias("frame"))  # at most the frame of a tile
    return windows.join(near, _AT, "left")


def _directed(tile: int):
    """Direction of each cell of a tile (-1: water leaves, -2: nodata), and its place in the order of the way down."""

    def work(batches):
        for b, z, low, high in _read(batches, tile):
            lower, low, high = _flats(z, low, high)
            own = z[..., 1:-1, 1:-1]
            drop, code = np.zeros(own.shape), np.full(own.shape, -1, np.int8)
            with np.errstate(invalid="ignore"):
                for k, (r, c) in enumerate(OFFSETS):
                    fall = (own - _shifted(z, k)) / (1.0 if 0 in (r, c) else 2**0.5)
                    better = fall > drop
                    drop[better], code[better] = fall[better], k
                gradient = 2 * low - np.where(high < _FAR, high, 0)
                rim = np.logical_or.reduce([np.isnan(_shifted(z, k)) for k in range(8)])
                best = np.full(own.shape, np.iinfo(np.int64).max)
                level = ~lower & ~rim & np.isfinite(own)
                for k in range(8):
                    ok = level & (_shifted(z, k) == own) & (_shifted(low, k) < _FAR) & (_shifted(gradient, k) < best)
                    best[ok], code[ok] = _shifted(gradient, k)[ok], k
            code[np.isnan(own)] = -2
            rank = np.where(np.isfinite(own) & (low[..., 1:-1, 1:-1] < _FAR), gradient[..., 1:-1, 1:-1], 0)
            packed = [pa.array([x.tobytes() for x in a], pa.binary()) for a in (own, code, rank.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in _AT], *packed], [*_AT, "z", "code", "rank"])

    return work


def directions(filled: DataFrame, tile: int = 512) -> DataFrame:
    """Packed tiles (layer, tr, tc, z, code, rank) of the surface (layer, row, col, filled) of routing.fill.

    Cells without a row are nodata, water leaves into them and over the edge. No task holds more than a
    tile and its frame; a flat that lies over many tiles takes as many rounds as its ways cross tiles, and
    a round only computes tiles beside which something got shorter.
    """
    windows = written(_windows(filled, tile))
    kind = dict(filled.dtypes)["layer"]
    schema = f"layer {kind}, row int, col int, low int, high int"
    cell = ["layer", "row", "col"]
    known = written(_framed(windows, None, tile).mapInArrow(_borders(tile), schema))
    changed = known
    while not changed.isEmpty():
        beside = _framed(windows, changed, tile).where("frame is not null").select(*_AT)
        fresh = _framed(windows.join(beside, _AT, "left_semi"), known, tile).mapInArrow(_borders(tile), schema)
        least = fresh.groupBy(*cell).agg(F.min("low").alias("_low"), F.min("high").alias("_high"))
        both = written(known.join(least, cell, "left").select(*cell, F.least("low", "_low").alias("low"), F.least("high", "_high").alias("high"), ((F.col("_low") < F.col("low")) | (F.col("_high") < F.col("high"))).alias("_new")))
        known, changed = both.drop("_new"), both.where("_new").drop("_new")
    return written(_framed(windows, known, tile).mapInArrow(_directed(tile), f"layer {kind}, tr int, tc int, z binary, code binary, rank binary"))


class _Tile:
    """A packed tile: place of its corner, and for each cell the cell it drains to (-1: none in this tile)."""

    def __init__(self, row: dict, tile: int):
        self.r0, self.c0, self.tile = row["tr"] * tile, row["tc"] * tile, tile
        self.z, self.code = np.frombuffer(row["z"]), np.frombuffer(row["code"], np.int8)
        r, c = np.divmod(np.arange(tile * tile), tile)
        step = np.array([*OFFSETS, (0, 0)])[np.where(self.code >= 0, self.code, 8)]
        self.to_r, self.to_c = r + step[:, 0], c + step[:, 1]
        inside = (self.to_r >= 0) & (self.to_r < tile) & (self.to_c >= 0) & (self.to_c < tile)
        self.leaves = (self.code >= 0) & ~inside
        self.down = np.where((self.code >= 0) & inside, self.to_r * tile + self.to_c, -1)
        self.known = self.code > -2

    def place(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.r0 + cells // self.tile, self.c0 + cells % self.tile

    def sums(self, value: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of each cell and of all above it in the tile, in the order of the way down."""
        out, down = value.tolist(), self.down.tolist()
        for cell in np.lexsort((-rank, -self.z))[: int(self.known.sum())].tolist():
            if down[cell] >= 0:
                out[down[cell]] += out[cell]
        return np.array(out, np.int64)

    def ends(self, stop: np.ndarray) -> np.ndarray:
        """For each cell the first one on its way that stops, or the last one in the tile."""
        to = np.where(stop | (self.down < 0), np.arange(len(self.down)), self.down)
        while True:
            ahead = to[to]
            if (ahead == to).all():
                return to
            to = ahead

    def rim(self) -> np.ndarray:
        edge = np.zeros((self.tile, self.tile), bool)
        edge[[0, -1], :] = edge[:, [0, -1]] = True
        return np.flatnonzero(edge.ravel() & self.known)


def _links(tile: int, weight: Callable | None, stop: Callable | None):
    """Of each cell on a tile's border: where its way leaves the tile, what it carries, and where it is led to inside.

    kind 0: a cell that drains into another tile (row, col), the cell it drains to (row2, col2), and value,
    the sum of the weights above it in the tile. kind 1: a cell of the border and where its way ends in the
    tile: at a cell that leaves it (row2, col2), or with the label of a stop (value), or nowhere.
    """

    def work(batches):
        for b in _few(batches, tile):
            kind = b.schema.field("layer").type
            for row in b.to_pylist():
                t = _Tile(row, tile)
                total = t.sums(weight(t, row), np.frombuffer(row["rank"], np.int64)) if weight else None
                halt, label = stop(t, row) if stop else (np.zeros(len(t.down), bool), None)
                end = t.ends(halt)
                leave, rim = np.flatnonzero(t.leaves & ~halt), t.rim()
                # a cell that stops and leaves is an end, not a way across
                r, c = t.place(leave)
                parts = [(np.zeros(len(leave), np.int8), r, c, t.r0 + t.to_r[leave], t.c0 + t.to_c[leave], np.ones(len(leave), bool), total[leave].astype(float) if total is not None else np.zeros(len(leave)), np.ones(len(leave), bool))]
                e = end[rim]
                r, c = t.place(rim)
                r2, c2 = t.place(e)
                on = (t.leaves & ~halt)[e]
                value = label[e] if label is not None else np.zeros(len(e))
                parts.append((np.ones(len(rim), np.int8), r, c, r2, c2, on, value, halt[e]))
                kinds, r, c, r2, c2, ok, v, has = (np.concatenate(x) for x in zip(*parts, strict=True))
                null = lambda a, good, t: pa.array(a, t, mask=~good)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["layer"]] * len(r), kind), pa.array(kinds, pa.int8()), *[pa.array(x, pa.int32()) for x in (r, c)], null(r2, ok, pa.int32()), null(c2, ok, pa.int32()), null(v.astype(float), has, pa.float64())],
                    ["layer", "kind", "row", "col", "row2", "col2", "value"],
                )

    return work


_LINK = "layer {}, kind tinyint, row int, col int, row2 int, col2 int, value double"


def _tree(links: DataFrame) -> DataFrame:
    """id, next, value, label and at: cells that leave a tile, the next such cell on their way, and the label that ends it before."""
    out = links.where("kind = 0").select("layer", "row", "col", F.col("row2").alias("_r"), F.col("col2").alias("_c"), "value")
    led = links.where("kind = 1").select("layer", F.col("row").alias("_r"), F.col("col").alias("_c"), "row2", "col2", F.col("value").alias("label"))
    both = out.join(led, ["layer", "_r", "_c"])
    at = F.struct("layer", F.col("_r").alias("row"), F.col("_c").alias("col"))
    return both.select(F.struct("layer", "row", "col").alias("id"), F.when(F.col("row2").isNotNull(), F.struct("layer", F.col("row2").alias("row"), F.col("col2").alias("col"))).alias("next"), "value", "label", at.alias("at"))


def _by_tile(rows: DataFrame, tile: int, name: str, *values: str) -> DataFrame:
    """(layer, row, col, values) gathered for each tile: at most the cells of its border."""
    t = rows.withColumns({"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")})
    return t.groupBy(*_AT).agg(F.collect_list(F.struct("row", "col", *values)).alias(name))


def upstream(tiles: DataFrame, tile: int = 512) -> DataFrame:
    """The packed tiles with area: how many cells drain through each cell, itself included."""
    kind = dict(tiles.dtypes)["layer"]
    ones = lambda t, row: t.known.astype(np.int64)
    tree = written(_tree(tiles.mapInArrow(_links(tile, ones, None), _LINK.format(kind))))
    totals = accumulate(tree.select("id", "next", "value"), F.col("value"))
    entry = tree.select("id", "at").join(totals, "id").groupBy("at").agg(F.sum("total").alias("n")).select("at.*", "n")
    held = tiles.join(_by_tile(entry, tile, "inflow", "n"), _AT, "left")

    def count(batches):
        for b in _few(batches, tile):
            for row in b.to_pylist():
                t = _Tile(row, tile)
                own = t.known.astype(np.int64)
                for x in row["inflow"] or ():
                    own[(x["row"] - t.r0) * tile + x["col"] - t.c0] += int(x["n"])
                area = t.sums(own, np.frombuffer(row["rank"], np.int64))
                one = b.schema.field("layer").type
                yield pa.RecordBatch.from_arrays([pa.array([row["layer"]], one), *[pa.array([row[c]], pa.int32()) for c in ("tr", "tc")], *[pa.array([x], pa.binary()) for x in (row["z"], row["code"], row["rank"], area.tobytes())]], [*_AT, "z", "code", "rank", "area"])

    return written(held.mapInArrow(count, f"layer {kind}, tr int, tc int, z binary, code binary, rank binary, area binary"))


def route(filled: DataFrame, tile: int = 512) -> DataFrame:
    """Packed tiles with directions and upstream cells of a filled surface (layer, row, col, filled)."""
    return upstream(directions(filled, tile), tile)


def cells(tiles: DataFrame, tile: int = 512) -> DataFrame:
    """layer, row, col, filled, next_row, next_col (null: water leaves), area of every cell that has a value."""

    def unpack(batches):
        for b in _few(batches, tile):
            for row in b.to_pylist():
                t = _Tile(row, tile)
                at = np.flatnonzero(t.known)
                r, c = t.place(at)
                gone = t.code[at] < 0
                for lo in range(0, len(at), 1 << 16):
                    s = slice(lo, lo + (1 << 16))
                    cols = [pa.array(r[s], pa.int32()), pa.array(c[s], pa.int32()), pa.array(t.z[at][s]), pa.array((t.r0 + t.to_r[at])[s], pa.int32(), mask=gone[s]), pa.array((t.c0 + t.to_c[at])[s], pa.int32(), mask=gone[s]), pa.array(np.frombuffer(row["area"], np.int64)[at][s])]
                    yield pa.RecordBatch.from_arrays([pa.array([row["layer"]] * len(cols[0]), b.schema.field("layer").type), *cols], ["layer", "row", "col", "filled", "next_row", "next_col", "area"])

    kind = dict(tiles.dtypes)["layer"]
    return tiles.mapInArrow(unpack, f"layer {kind}, row int, col int, filled double, next_row int, next_col int, area long")


def _labelled(tiles: DataFrame, tile: int, stop: Callable) -> DataFrame:
    """layer, row, col, end: the label of the first cell on the way of each cell that stops, itself included; null without one."""
    kind = dict(tiles.dtypes)["layer"]
    tree = written(_tree(tiles.mapInArrow(_links(tile, None, stop), _LINK.format(kind))))
    ways = path_sums(tree.select("id", F.when(F.col("label").isNull(), F.col("next")).alias("next")), {}).select("id", F.col("root").alias("_root"))
    ends = ways.join(tree.select(F.col("id").alias("_root"), "label"), "_root").where("label is not null").select("id.*", "label")
    held = tiles.join(_by_tile(ends, tile, "far", "label"), _AT, "left")

    def work(batches):
        for b in _few(batches, tile):
            for row in b.to_pylist():
                t = _Tile(row, tile)
                halt, label = stop(t, row)
                end = t.ends(halt)
                value = np.where(halt, label, np.nan)
                for x in row["far"] or ():
                    value[(x["row"] - t.r0) * tile + x["col"] - t.c0] = x["label"]
                at = np.flatnonzero(t.known)
                r, c = t.place(at)
                for lo in range(0, len(at), 1 << 16):
                    s = slice(lo, lo + (1 << 16))
                    v = value[end[at[s]]]
                    yield pa.RecordBatch.from_arrays([pa.array([row["layer"]] * len(v), b.schema.field("layer").type), pa.array(r[s], pa.int32()), pa.array(c[s], pa.int32()), pa.array(t.z[at[s]]), pa.array(v, mask=np.isnan(v))], ["layer", "row", "col", "filled", "end"])

    return held.mapInArrow(work, f"layer {kind}, row int, col int, filled double, end double")


def _drains(least: float, row_area: Callable[[np.ndarray], np.ndarray] | None):
    def drains(t: _Tile, row: dict) -> np.ndarray:
        area = np.frombuffer(row["area"], np.int64).astype(float)
        return t.known & (area * (row_area(t.place(np.arange(len(area)))[0]) if row_area else 1.0) >= least)

    return drains


def streams(tiles: DataFrame, least: float, tile: int = 512, row_area: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """layer, row, col of the channel cells: those through which at least `least` drains.

    row_area: the area of a cell by its row; without it cells are counted.
    """
    drains = _drains(least, row_area)

    def work(batches):
        for b in _few(batches, tile):
            for row in b.to_pylist():
                t = _Tile(row, tile)
                r, c = t.place(np.flatnonzero(drains(t, row)))
                yield pa.RecordBatch.from_arrays([pa.array([row["layer"]] * len(r), b.schema.field("layer").type), pa.array(r, pa.int32()), pa.array(c, pa.int32())], ["layer", "row", "col"])

    return tiles.mapInArrow(work, f"layer {dict(tiles.dtypes)['layer']}, row int, col int")


def height_above_drainage(tiles: DataFrame, least: float, tile: int = 512, row_area: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """layer, row, col, hand: filled surface less that of the first channel cell on the way down; null without one.

    A channel is where at least `least` drains, counted as for streams().
    """
    drains = _drains(least, row_area)
    found = _labelled(tiles, tile, lambda t, row: (drains(t, row), t.z))
    return found.select("layer", "row", "col", (F.col("filled") - F.col("end")).alias("hand"))


def basins(tiles: DataFrame, outlets: DataFrame, tile: int = 512) -> DataFrame:
    """layer, row, col, outlet: the first outlet (outlet, layer, row, col) on the way down of each cell; cells that meet none are absent.

    All outlets are traced in one job. Outlets are whole numbers; of several on one cell the least holds.
    """
    least = outlets.groupBy("layer", "row", "col").agg(F.min("outlet").cast("double").alias("outlet"))
    held = tiles.join(_by_tile(least, tile, "outlets", "outlet"), _AT, "left")

    def stop(t: _Tile, row: dict) -> tuple[np.ndarray, np.ndarray]:
        halt, label = np.zeros(len(t.down), bool), np.full(len(t.down), np.nan)
        for x in row["outlets"] or ():
            cell = (x["row"] - t.r0) * tile + x["col"] - t.c0
            halt[cell], label[cell] = t.known[cell], x["outlet"]
        return halt, label

    return _labelled(held, tile, stop).where("end is not null").select("layer", "row", "col", F.col("end").cast("long").alias("outlet"))
