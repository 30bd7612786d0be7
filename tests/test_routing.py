"""Routing by its invariants, trees with cycles, and the stream against the table."""

import numpy as np
from pyspark.sql import functions as F

from freshet.operators import flow, routing
from freshet.operators.network import main_stem, path_sums, routing_check
from freshet.operators.routing import fill
from freshet.streaming.totals import daily_totals

EVENTS = "/root/testdata/sf0.01/events.parquet"


def _spill_levels(z):
    """Lowest level at which each cell drains to the rim, by relaxation."""
    known = np.isfinite(z)
    level = np.full((z.shape[0] + 2, z.shape[1] + 2), -np.inf)
    level[1:-1, 1:-1] = np.where(known, np.inf, -np.inf)
    while True:
        near = np.min([level[1 + r : 1 + r + z.shape[0], 1 + c : 1 + c + z.shape[1]] for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)], axis=0)
        new = np.where(known, np.maximum(np.nan_to_num(z), near), -np.inf)
        if (new == level[1:-1, 1:-1]).all():
            return np.where(known, new, np.nan)
        level[1:-1, 1:-1] = new


def test_tiles_fill_as_the_whole(spark):
    rng = np.random.default_rng(9)
    rows = []
    for layer, shape in (("a", (23, 31)), ("b", (9, 9)), ("c", (1, 5))):
        z = rng.integers(0, 12, shape).astype(float)
        z[rng.random(shape) < 0.05] = np.nan
        rows += [(layer, r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(shape[0]) for c in range(shape[1])]
    cells = spark.createDataFrame(rows, "layer string, row int, col int, value double")
    found = {(r.layer, r.row, r.col): r.filled for r in fill(cells, 7).collect()}
    for layer, shape in (("a", (23, 31)), ("b", (9, 9)), ("c", (1, 5))):
        z = np.full(shape, np.nan)
        for n, r, c, v in rows:
            if n == layer and v is not None:
                z[r, c] = v
        wanted = _spill_levels(z)
        assert all(found.get((layer, r, c)) == (None if np.isnan(wanted[r, c]) else wanted[r, c]) for r in range(shape[0]) for c in range(shape[1]))
    assert fill(cells.limit(0), 7).count() == 0


def test_borders_meet_region_by_region(spark, monkeypatch):
    """Four steps of regions up and down, lakes across them, islands of nodata."""
    monkeypatch.setattr(routing, "_REGIONS", 2)
    rng = np.random.default_rng(3)
    z = rng.integers(0, 30, (61, 45)).astype(float)
    z[10:50, 5:40] -= 40.0  # a basin over many regions, with a wall that leaks in one place
    z[9:51, [4, 40]] = z[[9, 50], 4:41] = 90.0
    z[30, 40] = 25.0
    z[rng.random(z.shape) < 0.004] = np.nan
    grids = {"a": z, "b": rng.integers(0, 9, (3, 130)).astype(float), "c": np.full((6, 6), np.nan)}
    grids["c"][2:4, 2] = 1.0
    cells = spark.createDataFrame([(n, r + 5, c + 3, None if np.isnan(v) else float(v)) for n, g in grids.items() for (r, c), v in np.ndenumerate(g)], "layer string, row int, col int, value double")
    found = {(r.layer, r.row - 5, r.col - 3): r.filled for r in fill(cells, 4).collect()}
    for n, g in grids.items():
        wanted = _spill_levels(g)
        assert all(found.get((n, r, c)) == (None if np.isnan(v) else v) for (r, c), v in np.ndenumerate(wanted))


def _plain(cells):
    """Cell drained to and cells drained of {(row, col): filled}, a cell at a time."""
    near = lambda p: [(p[0] + a, p[1] + b) for a, b in flow.OFFSETS]
    down, low, high = {}, {}, {}
    for p, z in cells.items():
        falls = [((z - cells[q]) / (1.0 if 0 in o else 2**0.5), -k) for k, (o, q) in enumerate(zip(flow.OFFSETS, near(p), strict=True)) if q in cells and cells[q] < z]
        down[p] = near(p)[-max(falls)[1]] if falls else None
        if falls or any(q not in cells for q in near(p)):
            low[p] = 0
        if any(cells.get(q, z) > z for q in near(p)):
            high[p] = 0
    for steps in (low, high):
        front = list(steps)
        for p in front:
            for q in near(p):
                if cells.get(q) == cells[p] and q not in steps:
                    steps[q] = steps[p] + 1
                    front.append(q)
    for p, z in cells.items():
        if low[p]:
            down[p] = min((q for q in near(p) if cells.get(q) == z), key=lambda q: (2 * low[q] - high.get(q, 0), near(p).index(q)))
    area = dict.fromkeys(cells, 0)
    for p in cells:
        while p is not None:
            area[p] += 1
            p = down[p]
    return down, area


def test_tiles_route_as_the_whole(spark):
    """Flats within and across tiles, nodata, grids smaller than a tile."""
    rng = np.random.default_rng(9)
    grids = {}
    for layer, shape, top in (("a", (23, 31), 6), ("b", (9, 9), 3), ("c", (1, 5), 4), ("d", (40, 40), 2)):
        z = rng.integers(0, top, shape).astype(float)
        z[rng.random(shape) < 0.03] = np.nan
        grids[layer] = z
    grids["d"][5:35, 5:35] = 0.0  # a lake over many tiles
    rows = [(n, r, c, None if np.isnan(v) else float(v)) for n, z in grids.items() for (r, c), v in np.ndenumerate(z)]
    filled = fill(spark.createDataFrame(rows, "layer string, row int, col int, value double"), 7).cache()
    tiles = flow.route(filled, 7)
    found = {(r.layer, r.row, r.col): r for r in flow.cells(tiles, 7).collect()}
    hand = {(r.layer, r.row, r.col): r.hand for r in flow.height_above_drainage(tiles, 12, 7).collect()}
    outlets = [(1, "a", 11, 15), (2, "d", 5, 20), (3, "a", 5, 5), (4, "a", 999, 999), (9, "a", 11, 15)]
    basin = {(r.layer, r.row, r.col): r.outlet for r in flow.basins(tiles, spark.createDataFrame(outlets, "outlet long, layer string, row int, col int"), 7).collect()}
    channel = {tuple(r) for r in flow.streams(tiles, 6.0, 7, lambda row: 0.5 + row % 2).collect()}
    at = {o[1:]: o[0] for o in reversed(outlets)}
    everything = {(r.layer, r.row, r.col): r.filled for r in filled.collect()}
    assert set(found) == set(everything) == set(hand)
    for layer in grids:
        cells = {(r, c): z for (n, r, c), z in everything.items() if n == layer}
        down, area = _plain(cells)
        for p, z in cells.items():
            r = found[layer, *p]
            assert ((r.next_row, r.next_col), r.area, r.filled) == (down[p] or (None, None), area[p], z)
            q = p
            while q is not None and area[q] < 12:
                q = down[q]
            assert hand[layer, *p] == (None if q is None else z - cells[q])
            q = p
            while q is not None and (layer, *q) not in at:
                q = down[q]
            assert basin.get((layer, *p)) == (None if q is None else at[layer, *q])
            assert ((layer, *p) in channel) == (area[p] * (0.5 + p[0] % 2) >= 6)


def test_routing_of_no_cells(spark):
    tiles = flow.route(fill(spark.createDataFrame([], "layer int, row int, col int, value double"), 7), 7)
    assert flow.cells(tiles, 7).count() == flow.height_above_drainage(tiles, 3, 7).count() == 0


def test_cycles_chains_and_dangling(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    ring = [(1000, 1001), (1001, 1000), (1002, 1001), (1003, 7777)]
    tree = spark.createDataFrame(chain + ring, "id long, next long")
    got = routing_check(tree).first()
    assert (got.units, got.terminal_units, got.dangling_next, got.units_in_a_cycle, got.single_outlet) == (304, 1, 1, 3, False)
    ways = {r.id: (r.root, r.total) for r in path_sums(tree, {"total": F.lit(2.0)}).collect()}
    assert ways[299] == (0, 598.0) and ways[1002] == (None, None) and ways[1003] == (1003, 0.0)
    stem = main_stem(tree.withColumn("area", 1000 - F.col("id")).withColumn("length", F.lit(1.0)))
    assert stem.where("distance is not null and id < 300").count() == 300


def test_empty_tree(spark):
    tree = spark.createDataFrame([], "id long, next long")
    assert path_sums(tree, {}).count() == 0 and routing_check(tree).first().units == 0


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet(EVENTS)
    table.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "events"))
    query = daily_totals(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted(spark.table("daily").collect()) == sorted(daily_totals(table).collect())
