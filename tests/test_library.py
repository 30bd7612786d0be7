"""What SQL doesn't cover: steps in profiles, known areas, features and files there and back, trees of odd shape."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.basin import Basin
from freshet.operators import climate, flow, grids, landscape, nearest, network, polygons, rings, routing
from freshet.operators.morphometry import basin_length
from freshet.plans import rasters
from freshet.sources import ledger, tiles


def test_knickpoint_of_a_step(spark):
    rows = [("smooth", k * 25.0, 0.15 * k * 25) for k in range(400)] + [("step", k * 25.0, 0.15 * k * 25 + (150 if k >= 200 else 0)) for k in range(400)] + [("short", 1.0, 2.0)]
    found = landscape.knickpoints(spark.createDataFrame(rows, "trunk string, chi double, z double")).collect()
    assert [r.trunk for r in found] == ["step"] and found[0].step >= 40 and abs(found[0].chi - 199 * 25) <= 25


def test_missing_heights_make_no_knickpoint(spark):
    smooth = [("smooth", k * 25.0, 0.15 * k * 25 if k != 60 else None) for k in range(120)] + [("nan", k * 25.0, 0.15 * k * 25 if k != 60 else float("nan")) for k in range(120)]
    assert landscape.knickpoints(spark.createDataFrame(smooth, "trunk string, chi double, z double")).count() == 0


def test_concavity_of_a_power_law(spark):
    area = [10 ** (6.1 + 2.9 * k / 3999) for k in range(4000)]
    rows = spark.createDataFrame([(a, 0.3 * a**-0.47) for a in area], "area_m2 double, slope double")
    fit = landscape.concavity(rows).first()
    assert abs(fit.theta - 0.47) < 0.01 and fit.r2 > 0.99
    assert landscape.concavity(rows.limit(20)).count() == 0


def test_equal_area(spark):
    """A cell of a degree at 40 north has the area of the ellipsoid's zone, wherever the projection is centred."""
    ring = [(0, 0, k, x, y) for k, (x, y) in enumerate([(10.0 + i / 50, 40.0) for i in range(50)] + [(11.0, 40.0 + i / 50) for i in range(50)] + [(11.0 - i / 50, 41.0) for i in range(50)] + [(10.0, 41.0 - i / 50) for i in range(50)])]
    rings = spark.createDataFrame(ring, "poly int, ring int, seq int, x double, y double")

    def q(lat):
        s, e = math.sin(math.radians(lat)), polygons.E
        return (1 - polygons.E2) * (s / (1 - polygons.E2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    wanted = polygons.A**2 / 2 * math.radians(1) * (q(41) - q(40))
    for lon0, lat0 in ((10.5, 40.5), (12.0, 45.0)):
        centre = spark.createDataFrame([(0, lon0, lat0)], "poly int, lon0 double, lat0 double")
        got = polygons.measures(polygons.edges(polygons.projected(rings, centre))).first().area
        assert got == pytest.approx(wanted, rel=1e-4)
    assert polygons.projected(rings, spark.createDataFrame([(0, 200.0, 0.0)], "poly int, lon0 double, lat0 double")).count() == 0


def test_hole_and_dissolve(spark):
    outer, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (4, 6), (6, 6), (6, 4)]
    rows = [(1, r, k, float(x), float(y)) for r, ring in enumerate((outer, hole)) for k, (x, y) in enumerate(ring)]
    edges = polygons.edges(spark.createDataFrame(rows, "poly int, ring int, seq int, x double, y double"))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 11.0, 5.0), (4, 5.0, 7.0)], "id int, x double, y double")
    assert {r.id for r in polygons.points_in(points, edges, 3.0).collect()} == {2, 4}
    assert polygons.measures(edges).first().area == 96
    assert basin_length(points.select(F.lit("b").alias("basin"), "x", "y")).first().length == pytest.approx(math.hypot(10, 4), abs=1e-6)


def test_features_there_and_back(spark):
    rows = [(1, 0, k, x, y) for k, (x, y) in enumerate([(0.5, 0.25), (3.0, 0.0), (3.0, 2.5)])] + [(1, 1, k, x, y) for k, (x, y) in enumerate([(1.0, 0.5), (1.5, 0.5), (1.5, 0.75)])]
    rings = spark.createDataFrame(rows, "poly int, ring int, seq int, x double, y double")
    made = ledger.features(rings, spark.createDataFrame([(1, "upper", 2.5)], "poly int, name string, area double"))
    assert '"properties":{"name":"upper","area":2.5}' in made.first().feature
    assert sorted(map(tuple, ledger.read_features(made).collect())) == sorted(rows)


def _net(made):
    """Area of each shell with its holes taken away, and the corners of each ring, of rows of assemble()."""
    by = {}
    for r in made.collect():
        by.setdefault((r.poly, r.ring, r.shell), []).append((r.seq, r.x, r.y))
    area, corners = {}, {}
    for (poly, ring, shell), v in by.items():
        v = [p[1:] for p in sorted(v)]
        corners[poly, ring] = v
        area[poly, shell] = area.get((poly, shell), 0) + sum(a * d - c * b for (a, b), (c, d) in zip(v, v[1:] + v[:1], strict=True)) / 2
    return area, corners


def test_rings_of_masks(spark):
    """A shell for each piece that hangs together by sides, simple rings, holes with the shell that holds them."""
    import numpy as np

    rng = np.random.default_rng(1)
    masks = [(rng.random((9, 10)) < p).astype(int) for p in (0.4, 0.55, 0.7)] + [np.pad(np.pad(np.ones((1, 1), int), 1), 1, constant_values=1)]

    def pieces(z):
        left, out = set(zip(*np.nonzero(z), strict=True)), []
        while left:
            piece, front = set(), [left.pop()]
            for r, c in front:
                piece.add((r, c))
                for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if q in left:
                        left.remove(q)
                        front.append(q)
            out.append(piece)
        return out

    rows = [(k, int(r), int(c), int(v)) for k, z in enumerate(masks) for (r, c), v in np.ndenumerate(z)]
    cells = spark.createDataFrame(rows, "layer int, row int, col int, inside int")
    area, corners = _net(rings.assemble(polygons.mask_outline(cells, F.col("inside") == 1)))
    assert all(len(set(v)) == len(v) for v in corners.values())
    for k, z in enumerate(masks):
        own = pieces(z)
        assert sorted(a for (poly, _), a in area.items() if poly == k) == sorted(map(len, own))
        holes = 0
        for piece in own:
            around = np.ones((z.shape[0] + 2, z.shape[1] + 2), int)
            around[tuple(np.array(list(piece)).T + 1)] = 0
            holes += len(pieces(around)) - 1
        assert sum(1 for poly, _ in corners if poly == k) == len(own) + holes


def test_union_of_edges_that_are_not_shared_whole(spark):
    """Junctions in the middle of an edge, slivers, overlaps, one inside another, a hole that is filled."""
    box = lambda p, x0, y0, x1, y1, ring=0, back=False: [(p, ring, k, float(x), float(y)) for k, (x, y) in enumerate(((x0, y0), (x1, y0), (x1, y1), (x0, y1))[:: -1 if back else 1])]
    rows = box(1, 0, 0, 10, 10) + box(2, 10, 0, 20, 4) + box(3, 10 + 4e-6, 4, 20, 10) + box(4, 30, 0, 40, 10) + box(5, 35, 5, 45, 15) + box(6, 32, 2, 34, 4)
    rows += box(7, 50, 0, 60, 10) + box(7, 52, 2, 58, 8, 1, True) + box(8, 52, 2, 58, 8) + box(9, 70, 0, 80, 10) + box(9, 72, 2, 78, 8, 1, True) + box(10, 73, 3, 75, 5)
    edges = polygons.edges(spark.createDataFrame(rows, "poly int, ring int, seq int, x double, y double"))
    group = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t"), (4, "o"), (5, "o"), (6, "o"), (7, "f"), (8, "f"), (9, "i"), (10, "i")], "poly int, grp string")
    area, corners = _net(rings.assemble(rings.union(edges, group)))
    assert {k: round(v, 3) for k, v in area.items()} == {("t", 0): 200, ("o", 0): 175, ("f", 0): 100, ("i", 0): 64, ("i", 1): 4}
    assert len(corners["t", 0]) == 4 and len(corners["o", 0]) == 8


def test_basins_as_polygons(spark, tmp_path):
    square = lambda p, x, y: [(p, 0, k, x + a, y + b) for k, (a, b) in enumerate(((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1)))]
    units = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "id long, next long")
    polys = spark.createDataFrame(square(1, 10.0, 50.0) + square(2, 10.1, 50.0) + square(3, 10.1, 50.1) + square(4, 10.0, 50.1), "poly long, ring int, seq int, x double, y double")
    basin = Basin.from_point(units, polys, (10.05, 50.05))
    assert basin.provenance == {"backend": "units", "point": [10.05, 50.05], "outlet": 1, "units": 3} and basin.rings.count() == 6
    with pytest.raises(ValueError):
        Basin.from_point(units, polys, (0.0, 0.0))
    text = basin.feature(name="upper")
    again = Basin.from_geometry(spark, text, source="text")
    assert again.measures()["area_km2"] == pytest.approx(basin.measures()["area_km2"]) and '"name":"upper"' in text
    multi = '{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}, {"type": "Feature", "geometry": null}]}'
    (tmp_path / "b.json").write_text(multi + "\n" + text + "\n")
    assert Basin.from_file(spark, str(tmp_path / "b.json")).rings.count() == 4 + 3 + 6
    with pytest.raises(Exception, match="no polygon: Point"):
        Basin.from_geometry(spark, '{"type": "Point", "coordinates": [1, 2]}').rings.collect()
    two = rings.assemble(polygons.edges(spark.createDataFrame(square(1, 0.0, 0.0) + [(1, 1, *r[2:]) for r in square(1, 1.0, 1.0)], "poly int, ring int, seq int, x double, y double")))
    made = ledger.features(two, spark.createDataFrame([(1, "x")], "poly int, name string"))
    assert '"MultiPolygon"' in made.first().feature and ledger.read_features(made).count() == 8
    slope = spark.range(36).select(F.lit(0).alias("layer"), F.floor(F.col("id") / 6).cast("int").alias("row"), (F.col("id") % 6).cast("int").alias("col"), (F.abs(F.col("id") % 6 - 2) * 5.0 - F.floor(F.col("id") / 6) + 50).alias("value"))
    tiles = flow.route(routing.fill(slope, 4), 4)
    cells = {(r.row, r.col): r.area for r in flow.cells(tiles, 4).collect()}
    valley = Basin.from_surface(tiles, (5, 2), 10.0, 50.0, 0.01, 4)
    area = sum(r.x1 * r.y2 - r.x2 * r.y1 for r in valley.edges.collect()) / 2
    assert area == pytest.approx(cells[5, 2] * 1e-4) and cells[5, 2] > 6


def test_trends_of_many_series(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(k, int(t), None if rng.random() < 0.1 else float(v)) for k in range(6) for t, v in zip(rng.integers(0, 60, 40), np.round(rng.standard_normal(40) * 2 + k), strict=True)] + [(9, t, 1.0) for t in range(9)] + [(8, t, 5.0) for t in range(12)]
    found = {r.key: r for r in climate.trends(spark.createDataFrame(rows, "key int, t int, value double")).collect()}
    assert set(found) == {0, 1, 2, 3, 4, 5, 8} and (found[8].s, found[8].z, found[8].p, found[8].direction) == (0, 0.0, 1.0, "flat")
    for k in range(6):
        own = [(t, v) for key, t, v in rows if key == k and v is not None]
        pairs = [(b[1] - a[1], b[0] - a[0]) for a in own for b in own if a[0] < b[0]]
        assert found[k].s == sum((d > 0) - (d < 0) for d, _ in pairs) and found[k].n == len(own)
        assert found[k].sen == pytest.approx(float(np.median([d / w for d, w in pairs])), abs=1e-6)
    t, y = np.sort(rng.random(700)), rng.standard_normal(700)
    slopes = (y[None] - y[:, None])[np.triu_indices(700, 1)] / (t[None] - t[:, None])[np.triu_indices(700, 1)]
    assert climate._median_slope(t, y, 5000) == pytest.approx(np.median(slopes), rel=1e-12)


def test_means_along_a_river(spark):
    tree = spark.createDataFrame([(k, k - 1 if k else None, float(k * k), 100.0 - k) for k in range(20)] + [(50, 10, 7.0, 1.0)], "id long, next long, z double, area_m2 double")
    down = {r.id: (float(r.total), r["count"]) for r in network.path_window(tree, F.col("z"), 5).collect()}
    assert down[19] == (sum(k * k for k in range(14, 19)), 5) and down[2] == (1.0, 2) and down[0] == (0.0, 0) and down[50] == (sum(k * k for k in range(6, 11)), 5)
    fit = {r.id: r.z_fit for r in landscape.smoothed(tree, 3).collect()}
    assert fit[10] == pytest.approx(sum(k * k for k in range(7, 14)) / 7) and fit[0] == pytest.approx(14 / 4) and fit[50] == pytest.approx((7 + 100 + 81 + 64) / 4)


def test_lines_that_touch(spark):
    box = polygons.edges(spark.createDataFrame([(1, 0, k, float(x), float(y)) for k, (x, y) in enumerate(((0, 0), (4, 0), (4, 4), (0, 4)))], "poly int, ring int, seq int, x double, y double"))
    lines = [(1, -1, -1, 2, 2), (2, -1, -1, 5, 5), (3, -2, 4, 2, 4), (4, -1, 2, 5, 2), (5, -1, 5, 5, 5), (6, 4, 4, 6, 6), (7, 1, 1, 2, 2), (8, 5, 0, 9, 0), (9, -3, 2, 0, 2)]
    table = spark.createDataFrame([(i, *map(float, v)) for i, *v in lines], "id int, x1 double, y1 double, x2 double, y2 double")
    assert {r.id for r in polygons.lines_meet(table, box, 3.0).collect()} == {1, 2, 3, 4, 6, 7, 9}


def test_totals_span_no_gap(spark):
    months = [("a", f"{2000 + k // 12}-{k % 12 + 1:02d}-01", None if k == 5 else float(k)) for k in range(36) if k != 20]
    found = climate.spi(spark.createDataFrame(months, "series string, t string, value double").withColumn("t", F.to_date("t")), 3, 1)
    got = {(r.t.year - 2000) * 12 + r.t.month - 1 for r in found.collect()}
    assert got == {k for k in range(2, 36) if not {k, k - 1, k - 2} & {5, 20}}
    label = spark.createDataFrame([(2.5,), (-2.0,), (-1.0,), (0.0,), (None,)], "v double").select(climate.spi_label(F.col("v"))).collect()
    assert [r[0] for r in label] == ["extremely wet", "extremely dry", "moderately dry", "near normal", None]


def test_grids_align_without_holes(spark):
    source = spark.createDataFrame([(0, r, c, c * 1.0, -r * 1.0, float(3 * r + c)) for r in range(3) for c in range(3)], "layer int, row int, col int, x double, y double, value double")
    half = {(r.row, r.col): r.value for r in grids.align(source, -0.5, 0.5, 0.5).collect()}
    assert half == {(r, c): float(3 * (r // 2) + c // 2) for r in range(6) for c in range(6)}
    mean = {(r.row, r.col): r.value for r in grids.align(source, -0.5, 0.5, 1.5, mean=True).collect()}
    assert mean[0, 0] == pytest.approx((0 + 0.5 * 1 + 0.5 * 3 + 0.25 * 4) / 2.25) and len(mean) == 4
    shifted = {(r.row, r.col): r.value for r in grids.align(source, 0.0, 0.0, 1.0, mean=True).collect()}
    assert shifted[0, 0] == 2.0 and len(shifted) == 16


def test_one_point_tells_nothing_of_the_upper_third(spark):
    from freshet.operators.series import profile_shape

    rows = [("one", 0.0, 10.0), ("one", 5.0, 4.0), ("one", 9.0, 0.0), ("two", 0.0, 10.0), ("two", 3.0, 4.0), ("two", 9.0, 0.0)]
    found = {r.river: r.upper_third_pct for r in profile_shape(spark.createDataFrame(rows, "river string, distance double, z double")).collect()}
    assert found == {"one": None, "two": 60.0}


def test_nearest_threshold_is_chosen(spark):
    cells = spark.createDataFrame([(1.0, 30.0, 0.5), (3.0, 40.0, 0.5)], "drained_km2 double, step_m double, area_km2 double")
    assert {r.threshold_km2: r.chosen for r in landscape.density_curve(cells, 1.0, (0.6, 2.0)).collect()} == {0.6: True, 2.0: False}


def test_files_and_manifest(spark, tmp_path):
    good = spark.range(5).select(F.col("id").alias("t"), (F.col("id") * 2).alias("value"))
    bad = good.select(F.raise_error(F.lit("no such layer")).alias("x"))
    manifest = ledger.write_all(spark, {"good": good, "bad": bad, "none": good.limit(0)}, str(tmp_path / "out"))
    assert {(r.name, r.status, r.rows) for r in manifest.collect()} == {("good", "ok", 5), ("bad", "failed", None), ("none", "empty", 0)}
    assert {(r.status, r.n) for r in ledger.manifest_counts(spark.read.json(str(tmp_path / "out/manifest"))).collect()} == {("ok", 1), ("failed", 1), ("empty", 1)}
    ledger.write_series(good, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv")).collect()) == [(k, 2 * k) for k in range(5)]


def test_accumulation_on_a_chain_and_a_ring(spark):
    chain = [(i, i - 1 if i else None) for i in range(200)]
    tree = spark.createDataFrame([*chain, (900, 901), (901, 900), (902, 901)], "id long, next long")
    found = {r.id: r.total for r in network.accumulate(tree, F.lit(1)).collect()}
    assert found[0] == 200 and found[150] == 50 and found[900] is None and found[902] is None
    up = {r.id: r.depth for r in network.upstream(tree, spark.createDataFrame([(100,), (150,)], "id long")).collect()}
    assert up[100] == 0 and up[149] == 49 and up[150] == 0 and up[199] == 49 and 99 not in up and 902 not in up


def test_bands_and_regions(spark):
    bands = spark.createDataFrame([("red",), ("nir",)], "band string")
    asked = spark.createDataFrame([("RED",), ("B08",), ("b99",)], "asked string")
    aliases = spark.createDataFrame([("B08", "nir"), ("B04", "red")], "alias string, band string")
    assert {(r.asked, r.band) for r in tiles.resolve_bands(asked, bands, aliases).collect()} == {("RED", "red"), ("B08", "nir"), ("b99", None)}
    regions = spark.createDataFrame([("eu", -25.0, 12.0, 70.0, 82.0, 1), ("af", -19.0, -35.0, 55.0, 38.0, 2)], "region string, west double, south double, east double, north double, rank int")
    points = spark.createDataFrame([(1, 20.0, 10.0), (2, 60.0, 10.0), (3, -60.0, 10.0)], "id int, lat double, lon double")
    assert {(r.id, r.region, r.place) for r in tiles.regions_of(points, regions).collect()} == {(1, "eu", 1), (1, "af", 2), (2, "eu", 1)}


def test_basin_of_units(spark):
    from freshet.basin import Basin

    squares = [(k, 0, i, k % 3 + a, 40.0 + k // 3 + b) for k in range(6) for i, (a, b) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    rings = spark.createDataFrame(squares, "poly long, ring int, seq int, x double, y double")
    units = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 0), (4, 3), (5, 2)], "id long, next long")
    basin = Basin.from_point(units, rings, 1)
    assert basin.provenance["units"] == 3 and basin.bounds() == (1.0, 40.0, 3.0, 42.0)
    box = {k: Basin.from_rings(rings.where(F.col("poly") == k)).measures()["area_km2"] for k in (1, 2, 5)}
    assert basin.measures()["area_km2"] == pytest.approx(sum(box.values()), rel=2e-3)
    lon, lat = basin.centroid()
    assert (lon, lat) == (pytest.approx(2 + 1 / 6), pytest.approx(40 + 5 / 6))
    points = spark.createDataFrame([(1, 1.5, 40.5), (2, 1.5, 41.5), (3, 2.5, 41.5)], "id int, x double, y double")
    assert {r.id for r in basin.contains(points).collect()} == {1, 3}
    basin.record("terrain", product="cop30")
    told = basin.summary(broken=lambda b: 1 / 0, units=lambda b: 3)
    assert told["units"] == 3 and "ZeroDivisionError" in told["broken"]["error"] and basin.log[0]["product"] == "cop30"


def test_outline_holds_its_polygon(spark):
    ring = [(1, 0, k, math.cos(k / 50) * (10 + k % 3), math.sin(k / 50) * (10 + k % 3)) for k in range(314)] + [(2, 0, k, float(k), float(k * k)) for k in range(4)]
    rings = spark.createDataFrame(ring, "poly int, ring int, seq int, x double, y double")
    found = polygons.outline(rings, 100)
    assert found.where("poly = 2").count() == 4 and found.where("poly = 1").count() < 200
    big, small = (polygons.measures(polygons.edges(t.where("poly = 1"))).first().area for t in (found, rings))
    assert big > small


def test_command_line(capsys):
    from freshet.__main__ import main

    assert main(["list"]) == 0 and "zonal_class" in capsys.readouterr().out
    assert main(["run", "no such query", "x"]) == 2


def test_ice_of_a_grid_past_the_map(spark):
    rows = [(0, float(lat), 70 if lat < 50 else 0, 100.0 + lat) for lat in (-70, 10, 60)]
    cells = spark.createDataFrame(rows, "layer int, lat double, cover int, value double")
    assert grids.ice_summary(cells).first()["ice_km2"] is None
    whole = grids.ice_summary(cells, covered=None).first()
    assert whole["ice_km2"] > 0 and 0 < whole["ice_pct"] < 100 and not whole["trace"]


def test_ice_summary_of_a_long_table_is_not_null(spark, tmp_path):
    spark.range(600_000).selectExpr("id AS p_partkey", "cast(id % 50 + 1 AS int) AS p_size", "900.0D + id % 90 AS p_retailprice", "'a' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    assert rasters.ice_summary(spark, str(tmp_path)).first()["ice_km2"] is not None


@pytest.mark.parametrize("name", ["knickpoints", "long_profile", "as_of_reach"])
def test_no_frame_is_read_anew_for_each_row(spark, name):
    """A frame from the row to the end of its group costs the square of the group."""
    from freshet.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe" in plan and "currentrow$(), unboundedfollowing$()" not in plan


def test_values_before_the_first_known_one(spark):
    points = spark.createDataFrame([("a", 0, 1, None), ("a", 1, 1, None), ("a", 2, 1, 7.0), ("a", 3, 1, None), ("a", 4, 1, 9.0), ("b", 0, 1, None)], "river string, seq int, length int, z double")
    found = {(r["river"], r["seq"]): r["z"] for r in network.long_profile(points).collect()}
    assert found == {("a", 0): 7.0, ("a", 1): 7.0, ("a", 2): 7.0, ("a", 3): 7.0, ("a", 4): 9.0, ("b", 0): None}


def test_slopes_are_counted_without_pairs():
    import time

    import numpy as np

    rng = np.random.default_rng(2)
    t, y = rng.integers(0, 40, 90).astype(float), rng.integers(0, 9, 90).astype(float)
    dt, dy = t[None, :] - t[:, None], y[None, :] - y[:, None]
    slopes = dy[dt > 0] / dt[dt > 0]
    assert climate._slopes_below(t, y, 0.0) == (slopes < 0).sum() and climate._slopes_below(t, y, 0.123) == (slopes < 0.123).sum()
    assert climate._median_slope(t, y, 0) == pytest.approx(np.median(slopes), rel=1e-12)
    # 200 million pairs
    t = np.arange(20_000.0)
    began = time.time()
    assert climate._median_slope(t, np.round(t * 0.25 + rng.standard_normal(20_000))) == pytest.approx(0.25, abs=1e-4)
    assert time.time() - began < 20


def test_nearest_by_growing_distances(spark, monkeypatch):
    """Many rows on few places, clusters, poles, the date line and ties; places are compared once, near ones first."""
    rng = np.random.default_rng(5)
    spots = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 300).round(1), rng.uniform(-180, 180, 300).round(1), strict=True)]
    spots += [(10 + float(a), 20 + float(b)) for a, b in rng.uniform(0, 0.5, (100, 2)).round(3)]
    spots += [(89.9, 10.0), (89.9, -170.0), (0.0, 179.9), (0.0, -179.9)]
    targets = [(i, *spots[i % len(spots)]) for i in range(10 * len(spots))] + [(-1, None, 3.0)]
    points = [(i, lat + (i % 3) * 0.1, -lon if i % 5 == 0 else lon) for i, (lat, lon) in enumerate(spots) if lat < 89.7] + [(8000, 89.95, 100.0), (8001, 0.0, -180.0), (8002, -90.0, 0.0), (8003, None, 1.0)]
    points += [(10_000 + i, lat, lon) for i, lat, lon in points]
    seen, pairs = [], nearest._pairs
    monkeypatch.setattr(nearest, "_pairs", lambda *a: (seen.append(pairs(*a).count()), pairs(*a))[1])
    make = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double")
    found = {r.id: (r.target, r.km) for r in nearest.nearest(make(points), make(targets), 400.0).collect()}

    def km(a, b):
        a, b, c, d = map(math.radians, (*a, *b))
        return round(2 * 6371.0088 * math.asin(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2) ** 0.5), 6)

    for i, lat, lon in points:
        best = min(((km((lat, lon), t[1:]), t[0]) for t in targets[: len(spots)]), default=None) if lat is not None else None
        wanted = (best[1], best[0]) if best and best[0] <= 400 else None
        got = found.get(i)
        assert (got is None) == (wanted is None) and (got is None or abs(got[1] - wanted[1]) <= 2e-6), (i, got, wanted)
        assert got is None or got[0] == wanted[0] or abs(km((lat, lon), spots[got[0] % len(spots)]) - wanted[1]) <= 2e-6
    assert sum(seen) < 40 * len(spots)


def test_no_edges_are_sent_through_the_driver(spark, monkeypatch):
    """No step of a union and its rings is a broadcast, which would gather a table that grows with the edges."""
    from freshet.operators import lineage

    plans, write = [], lineage.Written.__init__

    def kept(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(self, df)

    monkeypatch.setattr(lineage.Written, "__init__", kept)
    box = lambda p, x, y: [(p, 0, k, x + a, y + b) for k, (a, b) in enumerate(((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)))]
    edges = polygons.edges(spark.createDataFrame(box(1, 0.0, 0.0) + box(2, 2.000001, 0.0) + box(3, 1.0, 1.0) + box(4, 4.0, 1.0), "poly int, ring int, seq int, x double, y double"))
    group = spark.createDataFrame([(k, 0) for k in (1, 2, 3, 4)], "poly int, grp int")
    made = rings.assemble(rings.union(edges, group))
    text = ledger.features(made, spark.createDataFrame([(0, "g")], "poly int, name string"))
    assert sum(_net(made)[0].values()) == pytest.approx(8, abs=1e-4)
    plans.append(text._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]


def test_rounds_of_a_ring_do_not_follow_its_length(spark, monkeypatch):
    """Edges are chained where they lie, so a ring of many edges takes hardly more steps than one of few."""
    from freshet.operators import lineage

    written, write = [], lineage.Written.__init__

    def counted(self, df):
        written.append(1)
        write(self, df)

    monkeypatch.setattr(lineage.Written, "__init__", counted)
    took = {}
    for n in (4, 2000):
        written.clear()
        angle = F.lit(2 * math.pi / n) * F.col("id")
        ring = spark.range(n).select(F.lit(1).alias("poly"), F.lit(0).alias("ring"), F.col("id").cast("int").alias("seq"), F.cos(angle).alias("x"), F.sin(angle).alias("y"))
        made = rings.assemble(polygons.edges(ring))
        assert sorted(r.seq for r in made.collect()) == list(range(n))
        took[n] = len(written)
    assert took[2000] <= took[4] + 4


def test_rings_do_not_depend_on_batches(spark):
    """Batches of 7 edges give the rings that large ones do; a ring that is there twice, or is led into, ends and comes once."""
    cells = spark.range(180).select(F.lit(0).alias("layer"), F.floor(F.col("id") / 12).cast("int").alias("row"), (F.col("id") % 12).cast("int").alias("col"), (F.col("id") * 37 % 101 % 3).alias("v"))
    edges = polygons.mask_outline(cells, F.col("v") != 0)
    square = [(1, 0, 0.0, 0.0, 1.0, 0.0), (1, 0, 1.0, 0.0, 1.0, 1.0), (1, 0, 1.0, 1.0, 0.0, 1.0), (1, 0, 0.0, 1.0, 0.0, 0.0)]
    lone = [(1, 0, 5.0, 5.0, 6.0, 5.0), (1, 0, 0.0, 0.0, -1.0, 0.0)]
    edges = edges.union(spark.createDataFrame(square * 2 + lone, edges.schema))
    whole = sorted(map(tuple, rings.assemble(edges).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        small = sorted(map(tuple, rings.assemble(edges).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == whole
    assert [r[3:5] for r in whole if r[0] == 1] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
