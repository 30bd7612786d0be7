"""Queries of checks, series and sources over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import checks, climate, focal, hydrology, series
from freshet.plans.queries import _CELLS, _cells, _daily, _monthly
from freshet.plans.queries import ORACLE as BASE
from freshet.sources import ledger, tiles
from freshet.sources.grids import read


def _near(spark, sf_dir):
    """Reaches near outlets, up to twenty for each."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select((k % 97).alias("id"), (F.col("p_size") * F.col("p_size") * 0.5).alias("upland_km2"), (k * 13 % 400 / 100).alias("km"))


def outlet_check(spark, sf_dir):
    basins = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 8 + 1).alias("area_km2"))
    return checks.outlet_check(basins, _near(spark, sf_dir).where("id % 9 <> 4"), search_km=0.6)


def outlet_unit(spark, sf_dir):
    k = F.col("p_partkey")
    near = read(spark, sf_dir, "part").select((k % 97).alias("outlet"), k.alias("unit"), (k * 13 % 400 / 40).alias("km"), (k * 13 % 400 == 0).alias("inside"), F.pow(F.col("p_size").cast("double"), F.lit(3.0)).alias("up_area"))
    return checks.outlet_unit(near, 5.0)


def choose_backend(spark, sf_dir):
    k = F.col("p_partkey")
    b = read(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") * 100.0).alias("unit_km2"), (k % 3 > 0).alias("agrees"), F.when(k % 3 == 0, F.col("p_size") * 90.0).alias("suggested_km2"), (k % 5 / 2).alias("reach_km"), (F.col("p_size") * (k % 7 * 40.0)).alias("dem_km2"))
    return checks.choose_backend(b)


def suitability(spark, sf_dir):
    c = _cells(spark, sf_dir)
    slope = focal.surfaces(c).select("row", "col", "slope")
    both = c.join(slope, ["row", "col"]).withColumns({"filled": F.col("value") + (F.col("size") % 9 == 0).cast("int"), "cell_m": F.lit(30.0), "level_pct": F.lit(1.5)})
    return checks.suitability(both, F.lit("cop30"))


def landcover_agreement(spark, sf_dir):
    codes = F.array(*[F.lit(x) for x in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95)])
    other = F.array(*[F.lit(x) for x in (2, 11, 11, 5, 7, 8, 9, 1, 4, 4)])
    k = (F.col("size") % 10).cast("int")
    return checks.landcover_agreement(_cells(spark, sf_dir).select(F.col("kind").alias("layer"), F.get(codes, k).alias("first"), F.when(F.col("key") % 6 == 0, F.lit(2)).otherwise(F.get(other, k)).alias("second")))


def terrain_quality(spark, sf_dir):
    c = _cells(spark, sf_dir)
    both = focal.position(c, 3).join(focal.surfaces(c).select("row", "col", "slope"), ["row", "col"])
    return checks.terrain_quality(both.select("layer", F.col("roughness"), "slope", F.lit(0.3).alias("floor")))


def _measured(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select(k.alias("id"), (s * s * s * 1.0).alias("area_km2"), (s * 1.1).alias("filling"), (s * 2.05).alias("slope"), F.when(k % 4 > 0, s * 0.12).alias("water"), (s * 17.5).alias("relief"), (k % 3 * 0.5).alias("coverage"))


def envelope_axes(spark, sf_dir):
    return checks.envelope_axes(_measured(spark, sf_dir))


def envelope_position(spark, sf_dir):
    return checks.envelope_position(checks.envelope_axes(_measured(spark, sf_dir)))


def delineation_grade(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return checks.delineation_grade(read(spark, sf_dir, "part").select(k.alias("id"), (s * s * s * 1.0).alias("area_km2"), F.when(k % 4 > 0, k % 3 > 0).alias("agrees")))


def rainfall_extremes(spark, sf_dir):
    return series.extremes(climate.annual_total(_daily(spark, sf_dir)))


def wet_season(spark, sf_dir):
    return series.wet_season(climate.monthly_climatology(_daily(spark, sf_dir)))


def trend_significance(spark, sf_dir):
    return series.significance(climate.trend(_monthly(spark, sf_dir)), 12.0)


def cell_trends(spark, sf_dir):
    """A trend for each cell of a stack: prices of a clerk's orders in the order of their keys."""
    o = read(spark, sf_dir, "orders")
    return climate.trends(o.select((F.col("o_orderkey") % 150).alias("key"), F.floor(F.col("o_orderkey") / 150).alias("t"), F.round(F.col("o_totalprice") / 1e4).alias("value")))


def median_and_spread(spark, sf_dir):
    return series.median_and_spread(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


def linear_fit(spark, sf_dir):
    return series.linear_fit(read(spark, sf_dir, "part"), "p_brand", F.col("p_size"), F.col("p_retailprice"))


def mann_whitney(spark, sf_dir):
    return series.mann_whitney(read(spark, sf_dir, "part"), F.col("p_brand") < "Brand#3", F.col("p_size"))


def accuracy_by_size(spark, sf_dir):
    p = read(spark, sf_dir, "part").select((F.col("p_size") * 10.0 + F.col("p_partkey") % 5).alias("found"), (F.col("p_size") * 10.0).alias("reported"))
    return series.accuracy(p, F.floor(F.col("reported") / 100))


def as_of_reach(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("river"), k.alias("id"), (k * 7 % 1009).alias("at"))
    states = read(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_brand").alias("river"), (F.col("p_partkey") * 11 % 1013).alias("at"), F.col("p_partkey").alias("reach"))
    return series.as_of(rows, states.groupBy("river", "at").agg(F.min("reach").alias("reach")), "river", "at", "reach")


def missing_months(spark, sf_dir):
    have = read(spark, sf_dir, "orders").where("o_orderkey % 60 = 7").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("t"))
    return series.missing_months(have, "1995-01-01", "2000-12-01", "series")


def river_measures(spark, sf_dir):
    k = F.col("p_partkey")
    return series.river_measures(read(spark, sf_dir, "part").select(F.col("p_brand").alias("river"), k.alias("seq"), (k * 3 % 101 * 1.0).alias("x"), (k * 7 % 103 * 1.0).alias("y"), (2000.0 - k % 1000).alias("z"), (F.col("p_size") * 0.5).alias("length_km"), (F.col("p_size") % 5).alias("order")))


def profile_shape(spark, sf_dir):
    k = F.col("p_partkey")
    return series.profile_shape(read(spark, sf_dir, "part").select(F.col("p_brand").alias("river"), k.cast("double").alias("distance"), (100000.0 / (k + 100) + F.col("p_size") * 0.01).alias("z")))


def tile_names(spark, sf_dir):
    k = F.col("s_suppkey")
    boxes = read(spark, sf_dir, "supplier").select(k.alias("id"), (k * 3.7 - 180).alias("west"), (k % 60 * 1.5 - 45).alias("south"), (k * 3.7 - 178.4).alias("east"), (k % 60 * 1.5 - 44.2).alias("north"))
    wanted = tiles.corners(boxes)
    held = wanted.where("(lat + lon) % 3 = 0").select(F.lit("cop30").alias("product"), "lat", "lon").union(wanted.where("(lat + lon) % 2 = 0").select(F.lit("nasadem"), "lat", "lon"))
    name = F.when(F.col("product") == "cop30", tiles.tile_name("cop30", F.col("lat"), F.col("lon"))).when(F.col("product") == "nasadem", tiles.tile_name("nasadem", F.col("lat"), F.col("lon")))
    return tiles.fill_tiles(wanted, held).withColumn("tile", name)


def mosaic(spark, sf_dir):
    k = F.col("p_partkey")
    return tiles.mosaic(read(spark, sf_dir, "part").select(F.lit(0).alias("layer"), (k % 40).cast("int").alias("row"), (k % 37 % 9).cast("int").alias("col"), F.col("p_size").alias("rank"), F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice")).otherwise(-32768.0).alias("value")))


def _items(spark, sf_dir):
    k = F.col("e.event_id")
    t = F.col("e.ts").cast("timestamp")
    return read(spark, sf_dir, "events").alias("e").select(k.alias("id"), (k % 360 - 180.0).alias("west"), (k % 170 - 85.0).alias("south"), (k % 360 - 178.0).alias("east"), (k % 170 - 83.0).alias("north"), t.alias("t"), F.when(k % 11 > 0, k % 100 * 1.0).alias("cloud"))


def item_search(spark, sf_dir):
    return tiles.search_items(_items(spark, sf_dir), (10.0, 20.0, 40.0, 60.0), "2024-01-05", "2024-01-25", 40.0).select("id", "cloud")


def item_search_report(spark, sf_dir):
    return tiles.why_empty(_items(spark, sf_dir), (10.0, 20.0, 40.0, 60.0), "2024-01-05", "2024-01-25", 0.0)


def band_values(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("band"), (F.col("p_size") / 100).alias("scale"), F.lit(-2.0).alias("offset"), F.lit(7).alias("nodata"), (F.col("p_partkey") % 2 == 0).alias("offset_applied"))
    return tiles.scaled(p.select(F.col("p_partkey").alias("cell"), F.col("p_type").alias("band"), F.col("p_size").alias("raw")), tiles.scaling(items))


def open_items(spark, sf_dir):
    scheme = F.when(F.col("l_orderkey") * 7 % 23 == F.col("l_partkey") % 23, "s3://").otherwise("https://")
    return tiles.open_items(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat(scheme, F.col("l_partkey").cast("string")).alias("href")))


def attributes(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return tiles.attributes(p.select("p_partkey", F.col("p_size").alias("tmp_dc_uyr"), (F.col("p_size") % 9).alias("glc_cl_umj"), F.col("p_retailprice").alias("pre_mm_uyr"), F.col("p_size").alias("run_mm_syr")), "p_partkey")


def water_shares(spark, sf_dir):
    v = (F.col("p_size") * 5).alias("occurrence")
    return tiles.water_shares(read(spark, sf_dir, "part").select(F.col("p_type").alias("layer"), v), 75.0)


def indices(spark, sf_dir):
    s, k = F.col("p_size").cast("double"), F.col("p_partkey")
    start, end = tiles.satellite_window(F.lit(30.0) - s, F.lit(2000) + (k % 20).cast("int"))
    return read(spark, sf_dir, "part").select(
        k.alias("id"), tiles.ndvi(s, k % 50 * 1.0).alias("ndvi"), F.round(tiles.decibels(s / 1000), 6).alias("db"), tiles.available_water(F.when(k % 3 > 0, s * 10), s * 4 + k % 200).alias("awc"),
        tiles.soil_value(F.when(k % 7 == 0, -32768.0).otherwise(s), 10.0).alias("soil"), start.alias("from_day"), end.alias("to_day"),
    )


def licence_report(spark, sf_dir):
    k = F.col("n_nationkey")
    cat = read(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5").select(F.col("n_name").alias("key"), F.concat(F.lit("L"), (k % 4).cast("string")).alias("licence"), (k % 4 > 0).alias("commercial"), (k % 3 > 0).alias("redistribute"))
    used = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == k)  # 25 rows
    return ledger.licence_report(used.select(F.col("n_name").alias("key")), cat)


def ledger_state(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null")
    path = F.col("doc_id").cast("string")
    past = d.where("doc_id % 5 <> 4").select(F.col("source").alias("url"), path.alias("path"), F.when(F.col("doc_id") % 3 > 0, F.sha2(F.when(F.col("doc_id") % 2 > 0, F.col("text")).otherwise("old").cast("binary"), 256)).alias("sha256"), F.col("doc_id").alias("t"))
    return ledger.recheck(past, d.where("doc_id % 7 <> 3").select(path.alias("path"), F.col("text").cast("binary").alias("content")))


def ragged_union(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("rain"), F.lit(None).cast("double").alias("snow"))
    b = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("error"))
    return ledger.union_ragged(a, b)


def flat_rows(spark, sf_dir):
    p = read(spark, sf_dir, "supplier")
    return ledger.flat(p.select("s_suppkey", F.struct(F.struct(F.col("s_nationkey").alias("nation")).alias("at"), F.col("s_name").alias("name")).alias("who"), F.array("s_nationkey").alias("list")), "s_suppkey")


def snow_sectors(spark, sf_dir):
    c = _cells(spark, sf_dir)
    a = focal.surfaces(c).select("row", "col", "aspect")
    return hydrology.sectors(c.join(a, ["row", "col"]), F.col("size") % 7 == 0)


def terrain_stats(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return hydrology.terrain_stats(c.join(focal.surfaces(c).select("row", "col", "slope"), ["row", "col"]))


def reservoirs(spark, sf_dir):
    lakes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3 + 1).alias("type"), F.abs("c_acctbal").alias("volume"), (F.col("c_custkey") % 700 * 10.0).alias("watershed"), F.col("c_nationkey").alias("basin"))
    return hydrology.watersheds(lakes, F.lit(3000.0) + F.col("basin") * 400)


QUERIES = {
    f.__name__: f
    for f in (
        outlet_check, outlet_unit, choose_backend, suitability, landcover_agreement, terrain_quality, envelope_axes, envelope_position, delineation_grade, rainfall_extremes, wet_season, trend_significance, cell_trends,
        median_and_spread, linear_fit, mann_whitney, accuracy_by_size, as_of_reach, missing_months, river_measures, profile_shape, tile_names, mosaic, item_search, item_search_report, band_values, open_items,
        attributes, water_shares, indices, licence_report, ledger_state, ragged_union, flat_rows, snow_sectors, terrain_stats, reservoirs,
    )
}

_NEAR = "near AS (SELECT p_partkey % 97 AS id, p_size * p_size * 0.5e0 AS upland_km2, p_partkey * 13 % 400 / 100e0 AS km FROM part)"
_UNITS = "near AS (SELECT p_partkey % 97 AS outlet, p_partkey AS unit, p_partkey * 13 % 400 / 40e0 AS km, p_partkey * 13 % 400 = 0 AS inside, pow(CAST(p_size AS DOUBLE), 3e0) AS up_area FROM part)"
_MEASURED = """m AS (SELECT p_partkey AS id, p_size * p_size * p_size * 1e0 AS area_km2, p_size * 1.1e0 AS filling, p_size * 2.05e0 AS slope, CASE WHEN p_partkey % 4 > 0 THEN p_size * 0.12e0 END AS water,
  p_size * 17.5e0 AS relief, p_partkey % 3 * 0.5e0 AS coverage FROM part)"""


def _axes_sql() -> str:
    pct = "CASE WHEN area_km2 < 100 THEN 181 WHEN area_km2 < 500 THEN 30 WHEN area_km2 < 2000 THEN 8.9 WHEN area_km2 < 10000 THEN 1.7 WHEN area_km2 < 100000 THEN 1.3 ELSE 0.3 END"
    out = [f"SELECT id, 'size' AS axis, area_km2 AS measured, CASE WHEN {pct} <= 5 THEN 'inside' WHEN {pct} <= 20 THEN 'edge' ELSE 'outside' END AS position FROM m"]
    for k, (a, b, c, d) in checks.STUDY.items():
        out.append(f"SELECT id, '{k}', {k}, CASE WHEN {k} < {a!r}e0 OR {k} > {d!r}e0 THEN 'outside' WHEN {k} < {b!r}e0 OR {k} > {c!r}e0 THEN 'edge' ELSE 'inside' END FROM m WHERE {k} IS NOT NULL")
    return " UNION ALL ".join(out)


def _verdict_sql(k: str) -> str:
    a, u = checks.SUITABILITY[k]
    op = ">=" if a < u else "<="
    return f"CASE WHEN {k} {op} {u!r} THEN 'unmet' WHEN {k} {op} {a!r} THEN 'advisory' WHEN {k} IS NOT NULL THEN 'pass' END"


def _common_sql(code: str, which: int) -> str:
    return "CASE " + " ".join(f"WHEN {code} IN ({', '.join(map(str, v[which]))}) THEN '{k}'" for k, v in checks.COMMON_CLASSES.items()) + " END"


_TESTS = ", ".join(f"round({k}, 6) AS {k}, {_verdict_sql(k)} AS {k}_verdict" for k in checks.SUITABILITY)
_ITEMS = """items AS (SELECT event_id AS id, event_id % 360 - 180e0 AS west, event_id % 170 - 85e0 AS south, event_id % 360 - 178e0 AS east, event_id % 170 - 83e0 AS north, ts AS t, CASE WHEN event_id % 11 > 0 THEN event_id % 100 * 1e0 END AS cloud FROM events),
hit AS (SELECT * FROM items WHERE west <= 40 AND east >= 10 AND south <= 60 AND north >= 20 AND t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25')"""

ORACLE = {
    "outlet_check": f"""WITH {_NEAR}, n AS (SELECT id, max(upland_km2) AS largest, arg_min(upland_km2, km * 1e6 - upland_km2 * 1e-3) AS near_up, min(km) AS near_km FROM near WHERE km <= 0.6 AND id % 9 <> 4 GROUP BY 1),
b AS (SELECT s_suppkey AS id, abs(s_acctbal) / 8 + 1 AS a, n.* EXCLUDE (id) FROM supplier LEFT JOIN n ON n.id = s_suppkey), r AS (SELECT *, a / largest AS ratio, a / near_up AS own FROM b),
q AS (SELECT *, CASE WHEN largest IS NULL AND a BETWEEN 100 AND 1000 THEN 'orphan-outlet' WHEN largest IS NULL AND a > 1000 THEN 'no-reach-large' WHEN largest IS NULL THEN 'no-reach'
  WHEN near_km <= 0.1 AND near_up >= 10 AND own > 2 AND abs(ratio - 1) <= 0.25 AND largest > near_up * 2 THEN 'confluence-ambiguous' WHEN near_km <= 0.1 AND near_up >= 10 AND own < 0.5 THEN 'under-captured'
  WHEN ratio <= 2 THEN 'consistent' ELSE 'over-captured' END AS reason FROM r)
SELECT id, reason IN ('no-reach-large', 'no-reach', 'consistent') AS agrees, reason, ratio, own AS nearest_ratio,
  CASE WHEN reason IN ('confluence-ambiguous', 'under-captured') THEN near_up WHEN reason = 'over-captured' THEN largest END AS suggested_km2 FROM q""",
    "outlet_unit": f"""WITH {_UNITS}, i AS (SELECT outlet, min(unit) AS first FROM near WHERE inside GROUP BY 1), o AS (SELECT outlet, unit AS first FROM near WHERE km <= 5 QUALIFY row_number() OVER (PARTITION BY outlet ORDER BY km, unit) = 1),
f AS (SELECT o.outlet, coalesce(i.first, o.first) AS first, i.first IS NULL AS outside FROM o LEFT JOIN i ON i.outlet = o.outlet), g AS (SELECT f.*, n.up_area AS here FROM f JOIN near n ON n.outlet = f.outlet AND n.unit = f.first),
s AS (SELECT g.outlet, n.unit FROM g JOIN near n ON n.outlet = g.outlet AND n.km <= 1 AND n.up_area >= greatest(g.here, 1e-9) * 10 QUALIFY row_number() OVER (PARTITION BY g.outlet ORDER BY n.up_area DESC, n.unit) = 1),
w AS (SELECT g.outlet, n.unit FROM g JOIN near n ON n.outlet = g.outlet AND n.km <= 20 AND n.up_area >= greatest(g.here, 1e-9) * 10 QUALIFY row_number() OVER (PARTITION BY g.outlet ORDER BY n.up_area DESC, n.unit) = 1),
a AS (SELECT outlet, unit, row_number() OVER (PARTITION BY outlet ORDER BY up_area DESC, unit) AS r FROM near WHERE km <= 2 QUALIFY r <= 4),
c AS (SELECT g.outlet, coalesce(s.unit, g.first) AS unit, CASE WHEN s.unit IS NOT NULL THEN 'main-stem' WHEN outside THEN 'nearest' END AS snapped, CASE WHEN s.unit IS NULL THEN w.unit END AS off_channel
  FROM g LEFT JOIN s ON s.outlet = g.outlet LEFT JOIN w ON w.outlet = g.outlet)
SELECT c.*, coalesce((SELECT string_agg(CAST(a.unit AS VARCHAR), ',' ORDER BY a.r) FROM a WHERE a.outlet = c.outlet AND a.unit <> c.unit), '') AS alternatives FROM c""",
    "choose_backend": """WITH b AS (SELECT p_partkey AS id, p_size * 100e0 AS unit_km2, p_partkey % 3 > 0 AS agrees, CASE WHEN p_partkey % 3 = 0 THEN p_size * 90e0 END AS s, p_partkey % 5 / 2e0 AS reach_km, p_size * (p_partkey % 7 * 40e0) AS d FROM part)
SELECT id, CASE WHEN unit_km2 < 2000 THEN 'dem' WHEN NOT agrees AND s <= 5000 AND reach_km <= 1 AND d <= s * 2 AND d * 2 >= s THEN 'dem' ELSE 'units' END AS backend FROM b""",
    "suitability": f"""WITH {_CELLS}, s AS ({BASE['surfaces']}), j AS (SELECT c.v, c.size, s.slope FROM cells c JOIN s USING ("row", col)),
t AS (SELECT count(CASE WHEN v IS NOT NULL AND v + CAST(size % 9 = 0 AS INT) - v > 0.01 THEN 1 END) * 1e0 / count(v) * 100 AS filling, count(CASE WHEN slope < degrees(atan(4e0 / 30e0)) THEN 1 END) * 1e0 / count(slope) * 100 AS slope,
  (max(v) - min(v)) / 4 AS relief, 1.5e0 AS water, count(CASE WHEN v IS NULL THEN 1 END) * 1e0 / count(*) * 100 AS coverage FROM j), u AS (SELECT 0 AS layer, {_TESTS} FROM t)
SELECT *, CASE WHEN 'unmet' IN (filling_verdict, slope_verdict, relief_verdict, water_verdict, coverage_verdict) THEN 'LIMITED' WHEN 'advisory' IN (filling_verdict, slope_verdict, relief_verdict, water_verdict, coverage_verdict) THEN 'MODERATE' ELSE 'HIGH' END AS grade FROM u""",
    "landcover_agreement": f"""WITH c AS (SELECT p_type AS layer, ([10, 20, 30, 40, 50, 60, 70, 80, 90, 95])[p_size % 10 + 1] AS f, CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE ([2, 11, 11, 5, 7, 8, 9, 1, 4, 4])[p_size % 10 + 1] END AS s FROM part),
d AS (SELECT layer, {_common_sql('f', 0)} AS a, {_common_sql('s', 1)} AS b FROM c), g AS (SELECT layer, a, count(*) AS n, count(CASE WHEN a = b THEN 1 END) AS same FROM d WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
h AS (SELECT *, sum(n) OVER (PARTITION BY layer) AS cells FROM g), w AS (SELECT layer, a AS weakest FROM h WHERE n >= cells * 0.01 QUALIFY row_number() OVER (PARTITION BY layer ORDER BY same / CAST(n AS DOUBLE), a) = 1),
k AS (SELECT layer, CAST(sum(n) AS BIGINT) AS cells, sum(same) / CAST(sum(n) AS DOUBLE) AS agreement FROM h GROUP BY 1)
SELECT k.*, CASE WHEN agreement >= 0.8 THEN 'HIGH' WHEN agreement >= 0.65 THEN 'MODERATE' ELSE 'LIMITED' END AS grade, weakest FROM k JOIN w USING (layer)""",
    "terrain_quality": f"""WITH p AS ({BASE['position'].replace('- 2 AND', '- 1 AND').replace('+ 2 ', '+ 1 ')}), s AS ({BASE['surfaces']}),
k AS (SELECT p.layer, CASE WHEN roughness < 20 THEN 'flat' WHEN roughness < 100 THEN 'hilly' ELSE 'mountain' END AS class, count(*) AS cells, round(count(CASE WHEN slope < 0.3 THEN 1 END) / CAST(count(slope) AS DOUBLE), 6) AS below_floor
  FROM p JOIN s USING ("row", col) WHERE roughness IS NOT NULL GROUP BY ALL) SELECT *, round(cells / CAST(sum(cells) OVER () AS DOUBLE), 6) AS share FROM k""",
    "envelope_axes": f"WITH {_MEASURED} {_axes_sql()}",
    "envelope_position": f"""WITH {_MEASURED}, a AS ({_axes_sql()}), p AS (SELECT id, coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (position = 'outside'), '') AS outside, coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (position = 'edge'), '') AS edge FROM a GROUP BY 1)
SELECT id, CASE WHEN outside <> '' THEN 'outside' WHEN edge <> '' THEN 'edge' ELSE 'inside' END AS position, outside, edge FROM p""",
    "delineation_grade": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 3 = 0 THEN 'LIMITED' WHEN p_size * p_size * p_size >= 2000 THEN 'HIGH' ELSE 'MODERATE' END AS grade FROM part",
    "rainfall_extremes": f"""WITH a AS ({BASE['annual_total']}) SELECT count(*) AS n, CAST(sum(CAST(total AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS mean, min(total) AS least, (SELECT year FROM a ORDER BY total, year LIMIT 1) AS least_year,
  max(total) AS most, (SELECT year FROM a ORDER BY total DESC, year LIMIT 1) AS most_year FROM a""",
    "wet_season": f"WITH m AS ({BASE['monthly_climatology']}) SELECT (SELECT month FROM m ORDER BY mean DESC, month LIMIT 1) AS wettest_month, round(sum(mean) FILTER (month BETWEEN 6 AND 9) / sum(mean) * 100, 6) AS season_pct FROM m",
    "cell_trends": """WITH v AS (SELECT o_orderkey % 150 AS key, o_orderkey // 150 AS t, round(o_totalprice / 1e4) AS y FROM orders),
p AS (SELECT a.key, CAST(sum(sign(b.y - a.y)) AS BIGINT) AS s, round(quantile_cont((b.y - a.y) / (b.t - a.t), 0.5), 6) AS sen FROM v a JOIN v b ON a.key = b.key AND a.t < b.t GROUP BY 1),
m AS (SELECT key, y, count(*) AS m FROM v GROUP BY ALL), n AS (SELECT key, CAST(sum(m) AS BIGINT) AS n, sum(m * (m - 1) * (2 * m + 5)) AS tied FROM m GROUP BY 1),
q AS (SELECT key, n, s, (n * (n - 1) * (2 * n + 5) - tied) / 18e0 AS var, sen, abs(CASE WHEN var > 0 THEN (s - sign(s)) / sqrt(var) ELSE 0 END) AS z FROM p JOIN n USING (key) WHERE n >= 10),
-- the normal integral as a power series
i AS (SELECT key, CASE WHEN any_value(z) = 0 THEN 1 ELSE 1 - 2 * exp(-any_value(z) * any_value(z) / 2) / sqrt(2 * pi()) * sum(exp((2 * k + 1) * ln(z) - lgamma(2 * k + 3) + (k + 1) * ln(2e0) + lgamma(k + 2))) END AS p FROM (SELECT * FROM q WHERE z > 0), (SELECT unnest(range(150)) AS k) GROUP BY 1)
SELECT key, n, s, var, round(CASE WHEN var > 0 THEN (s - sign(s)) / sqrt(var) ELSE 0 END, 6) AS z, sen, CASE WHEN sen > 0 THEN 'increasing' WHEN sen < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  round(coalesce(p, 1), 6) AS p FROM q LEFT JOIN i USING (key)""",
    "trend_significance": f"""WITH k AS ({BASE['mann_kendall']}), q AS (SELECT *, round({series.two_sided_p_sql('z')}, 6) AS p FROM k), r AS (SELECT *, p < 0.05 AS significant FROM q)
SELECT *, CASE WHEN NOT significant THEN 'none' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(sen * 12, 6) AS slope FROM r""",
    "median_and_spread": """WITH q AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
d AS (SELECT o_orderpriority, quantile_cont(abs(o_totalprice - q[2]), 0.5) AS mad FROM orders JOIN q USING (o_orderpriority) GROUP BY 1)
SELECT o_orderpriority, n, round(q[1], 6) AS p25, round(q[2], 6) AS p50, round(q[3], 6) AS p75, round(mad, 6) AS mad FROM q JOIN d USING (o_orderpriority)""",
    "linear_fit": "SELECT p_brand, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part GROUP BY 1",
    "mann_whitney": f"""WITH v AS (SELECT CAST(p_size AS DOUBLE) AS v, p_brand < 'Brand#3' AS g FROM part), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS r FROM v),
s AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(r) FILTER (g) AS r1 FROM r), u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2e0 AS u FROM s), z AS (SELECT *, round((u - n1 * n2 / 2e0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12e0), 6) AS z FROM u)
SELECT *, round({series.two_sided_p_sql('z')}, 6) AS p FROM z""",
    "accuracy_by_size": """WITH e AS (SELECT CAST(floor(p_size * 10e0 / 100) AS BIGINT) AS band, (p_size * 10e0 + p_partkey % 5 - p_size * 10e0) / (p_size * 10e0) * 100 AS e FROM part)
SELECT band, count(*) AS n, round(quantile_cont(abs(e), 0.5), 6) AS median_error_pct, round(quantile_cont(e, 0.5), 6) AS median_signed_pct, round(count(CASE WHEN abs(e) <= 5 THEN 1 END) / CAST(count(*) AS DOUBLE) * 100, 6) AS within_5_pct,
  round(count(CASE WHEN abs(e) <= 20 THEN 1 END) / CAST(count(*) AS DOUBLE) * 100, 6) AS within_20_pct FROM e GROUP BY 1""",
    "as_of_reach": """WITH s AS (SELECT p_brand AS river, p_partkey * 11 % 1013 AS at, min(p_partkey) AS reach FROM part WHERE p_partkey % 5 = 0 GROUP BY ALL), r AS (SELECT p_brand AS river, p_partkey AS id, p_partkey * 7 % 1009 AS at FROM part)
SELECT river, id, r.at, coalesce((SELECT arg_max(reach, s.at) FROM s WHERE s.river = r.river AND s.at <= r.at), (SELECT arg_min(reach, s.at) FROM s WHERE s.river = r.river)) AS reach FROM r""",
    "missing_months": """WITH h AS (SELECT DISTINCT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS t FROM orders WHERE o_orderkey % 60 = 7), m AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS t)
SELECT series, m.t FROM (SELECT DISTINCT series FROM h), m WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.series = h.series AND x.t = m.t)""".replace("FROM (SELECT DISTINCT series FROM h), m", "FROM (SELECT DISTINCT series FROM h) h, m"),
    "river_measures": """WITH r AS (SELECT p_brand AS river, p_partkey AS seq, p_partkey * 3 % 101 * 1e0 AS x, p_partkey * 7 % 103 * 1e0 AS y, 2000e0 - p_partkey % 1000 AS z, p_size * 0.5e0 AS l, p_size % 5 AS o FROM part),
g AS (SELECT river, count(*) AS reaches, CAST(sum(CAST(l AS DECIMAL(28,6))) AS DOUBLE) AS length_km, max(o) AS highest_order, sqrt(pow(arg_max(x, seq) - arg_min(x, seq), 2) + pow(arg_max(y, seq) - arg_min(y, seq), 2)) AS s, arg_min(z, seq) - arg_max(z, seq) AS f FROM r GROUP BY 1)
SELECT river, reaches, length_km, round(s, 6) AS straight_km, round(length_km / nullif(s, 0), 6) AS sinuosity, highest_order, round(f, 6) AS relief_m, round(f / length_km, 6) AS gradient_m_per_km FROM g""",
    "profile_shape": """WITH p AS (SELECT p_brand AS river, CAST(p_partkey AS DOUBLE) AS x, 100000e0 / (p_partkey + 100) + p_size * 0.01e0 AS z FROM part),
w AS (SELECT *, lag(z) OVER l AS z0, lag(x) OVER l AS x0, lead(z) OVER l AS z1, lead(x) OVER l AS x1 FROM p WINDOW l AS (PARTITION BY river ORDER BY x)), e AS (SELECT river, arg_min(z, x) AS za, arg_max(z, x) AS zb, min(x) AS xa, max(x) AS xb FROM p GROUP BY 1),
g AS (SELECT w.*, za, zb, xa, xb, -(CASE WHEN x0 IS NULL THEN (z1 - z) / (x1 - x) WHEN x1 IS NULL THEN (z - z0) / (x - x0) ELSE ((x - x0) * (x - x0) * z1 + ((x1 - x) * (x1 - x) - (x - x0) * (x - x0)) * z - (x1 - x) * (x1 - x) * z0) / ((x - x0) * (x1 - x) * (x1 - x + x - x0)) END) AS fall,
  CASE WHEN x0 IS NOT NULL THEN ((z - zb) + (z0 - zb)) / 2 * (x - x0) END AS part FROM w JOIN e USING (river))
SELECT river, count(*) AS points, round(max(fall), 6) AS steepest, round(min(fall), 6) AS gentlest, round(quantile_cont(fall, 0.5), 6) AS median_fall, round((0.5 - sum(part) / (any_value(za - zb) * any_value(xb - xa))) * 2, 6) AS concavity,
  CASE WHEN count(CASE WHEN (x - xa) * 3 <= xb - xa THEN 1 END) > 1 THEN round((any_value(za) - arg_max(z, x) FILTER ((x - xa) * 3 <= xb - xa)) / any_value(za - zb) * 100, 6) END AS upper_third_pct, count(CASE WHEN z > z0 THEN 1 END) = 0 AS falls FROM g GROUP BY 1""",
    "tile_names": """WITH b AS (SELECT s_suppkey AS id, s_suppkey * 3.7e0 - 180 AS w, s_suppkey % 60 * 1.5e0 - 45 AS s, s_suppkey * 3.7e0 - 178.4e0 AS e, s_suppkey % 60 * 1.5e0 - 44.2e0 AS n FROM supplier),
r AS (SELECT id, CAST(unnest(generate_series(CAST(floor(s) AS BIGINT), CAST(floor(n) AS BIGINT))) AS INT) AS lat, w, e FROM b), t AS (SELECT id, lat, CAST(unnest(generate_series(CAST(floor(w) AS BIGINT), CAST(floor(e) AS BIGINT))) AS INT) AS lon FROM r),
p AS (SELECT *, CASE WHEN (lat + lon) % 3 = 0 THEN 'cop30' WHEN (lat + lon) % 2 = 0 THEN 'nasadem' END AS product FROM t)
SELECT id, lat, lon, product, CASE product WHEN 'cop30' THEN 'Copernicus_DSM_COG_10_' || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || '_00_' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') || '_00_DEM'
  WHEN 'nasadem' THEN 'NASADEM_HGT_' || CASE WHEN lat >= 0 THEN 'n' ELSE 's' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || CASE WHEN lon >= 0 THEN 'e' ELSE 'w' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') END AS tile FROM p""",
    "mosaic": """WITH c AS (SELECT 0 AS layer, CAST(p_partkey % 40 AS INT) AS "row", CAST(p_partkey % 37 % 9 AS INT) AS col, p_size AS r, CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS v FROM part)
SELECT layer, "row", col, first(v ORDER BY r, v) FILTER (v IS NOT NULL) AS value FROM c GROUP BY ALL""",
    "item_search": f"WITH {_ITEMS} SELECT id, cloud FROM hit WHERE coalesce(cloud < 40, true)",
    "item_search_report": f"WITH {_ITEMS} SELECT count(*) FILTER (coalesce(cloud < 0, true)) AS found, count(*) AS without_limit, min(cloud) AS least_cloud FROM hit",
    "band_values": """WITH s AS (SELECT p_type AS band, arg_min(p_size, p_partkey) / 100e0 AS sc, CASE WHEN min(p_partkey) % 2 = 0 THEN 0e0 ELSE -2e0 END AS o FROM part GROUP BY 1)
SELECT p_partkey AS cell, p_type AS band, CASE WHEN p_size <> 7 THEN p_size * sc + o END AS value FROM part JOIN s ON band = p_type""",
    "open_items": "SELECT l_orderkey AS item FROM lineitem GROUP BY 1 HAVING bool_and(l_orderkey * 7 % 23 <> l_partkey % 23)",
    "attributes": """SELECT p_partkey, 'tmp_dc_uyr' AS name, 'tmp' AS variable, 'upstream' AS extent, 'degC' AS unit, p_size / 10e0 AS value FROM part UNION ALL SELECT p_partkey, 'glc_cl_umj', 'glc', 'upstream', 'cl', p_size % 9 FROM part
UNION ALL SELECT p_partkey, 'pre_mm_uyr', 'pre', 'upstream', 'mm', p_retailprice FROM part""",
    "water_shares": "SELECT p_type AS layer, count(*) AS cells, avg(CAST(p_size * 5 >= 75 AS INT)) AS permanent, avg(CAST(p_size * 5 > 0 AND p_size * 5 < 75 AS INT)) AS seasonal FROM part WHERE p_size * 5 <= 100 GROUP BY 1",
    "indices": """SELECT p_partkey AS id, (p_size - p_partkey % 50 * 1e0) / nullif(p_size + p_partkey % 50 * 1e0, 0) AS ndvi, round(10 * log10(greatest(p_size / 1000e0, 1e-5)), 6) AS db,
  CASE WHEN p_partkey % 3 > 0 THEN greatest((p_size * 10e0 - (p_size * 4 + p_partkey % 200)) / 10, 0) END AS awc, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 10e0 END AS soil,
  CASE WHEN p_size > 30 THEN make_date(2000 + p_partkey % 20, 5, 1) ELSE make_date(1999 + p_partkey % 20, 11, 1) END AS from_day, CASE WHEN p_size > 30 THEN make_date(2000 + p_partkey % 20, 9, 30) ELSE make_date(2000 + p_partkey % 20, 2, 28) END AS to_day FROM part""",
    "licence_report": """WITH u AS (SELECT DISTINCT n_nationkey AS k, n_name AS key FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT key, CASE WHEN k % 6 <> 5 THEN 'L' || CAST(k % 4 AS VARCHAR) END AS licence, CASE WHEN k % 6 = 5 THEN 'unknown' WHEN k % 4 = 0 THEN 'non-commercial' WHEN k % 3 = 0 THEN 'no redistribution' END AS problem FROM u""",
    "ledger_state": """WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL), l AS (SELECT source AS url, doc_id, CASE WHEN doc_id % 3 > 0 THEN sha256(CASE WHEN doc_id % 2 > 0 THEN text ELSE 'old' END) END AS h FROM d WHERE doc_id % 5 <> 4 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1)
SELECT url, CASE WHEN l.doc_id % 7 = 3 THEN 'absent' WHEN h IS NULL THEN 'unverifiable' WHEN h = sha256(text) THEN 'unchanged' ELSE 'changed' END AS state FROM l JOIN d ON d.doc_id = l.doc_id""",
    "ragged_union": "SELECT s_suppkey AS id, s_acctbal AS rain, CAST(NULL AS VARCHAR) AS error FROM supplier UNION ALL SELECT n_nationkey, NULL, n_name FROM nation",
    "flat_rows": """SELECT s_suppkey, 'who.at.nation' AS parameter, CAST(s_nationkey AS VARCHAR) AS value FROM supplier UNION ALL SELECT s_suppkey, 'who.name', s_name FROM supplier UNION ALL SELECT s_suppkey, 'list', '[' || CAST(s_nationkey AS VARCHAR) || ']' FROM supplier""",
    "snow_sectors": f"""WITH {_CELLS}, s AS ({BASE['surfaces']}), j AS (SELECT ([ 'N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor((aspect + 22.5) / 45) AS INT) % 8 + 1] AS sector, area, size FROM cells JOIN s USING ("row", col) WHERE aspect IS NOT NULL AND v IS NOT NULL),
g AS (SELECT sector, CAST(sum(area) AS DOUBLE) AS km2, CAST(sum(CASE WHEN size % 7 = 0 THEN area ELSE 0 END) AS DOUBLE) AS covered_km2 FROM j GROUP BY 1)
SELECT 0 AS layer, *, round(covered_km2 / sum(covered_km2) OVER () * 100, 6) AS pct_of_cover, round(covered_km2 / km2 * 100, 6) AS pct_of_sector FROM g""",
    "terrain_stats": f"""WITH {_CELLS}, s AS ({BASE['surfaces']}) SELECT 0 AS layer, CAST(sum(area) FILTER (v IS NOT NULL) AS DOUBLE) AS area_km2, min(v) AS least, max(v) AS most, CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) / count(v) AS mean, round(max(v) - min(v), 6) AS relief, round(avg(slope), 6) AS mean_slope
  FROM cells JOIN s USING ("row", col)""",
    "reservoirs": """WITH k AS (SELECT c_custkey AS id, abs(c_acctbal) AS volume, c_custkey % 700 * 10e0 AS watershed, c_nationkey AS basin FROM customer WHERE c_custkey % 3 IN (1, 2)),
g AS (SELECT basin, count(*) AS reservoirs, max(watershed) AS largest_km2, CAST(sum(CAST(watershed AS DECIMAL(28,4))) AS DOUBLE) AS summed_km2 FROM k GROUP BY 1),
t AS (SELECT basin, string_agg(CAST(id AS VARCHAR), ',' ORDER BY volume DESC, id) AS top FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY basin ORDER BY volume DESC, id) <= 25) GROUP BY 1)
SELECT g.*, summed_km2 > 3000e0 + basin * 400 AS exceeds, top FROM g JOIN t USING (basin)""",
}
