"""Queries of morphometry and polygons over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import morphometry, polygons, rings
from freshet.plans.queries import _CELLS, _cells
from freshet.sources import ledger
from freshet.sources.grids import read


def _orders(spark, sf_dir):
    parts = read(spark, sf_dir, "part").where("p_size % 11 < 7 or p_size < 30")
    order = F.when(F.col("p_size") < 30, 1).when(F.col("p_size") < 42, 2).otherwise(3)
    return parts.groupBy(F.col("p_brand").alias("basin"), order.alias("order")).agg(F.count("*").alias("streams"), F.sum(F.floor("p_retailprice").cast("decimal(28,6)")).cast("double").alias("length"))


def _dims(spark, sf_dir):
    size = F.sum("p_size").cast("double")
    by = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("basin")).agg(size.alias("area_km2"), F.count("*").cast("double").alias("length_km"))
    return by.select(
        "basin", "area_km2", (F.sqrt("area_km2") * 5).alias("perimeter_km"), "length_km", (F.col("length_km") * 1.25).alias("stem_km"), F.col("length_km").alias("straight_km"),
        (F.col("length_km") * 40).alias("stream_km"), (F.col("length_km") + 900).alias("z_head"), F.lit(899.5).alias("z_mouth"),
    )


def morphometry_linear(spark, sf_dir):
    return morphometry.linear(_orders(spark, sf_dir), _dims(spark, sf_dir))


def morphometry_areal(spark, sf_dir):
    by = _orders(spark, sf_dir).groupBy("basin").agg(F.sum("streams").alias("streams"), F.max(F.when(F.col("order") == 1, F.col("streams"))).alias("first_order"))
    return morphometry.areal(by.join(_dims(spark, sf_dir), "basin"))


def morphometry_relief(spark, sf_dir):
    return morphometry.relief(read(spark, sf_dir, "part").select(F.col("p_brand").alias("basin"), F.when(F.col("p_size") % 13 != 0, F.col("p_retailprice")).alias("z")), _dims(spark, sf_dir))


def morphometry_warnings(spark, sf_dir):
    return morphometry.warnings(_orders(spark, sf_dir))


def basin_length(spark, sf_dir):
    k = F.col("p_partkey")
    return morphometry.basin_length(read(spark, sf_dir, "part").select(F.col("p_brand").alias("basin"), (k * 37 % 1501).alias("x"), (k * 53 % 977).alias("y")))


def _vertices(spark, sf_dir):
    """A quadrangle for each nation."""
    k = F.col("n_nationkey")
    corner = F.posexplode(F.array(*[F.struct(F.lit(a).alias("sx"), F.lit(b).alias("sy")) for a, b in ((-1, -1), (1, -2), (1, 1), (-2, 1))]))
    v = read(spark, sf_dir, "nation").select(k.alias("poly"), corner.alias("seq", "c"))
    p = F.col("poly")
    return v.select("poly", F.lit(0).alias("ring"), "seq", (p % 5 * 10.0 + F.col("c.sx") * (3.0 + p % 3)).alias("x"), (F.floor(p / 5) * 10.0 + F.col("c.sy") * (2.0 + p % 4)).alias("y"))


def _spots(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("id"), (k * 37 % 613 / 10 - 7).alias("x"), (k * 53 % 617 / 10 - 7).alias("y"))


def point_in_polygon(spark, sf_dir):
    return polygons.points_in(_spots(spark, sf_dir), polygons.edges(_vertices(spark, sf_dir)), 5.0)


def polygon_measures(spark, sf_dir):
    v = _vertices(spark, sf_dir)
    centre = v.groupBy("poly").agg(F.avg("x").alias("lon0"), F.avg("y").alias("lat0"))
    m = polygons.measures(polygons.edges(polygons.projected(v, centre)))
    return m.select("poly", F.round(F.col("area") / 1e6, 3).alias("area_km2"), F.round(F.col("perimeter") / 1e3, 3).alias("perimeter_km"), "box_efficiency")


def lines_meet(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = read(spark, sf_dir, "supplier").select(k.alias("id"), (k * 17 % 503 / 10).alias("x1"), (k * 29 % 499 / 10).alias("y1"), (k * 17 % 503 / 10 + k % 7 - 2.5).alias("x2"), (k * 29 % 499 / 10 + k % 5 - 1.3).alias("y2"))
    return polygons.lines_meet(lines, polygons.edges(_vertices(spark, sf_dir)), 5.0)


def _squares(spark, sf_dir):
    k = F.col("n_nationkey")
    corner = F.posexplode(F.array(*[F.struct(F.lit(a).alias("sx"), F.lit(b).alias("sy")) for a, b in ((0, 0), (10, 0), (10, 10), (0, 10))]))
    v = read(spark, sf_dir, "nation").select(k.alias("poly"), corner.alias("seq", "c"))
    return v.select("poly", F.lit(0).alias("ring"), "seq", (F.col("poly") % 5 * 10.0 + F.col("c.sx")).alias("x"), (F.floor(F.col("poly") / 5) * 10.0 + F.col("c.sy")).alias("y"))


def dissolve(spark, sf_dir):
    return polygons.dissolve(polygons.edges(_squares(spark, sf_dir)), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly"), F.col("n_regionkey").alias("grp")))


def clip_raster(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("x", F.col("col").cast("double")).withColumn("y", F.col("row").cast("double"))
    return polygons.clip(cells, polygons.edges(_vertices(spark, sf_dir)), 12, 5.0)


def mask_outline(spark, sf_dir):
    return polygons.mask_outline(_cells(spark, sf_dir), F.col("size") % 3 == 0)


def _ring_areas(made):
    """poly, shells, holes and area of rings."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    each = rings.edges(made).groupBy("poly", "ring").agg((F.sum(cross) / 2).alias("area"))
    return each.groupBy("poly").agg(F.count_if(F.col("area") > 0).alias("shells"), F.count_if(F.col("area") < 0).alias("holes"), F.round(F.sum("area"), 6).alias("area"))


def mask_rings(spark, sf_dir):
    """Shells and area of the rings about a mask: as many shells as pieces that hang together by sides of cells."""
    return _ring_areas(rings.assemble(polygons.mask_outline(_cells(spark, sf_dir), F.col("size") % 3 != 0))).drop("holes")


def _bricks(spark, sf_dir):
    """A wall of bricks, one for each supplier, every other course shifted by half a brick and a millionth off."""
    k = F.col("s_suppkey")
    course, at = F.floor(k / 10), k % 10
    corner = F.posexplode(F.array(*[F.struct(F.lit(a).alias("sx"), F.lit(b).alias("sy")) for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0))]))
    v = read(spark, sf_dir, "supplier").select(k.alias("poly"), course.alias("course"), at.alias("at"), corner.alias("seq", "c"))
    return v.select("poly", F.lit(0).alias("ring"), "seq", (F.col("at") * 2 + F.col("course") % 2 + F.col("at") % 3 * 1e-6 + F.col("c.sx")).alias("x"), (F.col("course") + F.col("c.sy")).alias("y"))


def union_features(spark, sf_dir):
    """Bricks of each nation to a union, to rings, to GeoJSON and back: parts, holes and area."""
    group = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("poly"), (F.col("s_suppkey") % 7 % 2).alias("grp"))
    made = rings.assemble(rings.union(polygons.edges(_bricks(spark, sf_dir)), group))
    text = ledger.features(made, group.select(F.col("grp").alias("poly")).distinct().withColumn("name", F.concat(F.lit("g"), "poly")))
    found = _ring_areas(ledger.read_features(text))
    return found.select("poly", F.round("area", 3).alias("area"))


QUERIES = {
    f.__name__: f
    for f in (morphometry_linear, morphometry_areal, morphometry_relief, morphometry_warnings, basin_length, point_in_polygon, polygon_measures, lines_meet, dissolve, clip_raster, mask_outline, mask_rings, union_features)
}

_ORDERS = """o AS (SELECT p_brand AS basin, CAST(CASE WHEN p_size < 30 THEN 1 WHEN p_size < 42 THEN 2 ELSE 3 END AS INT) AS "order", count(*) AS streams, CAST(sum(CAST(floor(p_retailprice) AS DECIMAL(28,6))) AS DOUBLE) AS length
  FROM part WHERE p_size % 11 < 7 OR p_size < 30 GROUP BY ALL)"""
_DIMS = """b AS (SELECT p_brand AS basin, CAST(sum(p_size) AS DOUBLE) AS area_km2, CAST(count(*) AS DOUBLE) AS length_km FROM part GROUP BY 1),
d AS (SELECT basin, area_km2, sqrt(area_km2) * 5 AS perimeter_km, length_km, length_km * 1.25e0 AS stem_km, length_km AS straight_km, length_km * 40 AS stream_km, length_km + 900 AS z_head, 899.5e0 AS z_mouth FROM b)"""
_VERTICES = """v AS (SELECT n_nationkey AS poly, 0 AS ring, seq, n_nationkey % 5 * 10e0 + sx * (3e0 + n_nationkey % 3) AS x, floor(n_nationkey / 5) * 10e0 + sy * (2e0 + n_nationkey % 4) AS y
  FROM nation, (VALUES (0, -1, -1), (1, 1, -2), (2, 1, 1), (3, -2, 1)) c(seq, sx, sy)),
e AS (SELECT a.poly, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.poly = b.poly AND b.seq = (a.seq + 1) % 4)"""
_SPOTS = "s AS (SELECT p_partkey AS id, p_partkey * 37 % 613 / 10e0 - 7 AS x, p_partkey * 53 % 617 / 10e0 - 7 AS y FROM part)"
_HIT = "(y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1"


def _side(p: str, q: str, r: str) -> str:
    return f"sign(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"


def _areal_sql() -> str:
    dd, fs = "(stream_km / area_km2)", "(streams / area_km2)"
    found = {
        "drainage_density": dd, "stream_frequency": fs, "drainage_texture": "streams / perimeter_km", "texture_ratio": "first_order / perimeter_km", "form_factor": "area_km2 / (length_km * length_km)",
        "elongation_ratio": "2 * sqrt(area_km2 / pi()) / length_km", "circularity_ratio": "4 * pi() * area_km2 / (perimeter_km * perimeter_km)", "compactness": "0.2821e0 * perimeter_km / sqrt(area_km2)",
        "shape_factor": "length_km * length_km / area_km2", "lemniscate_ratio": "length_km * length_km / (4 * area_km2)", "channel_maintenance": "area_km2 / stream_km", "infiltration_number": f"{dd} * {fs}",
        "drainage_intensity": "streams / stream_km", "length_area_relation": "1.4e0 * pow(area_km2, 0.6e0)", "fitness_ratio": "stem_km / perimeter_km", "wandering_ratio": "stem_km / length_km",
    }
    return ", ".join(f"round({e}, 6) AS {k}" for k, e in found.items())


_X, _Y = polygons.equal_area_sql("v.x", "v.y", "lon0", "lat0")
_MARKS = ", ".join(repr(1 - k / 64) for k in range(65))

ORACLE = {
    "morphometry_linear": f"""WITH {_ORDERS}, {_DIMS}, p AS (SELECT *, CAST(streams AS DOUBLE) / nullif(lead(streams) OVER w, 0) AS rb, CAST(streams AS DOUBLE) + lead(streams) OVER w AS weight,
  (length / streams) / nullif(lag(length) OVER w / nullif(lag(streams) OVER w, 0), 0) AS rl FROM o WINDOW w AS (PARTITION BY basin ORDER BY "order")),
m AS (SELECT basin, count(*) AS orders, max("order") AS highest_order, CAST(sum(streams) AS BIGINT) AS streams, CAST(sum(CAST(length AS DECIMAL(28,6))) AS DOUBLE) AS stream_km,
  round(avg(rb), 6) AS mean_rb, round(sum(rb * weight) / sum(CASE WHEN rb IS NOT NULL THEN weight END), 6) AS weighted_rb, round(avg(rl), 6) AS mean_rl FROM p GROUP BY 1)
SELECT m.*, round(mean_rl / mean_rb, 6) AS rho, round(area_km2 / (2 * m.stream_km), 6) AS overland_km, length_km, perimeter_km, stem_km, round(stem_km / straight_km, 6) AS sinuosity FROM m JOIN d USING (basin)""",
    "morphometry_areal": f"""WITH {_ORDERS}, {_DIMS}, n AS (SELECT basin, CAST(sum(streams) AS DOUBLE) AS streams, max(CASE WHEN "order" = 1 THEN streams END) AS first_order FROM o GROUP BY 1)
SELECT basin, area_km2, {_areal_sql()} FROM n JOIN d USING (basin)""",
    "morphometry_relief": f"""WITH {_DIMS}, c AS (SELECT p_brand AS basin, CASE WHEN p_size % 13 <> 0 THEN p_retailprice END AS z FROM part),
s AS (SELECT basin, min(z) AS z_min, max(z) AS z_max, CAST(sum(CAST(z AS DECIMAL(28,6))) AS DOUBLE) / count(z) AS z_mean, quantile_cont(z, [{_MARKS}]) AS q FROM c WHERE z IS NOT NULL GROUP BY 1),
r AS (SELECT s.*, d.*, z_max - z_min AS relief, (list_sum(q) - (q[1] + q[65]) / 2) / 64 AS area FROM s JOIN d USING (basin))
SELECT basin, z_min, z_max, round(z_mean, 6) AS z_mean, round(relief, 6) AS relief, round(relief / 1000 / length_km, 6) AS relief_ratio, round(relief / (perimeter_km * 1000) * 100, 6) AS relative_relief,
  round(relief / 1000 * stream_km / area_km2, 6) AS ruggedness, round(relief / 1000 / sqrt(area_km2), 6) AS melton, round((area - z_min) / relief, 6) AS hypsometric_integral,
  round((z_mean - z_min) / relief, 6) AS elevation_relief_ratio, round(z_head - z_mouth, 6) AS channel_relief, round((z_head - z_mouth) / stem_km, 6) AS channel_gradient FROM r""",
    "morphometry_warnings": f"""WITH {_ORDERS}, p AS (SELECT *, lead(streams) OVER (PARTITION BY basin ORDER BY "order") AS ahead FROM o)
SELECT basin, 'bifurcation_ratio_floor' AS "check", 'impossible' AS severity, "order" FROM p WHERE ahead > 0 AND streams < 2 * ahead
UNION ALL SELECT basin, 'single_highest_order_stream', 'impossible', "order" FROM p WHERE ahead IS NULL AND streams > 1
UNION ALL SELECT basin, 'bifurcation_ratio_range', 'unusual', NULL FROM p GROUP BY basin HAVING avg(CAST(streams AS DOUBLE) / ahead) NOT BETWEEN 3 AND 5""",
    "basin_length": """WITH p AS (SELECT p_brand AS basin, CAST(p_partkey * 37 % 1501 AS DOUBLE) AS x, CAST(p_partkey * 53 % 977 AS DOUBLE) AS y FROM part)
SELECT a.basin, round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS length FROM p a JOIN p b ON a.basin = b.basin GROUP BY 1""",
    "point_in_polygon": f"WITH {_VERTICES}, {_SPOTS} SELECT id, poly FROM s, e WHERE {_HIT} GROUP BY ALL HAVING count(*) % 2 = 1",
    "polygon_measures": f"""WITH {_VERTICES}, c AS (SELECT poly, avg(x) AS lon0, avg(y) AS lat0 FROM v GROUP BY 1), q AS (SELECT v.poly, seq, {_X} AS x, {_Y} AS y FROM v JOIN c ON v.poly = c.poly WHERE lon0 BETWEEN -180 AND 180 AND lat0 BETWEEN -90 AND 90),
m AS (SELECT a.poly, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area, sum(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))) AS perimeter, (max(a.x) - min(a.x)) * (max(a.y) - min(a.y)) AS box FROM q a JOIN q b ON a.poly = b.poly AND b.seq = (a.seq + 1) % 4 GROUP BY 1)
SELECT poly, round(area / 1e6, 3) AS area_km2, round(perimeter / 1e3, 3) AS perimeter_km, round(area / box, 6) AS box_efficiency FROM m""",
    "lines_meet": f"""WITH {_VERTICES}, l AS (SELECT s_suppkey AS id, s_suppkey * 17 % 503 / 10e0 AS a1, s_suppkey * 29 % 499 / 10e0 AS b1, s_suppkey * 17 % 503 / 10e0 + s_suppkey % 7 - 2.5e0 AS a2, s_suppkey * 29 % 499 / 10e0 + s_suppkey % 5 - 1.3e0 AS b2 FROM supplier),
s AS (SELECT id, a1 AS x, b1 AS y FROM l)
SELECT id, poly FROM l, e WHERE {_side(('a1', 'b1'), ('a2', 'b2'), ('x1', 'y1'))} * {_side(('a1', 'b1'), ('a2', 'b2'), ('x2', 'y2'))} <= 0 AND {_side(('x1', 'y1'), ('x2', 'y2'), ('a1', 'b1'))} * {_side(('x1', 'y1'), ('x2', 'y2'), ('a2', 'b2'))} <= 0
  AND greatest(least(a1, a2), least(x1, x2)) <= least(greatest(a1, a2), greatest(x1, x2)) AND greatest(least(b1, b2), least(y1, y2)) <= least(greatest(b1, b2), greatest(y1, y2))
UNION (SELECT id, poly FROM s, e WHERE {_HIT} GROUP BY ALL HAVING count(*) % 2 = 1)""",
    "dissolve": """WITH q AS (SELECT n_regionkey AS poly, n_nationkey % 5 * 10e0 AS x, floor(n_nationkey / 5) * 10e0 AS y FROM nation),
s AS (SELECT poly, x + a AS x1, y + b AS y1, x + c AS x2, y + d AS y2 FROM q, (VALUES (0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0)) t(a, b, c, d))
SELECT poly, 0 AS ring, x1, y1, x2, y2 FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.poly = b.poly AND a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1)""",
    "clip_raster": f"""WITH {_CELLS}, {_VERTICES}, i AS (SELECT "row", col FROM (SELECT "row", col, CAST(col AS DOUBLE) AS x, CAST("row" AS DOUBLE) AS y FROM cells), e WHERE poly = 12 AND {_HIT} GROUP BY ALL HAVING count(*) % 2 = 1),
f AS (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM i)
SELECT layer, c."row", c.col, CASE WHEN i.col IS NOT NULL THEN v END AS value FROM cells c JOIN f ON c."row" BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1 LEFT JOIN i ON i."row" = c."row" AND i.col = c.col""",
    "mask_rings": f"""WITH RECURSIVE {_CELLS}, a AS (SELECT "row" AS r, col AS k FROM cells WHERE size % 3 <> 0),
l(r, k, c) USING KEY (r, k) AS (SELECT r, k, r * 100 + k FROM a UNION SELECT b.r, b.k, min(l.c) FROM l JOIN a b ON b.r BETWEEN l.r - 1 AND l.r + 1 AND b.k BETWEEN l.k - 1 AND l.k + 1 AND abs(b.r - l.r) + abs(b.k - l.k) = 1
  JOIN recurring.l now ON now.r = b.r AND now.k = b.k WHERE l.c < now.c GROUP BY b.r, b.k)
SELECT 0 AS poly, count(DISTINCT c) AS shells, CAST(count(*) AS DOUBLE) AS area FROM l""",
    "union_features": "SELECT s_suppkey % 7 % 2 AS poly, CAST(count(*) * 2 AS DOUBLE) AS area FROM supplier GROUP BY 1",
    "mask_outline": f"""WITH {_CELLS}, s AS (SELECT layer AS poly, CAST(col + a AS DOUBLE) AS x1, CAST(b - "row" - 1 AS DOUBLE) AS y1, CAST(col + c AS DOUBLE) AS x2, CAST(d - "row" - 1 AS DOUBLE) AS y2
  FROM cells, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) t(a, b, c, d) WHERE size % 3 = 0)
SELECT poly, 0 AS ring, x1, y1, x2, y2 FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1)""",
}
