"""Queries of terrain and routing trees over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import flow, focal, landscape, network, routing
from freshet.plans.queries import _CELLS, _TREE, _cells, _relief, _tree
from freshet.plans.queries import ORACLE as BASE
from freshet.sources.grids import read


def curvature(spark, sf_dir):
    return focal.curvature(_cells(spark, sf_dir))


def wetness(spark, sf_dir):
    return focal.wetness(_cells(spark, sf_dir), F.col("size"))


def level_surface(spark, sf_dir):
    return focal.level_surface(_cells(spark, sf_dir), smooth=12.0, spread=99.0, least_km2=0.5)


def sub_basins(spark, sf_dir):
    return network.sub_basins(_tree(spark, sf_dir), spark.range(3, 9))


def flow_accumulation(spark, sf_dir):
    return network.accumulate(_tree(spark, sf_dir), F.col("area"))


def arc_hydro(spark, sf_dir):
    return network.arc_hydro(_tree(spark, sf_dir))


def unit_setting(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return network.unit_setting(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), size.alias("sub_area"), (size + F.col("p_partkey") % 3 * 0.4).alias("up_area"), (F.col("p_partkey") % 4).alias("endo"), (F.col("p_partkey") % 7 - 5).alias("coast")))


def largest_units(spark, sf_dir):
    return network.largest(_tree(spark, sf_dir).select("id", "area"), "area", 25)


def _channel(spark, sf_dir):
    """The tree as cells of a routed raster: elevation falls with depth of the key, areas are whole m2."""
    size = F.col("p_size").cast("double")
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("id"), F.when(key > 0, F.floor((key - 1) / 3).cast("long")).alias("next"), (F.sqrt(key.cast("double")) * 20 + F.col("p_size") % 7).alias("z"),
        (size * size * 1e4 + 5e5).alias("area_m2"), (size + 30).alias("step_m"),
    )


def steepness(spark, sf_dir):
    return landscape.steepness(_channel(spark, sf_dir))


def steepness_fit(spark, sf_dir):
    return landscape.steepness_fit(_channel(spark, sf_dir), 5)


def concavity(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select((F.col("p_partkey") * 5e4 + 1e6).alias("area_m2"), (F.pow(F.col("p_partkey") * 5e4 + 1e6, F.lit(-0.45)) * (1 + F.col("p_size") / 50)).alias("slope"))
    return landscape.concavity(parts)


def steepness_summary(spark, sf_dir):
    return landscape.steepness_summary(landscape.steepness(_channel(spark, sf_dir)))


def trunk(spark, sf_dir):
    return landscape.trunk(_channel(spark, sf_dir), 6.0e5)


def initiation(spark, sf_dir):
    return landscape.initiation(focal.surfaces(_cells(spark, sf_dir)))


def density_curve(spark, sf_dir):
    c = _channel(spark, sf_dir)
    return landscape.density_curve(c.select((F.col("area_m2") / 1e6).alias("drained_km2"), "step_m", F.lit(0.25).alias("area_km2")), 1.0)


def snap_to_stream(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("row", "col", F.when(F.col("size") % 6 != 0, F.col("size").cast("double")).alias("up_km2"))
    outlets = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("outlet"), (F.col("s_suppkey") * 7 % 40).cast("int").alias("row"), (F.col("s_suppkey") * 11 % 50).cast("int").alias("col"))
    return landscape.snap_to_stream(outlets, cells, 40, 50, reach=3, least_km2=30.0)


def link_lengths(spark, sf_dir):
    c = _cells(spark, sf_dir).select(F.col("key").alias("id"), F.when(F.col("key") >= 51, F.col("key") - 50 - F.col("size") % 2).alias("next"), "row", "col")
    return landscape.link_lengths(c, F.lit(787.0), F.lit(1105.74))


def knickpoints(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    z = F.col("p_partkey") * 0.05 + F.col("p_partkey") * 37 % 11 * 0.25 + F.when(F.col("p_partkey") % 1000 > 500, 120.0).otherwise(0.0)
    z = F.when(F.col("p_partkey") % 17 != 0, z)  # some heights are missing
    return landscape.knickpoints(parts.select(F.col("p_brand").alias("trunk"), F.col("p_partkey").cast("double").alias("chi"), z.alias("z")))


def depression_fill(spark, sf_dir):
    return routing.fill(_relief(spark, sf_dir), 32)


def _routed(spark, sf_dir):
    return flow.route(routing.fill(_relief(spark, sf_dir), 32), 32)


def flow_routing(spark, sf_dir):
    return flow.cells(_routed(spark, sf_dir), 32)


def height_above_drainage(spark, sf_dir):
    return flow.height_above_drainage(_routed(spark, sf_dir), 100, 32)


def stream_mask(spark, sf_dir):
    return flow.streams(_routed(spark, sf_dir), 40.0, 32, lambda row: 0.5 + row % 8 / 8)


def pour_point_basins(spark, sf_dir):
    """Cells and drained cells of the basin of each outlet: the channel cells with the most above them in each square of the grid."""
    tiles = _routed(spark, sf_dir)
    square = [F.floor(F.col(c) / 25) for c in ("row", "col")]
    cells = flow.cells(tiles, 32)
    best = cells.where("area >= 30").groupBy("layer", *square).agg(F.max(F.struct("area", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("b"))
    outlets = best.select("layer", (-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col")).withColumn("outlet", F.col("row") * 100 + F.col("col"))
    own = flow.basins(tiles, outlets, 32).groupBy("layer", "outlet").agg(F.count("*").alias("own_cells"))
    return own.join(outlets, ["layer", "outlet"]).join(cells.select("layer", "row", "col", "area"), ["layer", "row", "col"]).select("layer", "outlet", "own_cells", "area")


def stream_burning(spark, sf_dir):
    k = F.col("s_suppkey")
    at = F.explode(F.sequence(F.lit(0), F.lit(14)))
    paths = read(spark, sf_dir, "supplier").select(F.lit(0).alias("layer"), k.alias("line"), at.alias("seq"), (k * 7 % 40).cast("int").alias("r"), (k * 11 % 50).cast("int").alias("c"))
    paths = paths.select("layer", "line", "seq", (F.col("r") + F.floor(F.col("seq") / 3)).cast("int").alias("row"), (F.col("c") + F.col("seq")).alias("col"))
    burnt = routing.burn(_cells(spark, sf_dir).select("layer", "row", "col", "value"), paths, 20.0, 0.25)
    return burnt.select("layer", "row", "col", F.round("value", 6).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        curvature, wetness, level_surface, sub_basins, flow_accumulation, arc_hydro, unit_setting, largest_units, steepness, steepness_fit, concavity,
        steepness_summary, trunk, initiation, density_curve, snap_to_stream, link_lengths, knickpoints, depression_fill, stream_burning, flow_routing, height_above_drainage, stream_mask, pour_point_basins,
    )
}

_CHANNEL = """ch AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS next, sqrt(CAST(p_partkey AS DOUBLE)) * 20 + p_size % 7 AS z,
  CAST(p_size AS DOUBLE) * p_size * 1e4 + 5e5 AS area_m2, CAST(p_size AS DOUBLE) + 30 AS step_m FROM part)"""


def _second(src: str, of: str) -> str:
    """Differences of column `of` of src along rows (gx) and columns (gy), as rows with k."""
    return f"""SELECT c.layer, c."row", c.col, c.dx,
  CASE WHEN c.{of[0]} IS NULL OR (e.k IS NULL AND w.k IS NULL) THEN NULL WHEN w.k IS NULL THEN e.{of[0]} - c.{of[0]} WHEN e.k IS NULL THEN c.{of[0]} - w.{of[0]} ELSE (e.{of[0]} - w.{of[0]}) / 2 END / c.dx AS gx,
  -(CASE WHEN c.{of[1]} IS NULL OR (s.k IS NULL AND n.k IS NULL) THEN NULL WHEN n.k IS NULL THEN s.{of[1]} - c.{of[1]} WHEN s.k IS NULL THEN c.{of[1]} - n.{of[1]} ELSE (s.{of[1]} - n.{of[1]}) / 2 END) / 1105.74e0 AS gy, 1 AS k
  FROM {src} c LEFT JOIN {src} e ON e."row" = c."row" AND e.col = c.col + 1 LEFT JOIN {src} w ON w."row" = c."row" AND w.col = c.col - 1
  LEFT JOIN {src} s ON s."row" = c."row" + 1 AND s.col = c.col LEFT JOIN {src} n ON n."row" = c."row" - 1 AND n.col = c.col"""


_GRAD = f"{_CELLS}, ck AS (SELECT *, 1 AS k FROM cells), g1 AS ({_second('ck', ('v', 'v'))})"
_ORDERED = f"""WITH RECURSIVE {_CHANNEL}, w AS (SELECT id, CAST(0 AS DOUBLE) AS chi, CAST(0 AS DOUBLE) AS dist_out FROM ch WHERE next IS NULL UNION ALL
  SELECT c.id, w.chi + pow(1e6 / c.area_m2, 0.45e0) * c.step_m, w.dist_out + c.step_m FROM w JOIN ch c ON c.next = w.id),
st AS (SELECT c.id, c.area_m2, CASE WHEN c.area_m2 >= 1e6 THEN round(w.chi, 6) END AS chi, round(w.dist_out, 6) AS dist_out,
  CASE WHEN c.area_m2 >= 1e6 THEN round(greatest(c.z - d.z, 0) / c.step_m, 9) END AS slope,
  CASE WHEN c.area_m2 >= 1e6 THEN round(greatest(c.z - d.z, 0) / c.step_m * pow(c.area_m2, 0.45e0), 6) END AS ksn FROM ch c JOIN w USING (id) LEFT JOIN ch d ON c.next = d.id)"""

_FILLED = """c AS (SELECT CAST(o_orderkey // 100 AS INT) AS r, CAST(o_orderkey % 100 AS INT) AS k, o_totalprice AS z FROM orders WHERE o_totalprice IS NOT NULL),
nb AS MATERIALIZED (SELECT a.r AS ar, a.k AS ak, b.r AS br, b.k AS bk, b.z AS zb FROM c a, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(dr, dk), c b WHERE b.r = a.r + dr AND b.k = a.k + dk),
rim AS (SELECT r, k, z FROM c LEFT JOIN (SELECT ar, ak, count(*) AS n FROM nb GROUP BY ALL) ON ar = r AND ak = k WHERE coalesce(n, 0) < 8),
lev(r, k, l) USING KEY (r, k) AS (SELECT r, k, z FROM rim UNION
  SELECT nb.br, nb.bk, min(greatest(nb.zb, lev.l)) FROM lev JOIN nb ON nb.ar = lev.r AND nb.ak = lev.k LEFT JOIN recurring.lev now ON now.r = nb.br AND now.k = nb.bk
  WHERE now.l IS NULL OR greatest(nb.zb, lev.l) < now.l GROUP BY nb.br, nb.bk)"""


def _spread(name: str, start: str) -> str:
    """Steps over cells of one level from those of `start`."""
    return f"""{name}(r, k, d) USING KEY (r, k) AS (SELECT r, k, 0 FROM ({start}) UNION
  SELECT n.br, n.bk, min({name}.d) + 1 FROM {name} JOIN n ON n.ar = {name}.r AND n.ak = {name}.k AND n.la = n.lb LEFT JOIN recurring.{name} now ON now.r = n.br AND now.k = n.bk
  WHERE now.d IS NULL OR {name}.d + 1 < now.d GROUP BY n.br, n.bk)"""


_ROUTED = f"""{_FILLED},
n AS MATERIALIZED (SELECT ar, ak, br, bk, x.l AS la, y.l AS lb, (x.l - y.l) / CASE WHEN ar = br OR ak = bk THEN 1e0 ELSE sqrt(2e0) END AS fall, (br - ar) * 3 + bk - ak AS o
  FROM nb JOIN lev x ON x.r = ar AND x.k = ak JOIN lev y ON y.r = br AND y.k = bk),
steep AS MATERIALIZED (SELECT ar AS r, ak AS k, br, bk FROM n WHERE fall > 0 QUALIFY row_number() OVER (PARTITION BY ar, ak ORDER BY fall DESC, o) = 1),
{_spread("low", "SELECT r, k FROM steep UNION SELECT r, k FROM rim")}, {_spread("high", "SELECT DISTINCT ar AS r, ak AS k FROM n WHERE lb > la")},
flat AS (SELECT ar AS r, ak AS k, br, bk FROM n JOIN low a ON a.r = ar AND a.k = ak AND a.d > 0 JOIN low b ON b.r = br AND b.k = bk LEFT JOIN high h ON h.r = br AND h.k = bk
  WHERE la = lb QUALIFY row_number() OVER (PARTITION BY ar, ak ORDER BY 2 * b.d - coalesce(h.d, 0), o) = 1),
down AS MATERIALIZED (SELECT * FROM steep UNION ALL SELECT * FROM flat),
walk AS (SELECT r, k, r AS r1, k AS k1, 0 AS s FROM lev UNION ALL SELECT w.r, w.k, d.br, d.bk, s + 1 FROM walk w JOIN down d ON d.r = w.r1 AND d.k = w.k1),
area AS (SELECT r1 AS r, k1 AS k, count(*) AS n FROM walk GROUP BY ALL)"""

ORACLE = {
    "curvature": f'WITH {_GRAD}, g2 AS ({_second("g1", ("gx", "gy"))}) SELECT layer, "row", col, round(gx + gy, 9) + 0 AS laplacian FROM g2',
    "wetness": f"""WITH {_GRAD} SELECT g1.layer, g1."row", g1.col, CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN
  round(ln((size + 1) * sqrt(g1.dx * 1105.74e0) / greatest(sqrt(gx * gx + gy * gy), tan(radians(0.01e0)))), 6) END AS twi FROM g1 JOIN cells USING ("row", col)""",
    "level_surface": f"""WITH RECURSIVE {_CELLS}, p AS ({BASE['position']}), f AS (SELECT c."row", c.col, c.v, c.area, c.key FROM cells c JOIN p USING ("row", col) WHERE p.roughness < 12),
e AS (SELECT a.key AS a, b.key AS b FROM f a JOIN f b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1),
r AS (SELECT key AS a, key AS c FROM f UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a WHERE r.c < e.b),
m AS (SELECT a, min(c) AS body FROM r GROUP BY 1),
b AS (SELECT body, CAST(sum(area) AS DOUBLE) AS area_km2, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.98) AS hi FROM f JOIN m ON a = key GROUP BY 1)
SELECT 0 AS layer, area_km2, round(mid, 6) AS elevation FROM b WHERE area_km2 >= 0.5 AND hi - lo <= 99 ORDER BY area_km2 DESC, mid DESC LIMIT 1""",
    "sub_basins": f"WITH RECURSIVE {_TREE}, w AS (SELECT id, id AS outlet FROM tree WHERE id BETWEEN 3 AND 8 UNION ALL SELECT t.id, w.outlet FROM w JOIN tree t ON t.next = w.id WHERE t.id NOT BETWEEN 3 AND 8) SELECT id, outlet FROM w",
    "flow_accumulation": f"WITH RECURSIVE {_TREE}, w AS (SELECT id, id AS top, area FROM tree UNION ALL SELECT t.next, w.top, w.area FROM w JOIN tree t ON t.id = w.id WHERE t.next IS NOT NULL) SELECT id, CAST(sum(area) AS DOUBLE) AS total FROM w GROUP BY 1",
    "arc_hydro": f"WITH {_TREE}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS num FROM tree) SELECT a.num AS hydro_id, CAST(a.id AS VARCHAR) AS hydro_code, coalesce(b.num, -1) AS next_down_id, CAST(a.area AS DOUBLE) AS area_km2 FROM n a LEFT JOIN n b ON a.next = b.id",
    "unit_setting": """SELECT p_partkey AS id, p_size + p_partkey % 3 * 0.4e0 AS up_area, p_partkey % 4 > 0 AS endorheic, p_partkey % 7 - 5 > 0 AS coastal,
  abs(p_size + p_partkey % 3 * 0.4e0 - p_size) < 0.51 AS nothing_upstream FROM part""",
    "largest_units": f"WITH {_TREE}, r AS (SELECT id, area, CAST(row_number() OVER (ORDER BY area DESC, id) AS INT) AS place FROM tree) SELECT * FROM r WHERE place <= 25",
    "steepness": f"{_ORDERED} SELECT id, area_m2, chi, dist_out, slope, ksn FROM st",
    "steepness_fit": f"""WITH RECURSIVE {_CHANNEL}, main AS (SELECT next AS id, arg_max(id, (area_m2, id)) AS up FROM ch WHERE next IS NOT NULL GROUP BY 1),
d AS (SELECT id, next AS b, 1 AS k FROM ch WHERE next IS NOT NULL UNION ALL SELECT d.id, c.next, k + 1 FROM d JOIN ch c ON c.id = d.b WHERE k < 5 AND c.next IS NOT NULL),
u AS (SELECT id, up AS b, 1 AS k FROM main UNION ALL SELECT u.id, m.up, k + 1 FROM u JOIN main m ON m.id = u.b WHERE k < 5),
f AS (SELECT w.id, CAST(sum(CAST(z AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS z FROM (SELECT id, b FROM d UNION ALL SELECT id, b FROM u UNION ALL SELECT id, id FROM ch) w JOIN ch c ON c.id = b GROUP BY 1),
s AS (SELECT c.id, area_m2, CASE WHEN area_m2 >= 1e6 THEN greatest(f.z - g.z, 0) / step_m END AS slope FROM ch c JOIN f USING (id) LEFT JOIN f g ON g.id = c.next)
SELECT id, area_m2, round(slope, 9) AS slope_fit, round(slope * pow(area_m2, 0.45e0), 6) AS ksn_smoothed FROM s""",
    "steepness_summary": f"""{_ORDERED}, k AS (SELECT *, CASE WHEN ksn > 0 THEN ksn END AS up FROM st WHERE ksn IS NOT NULL)
SELECT count(*) AS channel_cells, round(quantile_cont(up, 0.5), 6) AS ksn_median, round(quantile_cont(up, 0.9), 6) AS ksn_p90, round(quantile_cont(up, 0.99), 6) AS ksn_p99,
  round(count(CASE WHEN ksn = 0 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS zero_fraction, max(chi) AS chi_max FROM k""",
    "concavity": """WITH u AS (SELECT log10(p_partkey * 5e4 + 1e6) AS la, pow(p_partkey * 5e4 + 1e6, -0.45e0) * (1 + p_size / 50e0) AS slope FROM part WHERE p_partkey * 5e4 + 1e6 > 1e6),
s AS (SELECT min(la) AS lo, max(la) AS hi, count(*) AS cells FROM u), b AS (SELECT floor((la - lo) / (hi - lo) * 30) AS k, any_value(lo) AS lo, any_value(hi) AS hi, any_value(cells) AS cells, count(*) AS n, quantile_cont(slope, 0.5) AS mid FROM u, s GROUP BY 1 HAVING k < 30),
f AS (SELECT lo + (hi - lo) * (k + 0.5e0) / 30 AS x, log10(mid) AS y, cells FROM b WHERE n >= 10)
SELECT round(-regr_slope(y, x), 6) AS theta, round(pow(10e0, regr_intercept(y, x)), 6) AS ks, count(*) AS bins, any_value(cells) AS cells, round(regr_r2(y, x), 6) AS r2 FROM f HAVING count(*) >= 5 AND any_value(cells) >= 50""",
    "trunk": f"""WITH RECURSIVE {_CHANNEL}, oc AS (SELECT * FROM ch WHERE area_m2 >= 6e5), m AS (SELECT id FROM oc ORDER BY area_m2 DESC, id LIMIT 1),
best AS (SELECT next AS below, arg_max(id, area_m2 * 1e5 + id) AS best FROM oc WHERE next IS NOT NULL GROUP BY 1),
t AS (SELECT id, CAST(0 AS DOUBLE) AS distance FROM m UNION ALL SELECT best, distance + c.step_m FROM t JOIN best ON below = t.id JOIN oc c ON c.id = best) SELECT id, round(distance, 6) AS distance FROM t""",
    "initiation": f"WITH s AS ({BASE['surfaces']}), m AS (SELECT layer, round(quantile_cont(slope, 0.5), 6) AS median_slope FROM s GROUP BY 1) SELECT *, CAST(CASE WHEN median_slope >= 15 THEN 0.05 WHEN median_slope >= 5 THEN 0.25 ELSE 1 END AS DOUBLE) AS initiation_km2 FROM m",
    "density_curve": f"""WITH {_CHANNEL}, t AS (SELECT unnest([0.1e0, 0.2e0, 0.5e0, 1e0, 2e0, 5e0, 10e0]) AS threshold_km2), w AS (SELECT count(*) * 0.25e0 AS basin_km2 FROM ch),
d AS (SELECT threshold_km2, count(CASE WHEN area_m2 / 1e6 >= threshold_km2 THEN 1 END) AS channel_cells, coalesce(CAST(sum(CASE WHEN area_m2 / 1e6 >= threshold_km2 THEN CAST(step_m AS DECIMAL(28,6)) END) AS DOUBLE), 0) / 1000 AS length_km FROM ch, t GROUP BY 1),
e AS (SELECT d.*, length_km / basin_km2 AS density FROM d, w)
SELECT threshold_km2, channel_cells, round(length_km, 6) AS length_km, round(density, 6) AS density, threshold_km2 = 1 AS chosen,
  round((max(density) FILTER (density > 0) OVER ()) / (min(density) FILTER (density > 0) OVER ()), 6) AS range_factor FROM e""",
    "snap_to_stream": f"""WITH {_CELLS}, o AS (SELECT s_suppkey AS outlet, CAST(s_suppkey * 7 % 40 AS INT) AS r, CAST(s_suppkey * 11 % 50 AS INT) AS c FROM supplier)
SELECT outlet, "row", col, CAST(size AS DOUBLE) AS up_km2 FROM o JOIN cells ON "row" BETWEEN r - 3 AND r + 3 AND col BETWEEN c - 3 AND c + 3
WHERE "row" BETWEEN 1 AND 38 AND col BETWEEN 1 AND 48 AND size % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY outlet ORDER BY size DESC, "row", col) = 1 AND size >= 30""",
    "link_lengths": f"""WITH {_CELLS}, n AS (SELECT key AS id, CASE WHEN key >= 51 THEN key - 50 - size % 2 END AS next, "row", col FROM cells)
SELECT a.id, a.next, coalesce(round(sqrt(pow((b."row" - a."row") * 1105.74e0, 2) + pow((b.col - a.col) * 787e0, 2)), 6), 0) AS step_m FROM n a LEFT JOIN n b ON a.next = b.id""",
    "depression_fill": f'WITH RECURSIVE {_FILLED} SELECT 0 AS layer, r AS "row", k AS col, l AS filled FROM lev',
    "flow_routing": f"""WITH RECURSIVE {_ROUTED}
SELECT 0 AS layer, lev.r AS "row", lev.k AS col, l AS filled, br AS next_row, bk AS next_col, n AS area FROM lev JOIN area ON area.r = lev.r AND area.k = lev.k LEFT JOIN down ON down.r = lev.r AND down.k = lev.k""",
    "height_above_drainage": f"""WITH RECURSIVE {_ROUTED}, bed AS (SELECT w.r, w.k, arg_min(l, s) AS z FROM walk w JOIN area a ON a.r = r1 AND a.k = k1 AND n >= 100 JOIN lev ON lev.r = r1 AND lev.k = k1 GROUP BY ALL)
SELECT 0 AS layer, lev.r AS "row", lev.k AS col, l - z AS hand FROM lev LEFT JOIN bed ON bed.r = lev.r AND bed.k = lev.k""",
    "stream_mask": f'WITH RECURSIVE {_ROUTED} SELECT 0 AS layer, r AS "row", k AS col FROM area WHERE n * (0.5e0 + r % 8 / 8e0) >= 40',
    "pour_point_basins": f"""WITH RECURSIVE {_ROUTED}, o AS (SELECT CAST(r * 100 + k AS BIGINT) AS outlet, r, k, n FROM area WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY r // 25, k // 25 ORDER BY n DESC, r, k) = 1),
own AS (SELECT w.r, w.k, arg_min(outlet, s) AS outlet FROM walk w JOIN o ON o.r = r1 AND o.k = k1 GROUP BY ALL)
SELECT 0 AS layer, own.outlet, count(*) AS own_cells, any_value(n) AS area FROM own JOIN o USING (outlet) GROUP BY ALL""",
    "knickpoints": """WITH RECURSIVE q AS (SELECT p_brand AS trunk, CAST(p_partkey AS DOUBLE) AS chi, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 0.05e0 + p_partkey * 37 % 11 * 0.25e0 + CASE WHEN p_partkey % 1000 > 500 THEN 120e0 ELSE 0e0 END END AS z FROM part),
p AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY trunk) AS n, lag(chi) OVER w AS ca, lead(chi) OVER w AS cb, lag(z) OVER w AS za, lead(z) OVER w AS zb FROM q WHERE z IS NOT NULL WINDOW w AS (PARTITION BY trunk ORDER BY chi, z)),
g AS (SELECT *, CASE WHEN ca IS NULL THEN (zb - z) / (cb - chi) WHEN cb IS NULL THEN (z - za) / (chi - ca)
  ELSE (z - za) / (chi - ca) * (cb - chi) / (cb - ca) + (zb - z) / (cb - chi) * (chi - ca) / (cb - ca) END AS g FROM p WHERE n >= 27),
m AS (SELECT *, quantile_cont(g, 0.5) OVER (PARTITION BY trunk) AS mid FROM g), s AS (SELECT *, quantile_cont(abs(g - mid), 0.5) OVER (PARTITION BY trunk) AS dev FROM m),
sc AS (SELECT *, (g - mid) / (1.4826e0 * CASE WHEN dev > 0 THEN dev ELSE 1e-9 END) AS score FROM s),
e AS (SELECT *, coalesce(min(CASE WHEN score <= 1.5 THEN i END) OVER (PARTITION BY trunk ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n - 1) AS j FROM sc),
c AS (SELECT e.trunk, e.i, e.j, e.chi, e.z, f.z - e.z AS step, e.score FROM e JOIN e f ON f.trunk = e.trunk AND f.i = e.j WHERE e.score > 3 AND e.i BETWEEN 9 AND e.n - 10),
k AS (SELECT trunk, min(i) AS i FROM c GROUP BY 1 UNION ALL SELECT k.trunk, min(d.i) FROM k JOIN c ON c.trunk = k.trunk AND c.i = k.i JOIN c d ON d.trunk = k.trunk AND d.i >= c.j + 9 GROUP BY 1)
SELECT trunk, chi, z AS elevation, round(step, 6) AS step, round(score, 6) AS sigma FROM k JOIN c USING (trunk, i) WHERE step >= 30""",
    "stream_burning": f"""WITH {_CELLS}, q AS (SELECT s_suppkey AS line, seq, CAST(s_suppkey * 7 % 40 + seq // 3 AS INT) AS r, CAST(s_suppkey * 11 % 50 + seq AS INT) AS k FROM supplier, (SELECT unnest(range(15)) AS seq)),
o AS (SELECT q.*, v - 20 AS z FROM q JOIN cells ON "row" = r AND col = k WHERE v IS NOT NULL), e AS (SELECT line, arg_min(z, seq) > arg_max(z, seq) AS back FROM o GROUP BY 1),
f AS (SELECT o.*, row_number() OVER (PARTITION BY o.line ORDER BY CASE WHEN back THEN -seq ELSE seq END) AS n FROM o JOIN e USING (line)),
g AS (SELECT r, k, min(z + n * 0.25e0) OVER (PARTITION BY line ORDER BY n) - n * 0.25e0 AS low FROM f), m AS (SELECT r, k, min(low) AS low FROM g GROUP BY ALL)
SELECT layer, "row", col, round(coalesce(low, v), 6) AS value FROM cells LEFT JOIN m ON r = "row" AND k = col""",
}
