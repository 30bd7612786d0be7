"""Queries of the library over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import scalar
from freshet.operators import climate, focal, hydrology, nearest, network, routing, zonal
from freshet.sources.grids import dense_grid, read
from freshet.streaming import totals


def _cells(spark, sf_dir):
    value = F.when(F.col("p_size") % 13 != 0, F.col("p_retailprice"))
    return dense_grid(read(spark, sf_dir, "part"), "p_partkey", value, 50, kind=F.col("p_type"), size=F.col("p_size"), key=F.col("p_partkey"))


def _tree(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor((F.col("p_partkey") - 1) / 3).cast("long")).alias("next"), F.col("p_size").alias("area"), (F.col("p_size") % 3).alias("order")
    )


def _daily(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.to_date("l_shipdate").alias("t")).agg(F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("double").alias("value"))


def _monthly(spark, sf_dir):
    month = F.expr("cast(year(l_shipdate) * 12 + month(l_shipdate) as long)")
    return read(spark, sf_dir, "lineitem").groupBy(month.alias("t")).agg(F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("double").alias("value"))


def zonal_class(spark, sf_dir):
    return zonal.zonal(_cells(spark, sf_dir), F.col("kind"))


def zonal_bins(spark, sf_dir):
    return zonal.zonal_bins(_cells(spark, sf_dir), [900.0, 920.0, 950.0, 980.0, 1000.0])


def class_fractions(spark, sf_dir):
    return zonal.class_fractions(_cells(spark, sf_dir), F.col("size") % 7)


def change_matrix(spark, sf_dir):
    return zonal.change(_cells(spark, sf_dir), F.col("size") % 5, (F.col("size") + F.col("key")) % 5)


def coarsen_mean(spark, sf_dir):
    return zonal.coarsen(_cells(spark, sf_dir), 4)


def surfaces(spark, sf_dir):
    return focal.surfaces(_cells(spark, sf_dir))


def position(spark, sf_dir):
    return focal.position(_cells(spark, sf_dir), 5)


def annual_total(spark, sf_dir):
    return climate.annual_total(_daily(spark, sf_dir))


def monthly_climatology(spark, sf_dir):
    return climate.monthly_climatology(_daily(spark, sf_dir))


def rank_average(spark, sf_dir):
    return climate.rank_average(_daily(spark, sf_dir))


def mann_kendall(spark, sf_dir):
    return climate.trend(_monthly(spark, sf_dir))


def upstream_closure(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return network.upstream(tree, spark.range(1, 2))


def hydro_table(spark, sf_dir):
    return network.hydro_table(_tree(spark, sf_dir))


def streams_per_order(spark, sf_dir):
    return network.streams_per_order(_tree(spark, sf_dir))


def regulation_dor(spark, sf_dir):
    lakes = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 3 + 1).alias("type"), F.abs("c_acctbal").alias("volume"), F.col("c_nationkey").alias("basin"))
    return hydrology.regulation(lakes, F.lit(100.0) + F.col("basin") * 1000)


def runoff_retention(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 45).cast("double").alias("cn"))
    return parts.select("id", *[c.alias(n) for n, c in hydrology.retention(F.col("cn")).items()])


def _series(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("t")).agg(F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("double").alias("value"))


def _reaches(spark, sf_dir):
    """The tree with p_size as area and lengths."""
    length = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor("p_retailprice").cast("double").alias("length"))
    return _tree(spark, sf_dir).join(length, "id")


def _basins(spark, sf_dir):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (size * size * 3).alias("area_km2"), size.alias("channel_km"), F.when(F.col("p_size") % 11 != 0, size / 1000).alias("slope"),
        F.when(F.col("p_size") % 7 != 0, price - 899).alias("relief_m"), price.alias("mean_m"), F.lit(890.0).alias("min_m"), F.when(F.col("p_size") % 5 != 0, price / 4).alias("up_area_km2"),
    )


def zonal_mean(spark, sf_dir):
    return zonal.zonal_mean(_cells(spark, sf_dir))


def hypsometry(spark, sf_dir):
    return zonal.hypsometry(_cells(spark, sf_dir))


def slope_histogram(spark, sf_dir):
    return zonal.histogram(focal.surfaces(_cells(spark, sf_dir)), F.col("slope"), [0.0, 0.5, 1.0, 1.5, 2.5])


def snow_bands(spark, sf_dir):
    return zonal.cover_bands(_cells(spark, sf_dir), F.col("size") % 7 == 0, 20.0)


def tri(spark, sf_dir):
    return focal.ruggedness(_cells(spark, sf_dir))


def landform(spark, sf_dir):
    return focal.landform(_cells(spark, sf_dir), 5, 1.0)


def spi(spark, sf_dir):
    found = climate.spi(_series(spark, sf_dir), 30, step="day")
    return found.withColumn("label", climate.spi_label(F.col("spi")))


def water_balance(spark, sf_dir):
    q = F.col("l_quantity")
    return climate.water_balance(read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("t"), q.alias("ppt"), (q * F.col("l_discount")).alias("aet"), (q * 2).alias("pet"), (q * F.col("l_tax")).alias("q")))


def product_agreement(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    price = rows.groupBy(F.year("l_shipdate").alias("year")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double") / 1000).alias("total"))
    return climate.agreement(climate.annual_total(_daily(spark, sf_dir)), price)


def composite_median(spark, sf_dir):
    return climate.composite_median(read(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("band"), "value"))


def routing_check(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    twisted = F.when(F.col("id") % 50 == 17, F.col("id") * 3 + 1).when(F.col("id") % 90 == 5, F.lit(-5)).otherwise(F.col("next"))
    return network.routing_check(tree.withColumn("next", twisted))


def path_sums(spark, sf_dir):
    return network.path_sums(_reaches(spark, sf_dir), {"total": F.col("length")})


def main_stem(spark, sf_dir):
    return network.main_stem(_reaches(spark, sf_dir))


def tributaries(spark, sf_dir):
    reaches = _reaches(spark, sf_dir)
    return network.tributaries(reaches, network.main_stem(reaches))


def order_table(spark, sf_dir):
    return network.order_table(_reaches(spark, sf_dir))


def long_profile(spark, sf_dir):
    z = F.when(F.col("p_size") % 13 != 0, F.col("p_retailprice"))
    return network.long_profile(read(spark, sf_dir, "part").select(F.col("p_brand").alias("river"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("length"), z.alias("z")))


def texture(spark, sf_dir):
    soil = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 101).alias("sand"), F.floor(F.col("p_size") * (100 - F.col("p_partkey") % 101) / 50).alias("clay"))
    return soil.withColumn("silt", 100 - F.col("sand") - F.col("clay")).withColumn("texture", F.expr(scalar.texture_sql()))


def curve_number(spark, sf_dir):
    key = F.col("p_partkey")
    return hydrology.curve_numbers(read(spark, sf_dir, "part").select(F.col("p_brand").alias("basin"), (F.col("p_size") % 12 * 10).alias("cover"), (key % 101).alias("sand"), F.floor(F.col("p_size") * (100 - key % 101) / 50).alias("clay")))


def concentration_time(spark, sf_dir):
    return hydrology.concentration_time(_basins(spark, sf_dir))


def validation_envelope(spark, sf_dir):
    return hydrology.envelope(_basins(spark, sf_dir))


def magnitude_check(spark, sf_dir):
    return hydrology.magnitude(_basins(spark, sf_dir))


def _at(table, key):
    k = F.col(key)
    return table.select(k.alias("id"), (k * 37 % 1500 / 10 - 75).alias("lat"), (k * 1013 % 3600 / 10 - 180).alias("lon"))


def outlet_nearest(spark, sf_dir):
    return nearest.nearest(_at(read(spark, sf_dir, "supplier"), "s_suppkey"), _at(read(spark, sf_dir, "part"), "p_partkey"), 400.0)


def _relief(spark, sf_dir):
    return dense_grid(read(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice"), 100)


def daily_events(spark, sf_dir):
    return totals.daily_totals(read(spark, sf_dir, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        zonal_class, zonal_bins, class_fractions, change_matrix, coarsen_mean, surfaces, position, annual_total, monthly_climatology,
        rank_average, mann_kendall, upstream_closure, hydro_table, streams_per_order, regulation_dor, runoff_retention,
        zonal_mean, hypsometry, slope_histogram, snow_bands, tri, landform, spi, water_balance, product_agreement, composite_median,
        routing_check, path_sums, main_stem, tributaries, order_table, long_profile, texture, curve_number, concentration_time,
        validation_envelope, magnitude_check, outlet_nearest, daily_events,
    )
}

_CELLS = """cells AS (SELECT 0 AS layer, CAST(p_partkey // 50 AS INT) AS "row", CAST(p_partkey % 50 AS INT) AS col,
  CASE WHEN p_size % 13 <> 0 THEN p_retailprice END AS v, p_type AS kind, p_size AS size, p_partkey AS key,
  CAST(1113.2 * cos(radians(45e0 - CAST(p_partkey // 50 AS INT) * 1e-2)) * 1105.74e0 / 1e6 AS DECIMAL(20,9)) AS area,
  1113.2e0 * cos(radians(45e0 - CAST(p_partkey // 50 AS INT) * 1e-2)) AS dx FROM part)"""


def _zonal_sql(zone: str) -> str:
    return f"""WITH {_CELLS}, z AS (SELECT layer, {zone} AS zone, count(*) AS cells, CAST(sum(area) AS DOUBLE) AS area_km2,
  CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max,
  round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90
  FROM cells WHERE v IS NOT NULL GROUP BY ALL)
SELECT *, round(area_km2 / sum(area_km2) OVER (PARTITION BY layer), 9) AS share FROM z WHERE zone IS NOT NULL"""


_DAILY = "d AS (SELECT CAST(l_shipdate AS DATE) AS t, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS value FROM lineitem GROUP BY 1)"
_TREE = 'tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS next, p_size AS area, p_size % 3 AS "order" FROM part)'

ORACLE = {
    "zonal_class": _zonal_sql("kind"),
    "zonal_bins": _zonal_sql("CASE WHEN v < 920 THEN 0 WHEN v < 950 THEN 1 WHEN v < 980 THEN 2 ELSE 3 END"),
    "class_fractions": f"WITH {_CELLS}, n AS (SELECT layer, size % 7 AS code, count(*) AS cells FROM cells WHERE size % 7 > 0 GROUP BY ALL) SELECT *, cells / CAST(sum(cells) OVER (PARTITION BY layer) AS DOUBLE) AS fraction FROM n",
    "change_matrix": f"WITH {_CELLS} SELECT layer, size % 5 AS before, (size + key) % 5 AS after, CAST(sum(area) AS DOUBLE) AS area_km2, size % 5 <> (size + key) % 5 AS changed FROM cells GROUP BY ALL",
    "coarsen_mean": f'WITH {_CELLS} SELECT layer, CAST("row" // 4 AS INT) AS "row", CAST(col // 4 AS INT) AS col, CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(v), 0) AS value FROM cells GROUP BY ALL',
    "surfaces": f"""WITH {_CELLS}, n AS (SELECT c.*, e.v AS ev, w.v AS wv, s.v AS sv, n.v AS nv, e.key AS ek, w.key AS wk, s.key AS sk, n.key AS nk FROM cells c
  LEFT JOIN cells e ON e."row" = c."row" AND e.col = c.col + 1 LEFT JOIN cells w ON w."row" = c."row" AND w.col = c.col - 1
  LEFT JOIN cells s ON s."row" = c."row" + 1 AND s.col = c.col LEFT JOIN cells n ON n."row" = c."row" - 1 AND n.col = c.col),
g AS (SELECT layer, "row", col,
  CASE WHEN v IS NULL OR (ek IS NULL AND wk IS NULL) THEN NULL WHEN wk IS NULL THEN ev - v WHEN ek IS NULL THEN v - wv ELSE (ev - wv) / 2 END / dx AS gx,
  -(CASE WHEN v IS NULL OR (sk IS NULL AND nk IS NULL) THEN NULL WHEN nk IS NULL THEN sv - v WHEN sk IS NULL THEN v - nv ELSE (sv - nv) / 2 END) / 1105.74e0 AS gy FROM n),
h AS (SELECT *, sqrt(gx * gx + gy * gy) AS rise FROM g),
a AS (SELECT *, atan(rise) AS s, CASE WHEN rise >= 1e-9 THEN (degrees(atan2(-gx, -gy)) + 360) % 360 END AS a FROM h)
SELECT layer, "row", col, round(degrees(s), 6) AS slope, round(a, 6) AS aspect, round(CASE WHEN s IS NOT NULL THEN
  greatest(0, least(1, sin(radians(45)) * cos(s) + cos(radians(45)) * sin(s) * cos(radians(315) - radians(coalesce(a, 0))))) END, 6) AS hillshade FROM a""",
    "position": f"""WITH {_CELLS}, near AS (SELECT c.layer, c."row", c.col, any_value(c.v) AS v, CAST(sum(CAST(o.v AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(o.v), 0) AS mean,
  max(CASE WHEN abs(o."row" - c."row") <= 1 AND abs(o.col - c.col) <= 1 THEN o.v END) - min(CASE WHEN abs(o."row" - c."row") <= 1 AND abs(o.col - c.col) <= 1 THEN o.v END) AS span
  FROM cells c JOIN cells o ON o."row" BETWEEN c."row" - 2 AND c."row" + 2 AND o.col BETWEEN c.col - 2 AND c.col + 2 GROUP BY ALL)
SELECT layer, "row", col, CASE WHEN v IS NOT NULL THEN round(v - mean, 6) + 0 END AS tpi, CASE WHEN v IS NOT NULL THEN round(span, 6) END AS roughness FROM near""",
    "annual_total": f"WITH {_DAILY} SELECT CAST(year(t) AS INT) AS year, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM d GROUP BY 1",
    "monthly_climatology": f"WITH {_DAILY} SELECT CAST(month(t) AS INT) AS month, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) AS mean FROM d GROUP BY 1",
    "rank_average": f"WITH {_DAILY} SELECT t, value, rank() OVER (PARTITION BY month(t) ORDER BY value) + (count(*) OVER (PARTITION BY month(t), value) - 1) / 2e0 AS rank FROM d",
    "mann_kendall": """WITH m AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS t, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS value FROM lineitem GROUP BY 1),
p AS (SELECT CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s, round(quantile_cont((b.value - a.value) / (b.t - a.t), 0.5), 6) AS sen FROM m a JOIN m b ON a.t < b.t),
k AS (SELECT value, count(*) AS m FROM m GROUP BY 1), q AS (SELECT CAST(sum(m) AS BIGINT) AS n, CAST(sum(m * (m - 1) * (2 * m + 5)) AS BIGINT) AS tied FROM k),
r AS (SELECT n, s, (n * (n - 1) * (2 * n + 5) - tied) / 18e0 AS var, sen FROM p, q WHERE n >= 10)
SELECT n, s, var, round((s - sign(s)) / sqrt(var), 6) AS z, sen FROM r""",
    "upstream_closure": f"WITH RECURSIVE {_TREE}, up AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth UNION ALL SELECT tree.id, depth + 1 FROM tree JOIN up ON tree.next = up.id) SELECT id, depth FROM up",
    "hydro_table": f"WITH {_TREE} SELECT a.id, coalesce(b.id, -1) AS next_down, a.area FROM tree a LEFT JOIN tree b ON a.next = b.id",
    "streams_per_order": f"""WITH {_TREE} SELECT "order", count(*) AS reaches, count(CASE WHEN NOT EXISTS (SELECT 1 FROM tree u WHERE u.next = t.id AND u."order" = t."order") THEN 1 END) AS streams FROM tree t GROUP BY 1""",
    "regulation_dor": """WITH l AS (SELECT c_nationkey AS basin, count(*) AS reservoirs, CAST(sum(CAST(abs(c_acctbal) AS DECIMAL(18,4))) AS DOUBLE) AS storage FROM customer WHERE c_custkey % 3 IN (1, 2) GROUP BY 1),
d AS (SELECT *, storage / ((100e0 + basin * 1000) * 31557600 / 1e6) * 100 AS dor FROM l)
SELECT *, CASE WHEN dor < 2 THEN 'negligible' WHEN dor < 10 THEN 'slight' WHEN dor < 50 THEN 'moderate' WHEN dor < 100 THEN 'strongly regulated' ELSE 'over-year storage' END AS band FROM d""",
    "runoff_retention": "WITH c AS (SELECT p_partkey AS id, CAST(p_size + 45 AS DOUBLE) AS cn FROM part) SELECT id, 4.2e0 * cn / (10 - 0.058e0 * cn) AS cn_dry, 23 * cn / (10 + 0.13e0 * cn) AS cn_wet, 25400 / cn - 254 AS retention, 0.2e0 * (25400 / cn - 254) AS abstraction FROM c",
}

_REACHES = _TREE + """, reaches AS (SELECT tree.*, floor(p_retailprice) AS length FROM tree JOIN part ON p_partkey = id),
best AS (SELECT next AS below, arg_max(id, area * 1e9 + id) AS best FROM tree WHERE next IS NOT NULL GROUP BY 1),
stem AS (SELECT id, CAST(0 AS DOUBLE) AS distance FROM tree WHERE next IS NULL UNION ALL
  SELECT best, distance + r.length FROM stem JOIN best ON below = stem.id JOIN reaches r ON r.id = best)"""
_TEXTURE = scalar.texture_sql().replace("1.5D", "1.5e0")
_SOIL = "soil AS (SELECT *, p_partkey % 101 AS sand, CAST(floor(p_size * (100 - p_partkey % 101) / 50e0) AS BIGINT) AS clay, 100 - p_partkey % 101 - CAST(floor(p_size * (100 - p_partkey % 101) / 50e0) AS BIGINT) AS silt FROM part)"
_BASINS = """b AS (SELECT p_partkey AS id, p_size * p_size * 3e0 AS area_km2, CAST(p_size AS DOUBLE) AS l, CASE WHEN p_size % 11 <> 0 THEN p_size / 1000e0 END AS s,
  CASE WHEN p_size % 7 <> 0 AND p_retailprice > 899 THEN p_retailprice - 899 END AS h, p_retailprice - 890 AS z, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 4 END AS up FROM part)"""


def _horner(x: str, coefficients) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + ({c!r}))"
    return text


_Q, _T = "(p - 0.5e0)", "sqrt(-2 * ln(least(p, 1 - p)))"
_TAIL = f"{_horner(_T, scalar.TAIL[0])} / {_horner(_T, scalar.TAIL[1])}"
_NORMAL = f"CASE WHEN p < 0.02425e0 THEN {_TAIL} WHEN p > 1 - 0.02425e0 THEN -({_TAIL}) ELSE {_horner(f'({_Q} * {_Q})', scalar.CENTRE[0])} * {_Q} / {_horner(f'({_Q} * {_Q})', scalar.CENTRE[1])} END"
_CN = "CASE " + " ".join(f"WHEN cover = {code} THEN CASE hsg WHEN 'A' THEN {v[0]} WHEN 'B' THEN {v[1]} WHEN 'C' THEN {v[2]} WHEN 'D' THEN {v[3]} END" for code, v in hydrology.COVER_CN.items()) + " END"
_HSG = "CASE texture " + " ".join(f"WHEN '{t}' THEN '{g}'" for t, g in hydrology.TEXTURE_GROUP.items()) + " END"
_AT = "SELECT {0} AS id, {0} * 37 % 1500 / 10e0 - 75 AS lat, {0} * 1013 % 3600 / 10e0 - 180 AS lon FROM {1}"

ORACLE |= {
    "zonal_mean": f'WITH {_CELLS} SELECT layer, count(*) AS cells, round(sum(v * cos(radians(45e0 - "row" * 1e-2))) / sum(cos(radians(45e0 - "row" * 1e-2))), 6) AS mean FROM cells WHERE v IS NOT NULL GROUP BY 1',
    "hypsometry": f"""WITH {_CELLS}, k AS (SELECT unnest(range(11)) AS k), s AS (SELECT layer, round((CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) / count(v) - min(v)) / (max(v) - min(v)), 6) AS integral,
  quantile_cont(v, [{', '.join(repr(1 - i / 10) for i in range(11))}]) AS z FROM cells WHERE v IS NOT NULL GROUP BY 1) SELECT layer, k / 10e0 AS area_share, round(z[k + 1], 6) AS elevation, integral FROM s, k""",
    "slope_histogram": f"SELECT layer, CAST(CASE WHEN slope < 0.5 THEN 0 WHEN slope < 1 THEN 1 WHEN slope < 1.5 THEN 2 WHEN slope < 2.5 THEN 3 ELSE 4 END AS INT) AS class, count(*) AS cells FROM ({ORACLE['surfaces']}) WHERE slope >= 0 GROUP BY ALL",
    "snow_bands": f"""WITH {_CELLS}, b AS (SELECT layer, CAST(floor(v / 20) AS BIGINT) AS band, CAST(sum(area) AS DOUBLE) AS km2, CAST(sum(CASE WHEN size % 7 = 0 THEN area ELSE 0 END) AS DOUBLE) AS covered_km2 FROM cells WHERE v IS NOT NULL GROUP BY ALL)
SELECT *, round(covered_km2 / sum(covered_km2) OVER (PARTITION BY layer) * 100, 6) AS pct_of_cover, round(covered_km2 / km2 * 100, 6) AS pct_of_band FROM b""",
    "tri": f"""WITH {_CELLS}, m AS (SELECT max("row") AS mr, max(col) AS mc FROM cells), o AS (SELECT dr, dc FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)),
n AS (SELECT c.layer, c."row", c.col, c.v, e.v AS ev FROM cells c, m, o, cells e WHERE e."row" = greatest(0, least(mr, c."row" + dr)) AND e.col = greatest(0, least(mc, c.col + dc)))
SELECT layer, "row", col, CASE WHEN any_value(v) IS NOT NULL THEN round(sqrt(sum((ev - v) * (ev - v))), 6) END AS tri FROM n GROUP BY ALL""",
    "landform": f"""WITH p AS ({ORACLE['position']}), s AS ({ORACLE['surfaces']}), d AS (SELECT layer, stddev_pop(tpi) AS sd FROM p GROUP BY 1)
SELECT p.layer, p."row", p.col, CAST(CASE WHEN tpi <= -sd THEN 0 WHEN tpi <= -sd / 2 THEN 1 WHEN tpi >= sd THEN 5 WHEN tpi >= sd / 2 THEN 4 WHEN slope <= 1 THEN 2 WHEN slope > 1 THEN 3 END AS INT) AS landform,
  ['valley', 'lower slope', 'flat', 'mid slope', 'upper slope', 'ridge'][landform + 1] AS name
FROM p JOIN s USING (layer, "row", col) JOIN d ON d.layer = p.layer""",
    "spi": f"""WITH d AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS t, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
f AS (SELECT series, t, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER w AS DOUBLE) AS total, count(value) OVER w AS n, t - min(t) OVER w AS span FROM d WINDOW w AS (PARTITION BY series ORDER BY t ROWS 29 PRECEDING)),
r AS (SELECT series, t, total, (rank() OVER (PARTITION BY series, month(t) ORDER BY total) + (count(*) OVER (PARTITION BY series, month(t), total) - 1) / 2e0) / (count(*) OVER (PARTITION BY series, month(t)) + 1) AS p, count(*) OVER (PARTITION BY series, month(t)) AS m FROM f WHERE n = 30 AND span = 29),
s AS (SELECT series, t, total, CASE WHEN m >= 10 THEN round({_NORMAL}, 6) END AS spi FROM r)
SELECT *, CASE WHEN spi IS NULL THEN NULL WHEN spi >= 2 THEN 'extremely wet' WHEN spi >= 1.5 THEN 'very wet' WHEN spi >= 1 THEN 'moderately wet' WHEN spi > -1 THEN 'near normal' WHEN spi > -1.5 THEN 'moderately dry' WHEN spi > -2 THEN 'severely dry' ELSE 'extremely dry' END AS label FROM s""",
    "water_balance": """WITH y AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS ppt, CAST(sum(CAST(l_quantity * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS aet,
  CAST(sum(CAST(l_quantity * 2 AS DECIMAL(18,4))) AS DOUBLE) AS pet, CAST(sum(CAST(l_quantity * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS q FROM lineitem GROUP BY 1)
SELECT *, ppt - aet - q AS residual, q / nullif(ppt, 0) AS runoff_coefficient, ppt / nullif(pet, 0) AS aridity FROM y""",
    "product_agreement": """WITH y AS (SELECT year(l_shipdate) AS year, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS a, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / 1000 AS b FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(avg(a) / avg(b) - 1, 6) AS bias FROM y""",
    "composite_median": "SELECT user_id AS cell, event_type AS band, count(value) AS scenes, round(quantile_cont(value, 0.5), 6) AS value FROM events GROUP BY ALL",
    "routing_check": f"""WITH RECURSIVE {_TREE}, t AS (SELECT id, CASE WHEN id % 50 = 17 THEN id * 3 + 1 WHEN id % 90 = 5 THEN -5 ELSE next END AS next FROM tree),
up AS (SELECT id FROM t WHERE next IS NULL OR next NOT IN (SELECT id FROM t) UNION ALL SELECT t.id FROM t JOIN up ON t.next = up.id),
c AS (SELECT count(*) AS units, count(CASE WHEN next IS NULL THEN 1 END) AS terminal_units, count(CASE WHEN next NOT IN (SELECT id FROM t) THEN 1 END) AS dangling_next, count(CASE WHEN id NOT IN (SELECT id FROM up) THEN 1 END) AS units_in_a_cycle FROM t)
SELECT *, terminal_units = 1 AND dangling_next = 0 AND units_in_a_cycle = 0 AS single_outlet FROM c""",
    "path_sums": f"""WITH RECURSIVE {_REACHES}, w AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS steps, CAST(0 AS DOUBLE) AS total FROM tree WHERE next IS NULL UNION ALL
  SELECT r.id, root, steps + 1, total + r.length FROM w JOIN reaches r ON r.next = w.id) SELECT * FROM w""",
    "main_stem": f"WITH RECURSIVE {_REACHES} SELECT * FROM stem",
    "tributaries": f"""WITH RECURSIVE {_REACHES} SELECT a.id, b.id AS joins, a.area, CAST(a.area AS DOUBLE) / nullif(b.area, 0) AS share FROM tree a JOIN tree b ON a.next = b.id
WHERE a.id NOT IN (SELECT id FROM stem) AND b.id IN (SELECT id FROM stem)""",
    "order_table": f"""WITH RECURSIVE {_REACHES}, s AS ({ORACLE['streams_per_order']}), l AS (SELECT "order", sum(length) AS length FROM reaches GROUP BY 1), m AS (SELECT *, length / nullif(streams, 0) AS mean_length FROM s JOIN l USING ("order"))
SELECT *, CAST(streams AS DOUBLE) / nullif(lead(streams) OVER w, 0) AS bifurcation_ratio, mean_length / nullif(lag(mean_length) OVER w, 0) AS length_ratio FROM m WINDOW w AS (ORDER BY "order")""",
    "long_profile": """WITH p AS (SELECT p_brand AS river, p_partkey AS seq, p_size AS length, CASE WHEN p_size % 13 <> 0 THEN p_retailprice END AS z FROM part),
f AS (SELECT river, seq, CAST(coalesce(sum(length) OVER (PARTITION BY river ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS distance,
  coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY river ORDER BY seq ROWS UNBOUNDED PRECEDING), first_value(z IGNORE NULLS) OVER (PARTITION BY river ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS z FROM p)
SELECT *, min(z) OVER (PARTITION BY river ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bed FROM f""",
    "texture": f"WITH {_SOIL} SELECT p_partkey AS id, sand, clay, silt, {_TEXTURE} AS texture FROM soil",
    "curve_number": f"""WITH {_SOIL}, x AS (SELECT p_brand AS basin, p_size % 12 * 10 AS cover, {_TEXTURE} AS texture FROM soil), g AS (SELECT *, {_HSG} AS hsg FROM x),
n AS (SELECT *, {_CN} AS cn FROM g), c AS (SELECT basin, cover, count(*) AS cells, sum(cn) AS total FROM n WHERE cn IS NOT NULL GROUP BY ALL)
SELECT basin, cover, cells, cells / CAST(sum(cells) OVER w AS DOUBLE) AS share, total / CAST(cells AS DOUBLE) AS mean_cn, CAST(sum(total) OVER w AS DOUBLE) / CAST(sum(cells) OVER w AS DOUBLE) AS composite_cn FROM c WINDOW w AS (PARTITION BY basin)""",
    "concentration_time": f"""WITH {_BASINS}, m AS (SELECT id, round(0.0195e0 * pow(l * 1000, 0.77e0) * pow(s, -0.385e0), 6) AS kirpich, round(60 * 0.1272e0 * sqrt(area_km2 / s), 6) AS ventura,
  round(60 * 0.3e0 * pow(l / pow(s, 0.25e0), 0.76e0), 6) AS temez, round(60 * pow(0.871e0 * pow(l, 3) / h, 0.385e0), 6) AS california,
  round(60 * (4 * sqrt(area_km2) + 1.5e0 * l) / (0.8e0 * sqrt(z)), 6) AS giandotti, round(60 * 0.605e0 * l / (pow(area_km2, 0.1e0) * pow(s * 100, 0.2e0)), 6) AS bransby_williams FROM b),
v AS (SELECT *, list_sort(list_filter([kirpich, ventura, temez, california, giandotti, bransby_williams], lambda x: x IS NOT NULL)) AS a FROM m),
n AS (SELECT * EXCLUDE (a), a[(len(a) + 1) // 2] / 2 + a[len(a) // 2 + 1] / 2 AS median, len(a) AS n_formulas, round(a[-1] / a[1], 6) AS spread_factor FROM v)
SELECT *, 0.6e0 * median AS lag FROM n""",
    "validation_envelope": f"""WITH {_BASINS}, e AS (SELECT id, area_km2, CAST(CASE WHEN area_km2 < 100 THEN 181 WHEN area_km2 < 500 THEN 30 WHEN area_km2 < 2000 THEN 8.9 WHEN area_km2 < 10000 THEN 1.7 WHEN area_km2 < 100000 THEN 1.3 ELSE 0.3 END AS DOUBLE) AS median_error_pct FROM b)
SELECT *, CASE WHEN median_error_pct <= 5 THEN 'inside' WHEN median_error_pct <= 20 THEN 'edge' ELSE 'outside' END AS position FROM e""",
    "magnitude_check": f"WITH {_BASINS} SELECT id, area_km2 / up AS ratio, CASE WHEN up IS NULL THEN 'no-reference' WHEN area_km2 / up < 0.1 THEN 'far-too-small' WHEN area_km2 / up > 10 THEN 'far-too-large' ELSE 'same-order' END AS verdict FROM b",
    "outlet_nearest": f"""WITH p AS ({_AT.format('s_suppkey', 'supplier')}), t AS ({_AT.format('p_partkey', 'part')}),
d AS (SELECT p.id, t.id AS target, round(2 * 6371.0088e0 * asin(sqrt(least(1, pow(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2)))), 6) AS km FROM p, t)
SELECT id, target, km FROM d WHERE km <= 400 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, target) = 1""",
    "daily_events": "SELECT date_trunc('day', ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1",
}
