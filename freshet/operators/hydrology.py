"""Regulation by lakes and runoff retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS_PER_YEAR = 31557600
# Upper limits of the bands of degree of regulation, in percent.
BANDS = [(2, "negligible"), (10, "slight"), (50, "moderate"), (100, "strongly regulated")]


def regulation(lakes: DataFrame, flow: Column) -> DataFrame:
    """By basin: reservoirs (types 2 and 3), their storage in million m3, degree of regulation and its band."""
    kept = lakes.where(F.col("type").isin(2, 3))
    by = kept.groupBy("basin").agg(F.count("*").alias("reservoirs"), F.sum(F.col("volume").cast("decimal(18,4)")).cast("double").alias("storage"))
    by = by.withColumn("dor", F.col("storage") / (flow * SECONDS_PER_YEAR / 1e6) * 100)
    band = F.lit("over-year storage")
    for top, name in reversed(BANDS):
        band = F.when(F.col("dor") < top, name).otherwise(band)
    return by.withColumn("band", band)


def retention(cn: Column) -> dict[str, Column]:
    """Curve number to dry and wet conditions, retention and initial abstraction in mm."""
    s = 25400 / cn - 254
    return {"cn_dry": 4.2 * cn / (10 - 0.058 * cn), "cn_wet": 23 * cn / (10 + 0.13 * cn), "retention": s, "abstraction": 0.2 * s}


# Curve numbers of land cover codes for soil groups A, B, C, D.
COVER_CN = {
    10: (30, 55, 70, 77),
    20: (35, 56, 70, 77),
    30: (39, 61, 74, 80),
    40: (67, 78, 85, 89),
    50: (77, 85, 90, 92),
    60: (77, 86, 91, 94),
    70: (98, 98, 98, 98),
    80: (98, 98, 98, 98),
    90: (98, 98, 98, 98),
    95: (30, 55, 70, 77),
    100: (39, 61, 74, 80),
}
# Soil group of each texture class.
TEXTURE_GROUP = {
    "sand": "A", "loamy sand": "A", "sandy loam": "A",
    "loam": "B", "silt loam": "B", "silt": "B",
    "sandy clay loam": "C",
    "clay loam": "D", "silty clay loam": "D", "sandy clay": "D", "silty clay": "D", "clay": "D",
}
# Published median area error in percent by basin size, each with its upper limit in km2.
AREA_ERROR = [(100.0, 181.0), (500.0, 30.0), (2000.0, 8.9), (10000.0, 1.7), (100000.0, 1.3), (None, 0.3)]
INSIDE_PCT, EDGE_PCT = 5.0, 20.0


def curve_numbers(cells: DataFrame) -> DataFrame:
    """By basin and cover of (basin, cover, sand, clay): cells, share of the classified cells, mean curve number, composite of the basin.

    Sand and clay are rounded to whole percent first. Cells without soil or with an unknown cover are left out.
    """
    from freshet.functions.scalar import texture_sql

    soil = cells.select("basin", "cover", F.floor(F.col("sand") + 0.5).alias("sand"), F.floor(F.col("clay") + 0.5).alias("clay"))
    soil = soil.withColumn("silt", 100 - F.col("sand") - F.col("clay")).withColumn("texture", F.expr(texture_sql()))
    groups = F.create_map(*[F.lit(x) for kv in TEXTURE_GROUP.items() for x in kv])
    table = F.create_map(*[x for code, cn in COVER_CN.items() for x in (F.lit(code), F.create_map(*[F.lit(y) for gv in zip("ABCD", cn, strict=True) for y in gv]))])
    # both tables are constants of the plan, so nothing is joined
    number = F.try_element_at(F.try_element_at(table, F.col("cover").cast("int")), F.try_element_at(groups, F.col("texture")))
    known = soil.withColumn("cn", number).where("cn is not null")
    by = known.groupBy("basin", "cover").agg(F.count("*").alias("cells"), F.sum("cn").alias("total"))
    whole = Window.partitionBy("basin")  # as many rows as covers
    return by.select(
        "basin", "cover", "cells", (F.col("cells") / F.sum("cells").over(whole)).alias("share"), (F.col("total") / F.col("cells")).alias("mean_cn"),
        (F.sum("total").over(whole) / F.sum("cells").over(whole)).alias("composite_cn"),
    )


def concentration_time(basins: DataFrame) -> DataFrame:
    """Minutes by six formulas of (id, area_km2, channel_km, slope, relief_m, mean_m, min_m), their median, spread and lag.

    A formula whose inputs are missing or not above 0 gives null and does not count.
    """
    area, length, slope = F.col("area_km2"), F.col("channel_km"), F.when(F.col("slope") > 0, F.col("slope"))
    relief, above = F.when(F.col("relief_m") > 0, F.col("relief_m")), F.when(F.col("mean_m") > F.col("min_m"), F.col("mean_m") - F.col("min_m"))
    minutes = {
        "kirpich": 0.0195 * F.pow(length * 1000, 0.77) * F.pow(slope, -0.385),
        "ventura": 60 * 0.1272 * F.sqrt(area / slope),
        "temez": 60 * 0.3 * F.pow(length / F.pow(slope, 0.25), 0.76),
        "california": 60 * F.pow(0.871 * F.pow(length, 3) / relief, 0.385),
        "giandotti": 60 * (4 * F.sqrt(area) + 1.5 * length) / (0.8 * F.sqrt(above)),
        "bransby_williams": 60 * 0.605 * length / (F.pow(area, 0.1) * F.pow(slope * 100, 0.2)),
    }
    out = basins.select("id", *[F.round(e, 6).alias(n) for n, e in minutes.items()])
    out = out.withColumn("_all", F.array_sort(F.array_compact(F.array(*minutes))))
    n = F.size("_all")
    middle = (F.try_element_at("_all", F.floor((n + 1) / 2).cast("int")) + F.try_element_at("_all", F.floor(n / 2).cast("int") + 1)) / 2
    out = out.withColumn("median", F.when(n > 0, middle)).withColumn("n_formulas", n.cast("long"))
    spread = F.try_divide(F.array_max("_all"), F.array_min("_all"))
    return out.select("id", *minutes, "median", "n_formulas", F.round(spread, 6).alias("spread_factor"), (0.6 * F.col("median")).alias("lag"))


def envelope(basins: DataFrame) -> DataFrame:
    """id, area_km2, published median error of the size and its position: inside, edge or outside."""
    a, error = F.col("area_km2"), F.lit(AREA_ERROR[-1][1])
    for top, pct in reversed(AREA_ERROR[:-1]):
        error = F.when(a < top, pct).otherwise(error)
    out = basins.select("id", "area_km2", F.when(a.isNotNull(), error).alias("median_error_pct"))
    e = F.col("median_error_pct")
    return out.withColumn("position", F.when(e <= INSIDE_PCT, "inside").when(e <= EDGE_PCT, "edge").when(e.isNotNull(), "outside"))


def magnitude(basins: DataFrame, factor: float = 10.0) -> DataFrame:
    """(id, area_km2, up_area_km2) to the ratio of both and a verdict."""
    ratio = F.try_divide("area_km2", "up_area_km2")
    verdict = F.when(F.col("up_area_km2").isNull(), "no-reference").when(F.col("area_km2") <= 0, "empty").when(ratio < 1 / factor, "far-too-small").when(ratio > factor, "far-too-large").otherwise("same-order")
    return basins.select("id", ratio.alias("ratio"), verdict.alias("verdict"))


# The eight sectors of the compass, from north by east.
SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def sectors(cells: DataFrame, covered: Column) -> DataFrame:
    """By sector that the ground faces (layer, y, value, aspect): area, covered area, its share of all that is covered and of the sector."""
    from freshet.sources.grids import cell_km2

    area = cell_km2(F.col("y"))
    number = F.pmod(F.floor((F.col("aspect") + 22.5) / 45).cast("int"), F.lit(8))
    known = cells.where("aspect is not null and value is not null").select("layer", F.get(F.array(*[F.lit(s) for s in SECTORS]), number).alias("sector"), area.alias("area"), F.when(covered, area).otherwise(F.lit(0)).alias("hit"))
    by = known.groupBy("layer", "sector").agg(F.sum("area").cast("double").alias("km2"), F.sum("hit").cast("double").alias("covered_km2"))
    whole = F.sum("covered_km2").over(Window.partitionBy("layer"))  # eight rows
    return by.select("*", F.round(F.try_divide(F.col("covered_km2"), whole) * 100, 6).alias("pct_of_cover"), F.round(F.col("covered_km2") / F.col("km2") * 100, 6).alias("pct_of_sector"))


def terrain_stats(cells: DataFrame) -> DataFrame:
    """By layer of (layer, y, value, slope): area, least, most and mean elevation, relief, mean slope."""
    from freshet.sources.grids import cell_km2

    v = F.col("value")
    by = cells.groupBy("layer").agg(
        F.sum(F.when(v.isNotNull(), cell_km2(F.col("y")))).cast("double").alias("area_km2"), F.min(v).alias("least"), F.max(v).alias("most"),
        (F.sum(v.cast("decimal(18,4)")).cast("double") / F.count(v)).alias("mean"), F.round(F.avg("slope"), 6).alias("mean_slope"),
    )
    return by.select("layer", "area_km2", "least", "most", "mean", F.round(F.col("most") - F.col("least"), 6).alias("relief"), "mean_slope")


def watersheds(lakes: DataFrame, basin_km2: Column, n: int = 25) -> DataFrame:
    """By basin of (id, type, volume, watershed, basin): reservoirs, largest and summed watershed, whether their sum exceeds the basin, ids of the n largest by volume."""
    kept = lakes.where(F.col("type").isin(2, 3))
    by = kept.groupBy("basin").agg(F.count("*").alias("reservoirs"), F.max("watershed").alias("largest_km2"), F.sum(F.col("watershed").cast("decimal(28,4)")).cast("double").alias("summed_km2"))
    place = F.row_number().over(Window.partitionBy("basin").orderBy(F.col("volume").desc(), "id"))
    top = kept.withColumn("place", place).where(F.col("place") <= n).groupBy("basin").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("t"))
    return by.join(top, "basin").select(*by.columns, (F.col("summed_km2") > basin_km2).alias("exceeds"), F.array_join(F.transform("t", lambda x: x["id"].cast("string")), ",").alias("top"))
