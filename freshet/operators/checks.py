"""Checks of a delineated basin: its outlet, the ground its terrain figures stand on, how far published accuracy reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.hydrology import AREA_ERROR, EDGE_PCT, INSIDE_PCT

# Search radius in km, ratio of areas that still agrees, least area in km2 of a mapped river, range of areas of an orphan outlet.
SEARCH_KM, RATIO_LIMIT, FLOOR_KM2, ORPHAN_KM2 = 2.0, 2.0, 10.0, (100.0, 1000.0)
# Vertical error in metres by elevation product, and of an unknown one.
VERTICAL_ERROR = {"cop30": 4.0, "cop90": 4.0, "nasadem": 5.3, "srtm30": 6.0}
UNKNOWN_ERROR = 6.0
# Advisory and unmet limits of each test of an elevation model; relief is better when larger.
SUITABILITY = {"filling": (5.0, 20.0), "slope": (25.0, 60.0), "relief": (100.0, 20.0), "water": (1.0, 5.0), "coverage": (0.5, 2.0)}
# Least, 5th, 95th percentile and most of each test over the basins of the terrain study.
STUDY = {
    "filling": (0.33, 1.19, 23.6, 53.34),
    "slope": (4.16, 9.18, 98.93, 99.99),
    "water": (0.0, 0.0, 2.461, 5.805),
    "relief": (15.6, 31.7, 535.0, 830.3),
    "coverage": (0.0, 0.0, 0.0, 0.0),
}
# Limits of high and moderate quality, where more is better.
QUALITY = {"landcover_agreement": (0.80, 0.65), "precipitation_r": (0.90, 0.75)}
# Upper limits of local relief in metres, and the classes below them.
RELIEF_CLASSES = [(20.0, "flat"), (100.0, "hilly"), (None, "mountain")]
# Codes of two land cover maps for the classes that both define.
COMMON_CLASSES = {
    "tree": ((10,), (2,)), "grass_shrub": ((20, 30), (11,)), "crop": ((40,), (5,)), "built": ((50,), (7,)),
    "bare": ((60,), (8,)), "snow_ice": ((70,), (9,)), "water": ((80,), (1,)), "wetland": ((90, 95), (4,)),
}


def outlet_check(basins: DataFrame, reaches: DataFrame, search_km: float = SEARCH_KM, limit: float = RATIO_LIMIT) -> DataFrame:
    """id, agrees, reason, ratio, nearest_ratio, suggested_km2 of basins (id, area_km2) against reaches (id, upland_km2, km) near the outlet.

    The first reason that holds counts: no reach near (by size of the basin), an outlet between two
    channels, a basin much smaller than its river, agreement, a basin much larger than any river near.
    """
    near = reaches.where(F.col("km") <= search_km).groupBy("id").agg(
        F.max("upland_km2").alias("largest"), F.min(F.struct("km", (-F.col("upland_km2")).alias("u"))).alias("n")
    )
    b = basins.select("id", "area_km2").join(near, "id", "left").withColumns({"near_km": F.col("n.km"), "near_up": -F.col("n.u")})
    area, largest, near_up = F.col("area_km2"), F.col("largest"), F.col("near_up")
    b = b.withColumn("ratio", F.when(largest > 0, area / largest)).withColumn("nearest_ratio", F.when(near_up > 0, area / near_up))
    ratio, own = F.col("ratio"), F.col("nearest_ratio")
    at = (F.col("near_km") <= 0.1) & (near_up >= FLOOR_KM2)
    reason = (
        F.when(largest.isNull() & area.between(*ORPHAN_KM2), "orphan-outlet").when(largest.isNull() & (area > ORPHAN_KM2[1]), "no-reach-large").when(largest.isNull(), "no-reach")
        .when(at & (own > limit) & (F.abs(ratio - 1) <= 0.25) & (largest > near_up * limit), "confluence-ambiguous").when(at & (own < 1 / limit), "under-captured")
        .when(ratio <= limit, "consistent").otherwise("over-captured")
    )
    b = b.withColumn("reason", reason)
    suggested = F.when(F.col("reason").isin("confluence-ambiguous", "under-captured"), near_up).when(F.col("reason") == "over-captured", largest)
    agrees = F.col("reason").isin("no-reach-large", "no-reach", "consistent")
    return b.select("id", agrees.alias("agrees"), "reason", "ratio", "nearest_ratio", suggested.alias("suggested_km2"))


def outlet_unit(near: DataFrame, snap_km: float = 20.0, river_km: float = 1.0, ratio: float = 10.0, advisory_km: float = 20.0) -> DataFrame:
    """outlet, unit, snapped, off_channel, alternatives of candidate units (outlet, unit, km, inside, up_area).

    The unit that holds the outlet, else the nearest within snap_km; a unit within river_km that drains
    `ratio` times as much takes its place (snapped: 'main-stem'; 'nearest' where none held it). off_channel: the largest
    such unit within advisory_km where none was near enough. alternatives: the four largest in range but the chosen one.
    """
    own = near.groupBy("outlet").agg(F.min(F.when(F.col("inside"), F.struct("unit", "up_area"))).alias("inside"), F.min(F.when(F.col("km") <= snap_km, F.struct("km", "unit", "up_area"))).alias("near"))
    own = own.withColumn("first", F.coalesce(F.col("inside"), F.struct(F.col("near.unit").alias("unit"), F.col("near.up_area").alias("up_area")))).where("first.unit is not null")
    both = near.join(own.select("outlet", F.col("first.unit").alias("first"), F.col("first.up_area").alias("here"), F.col("inside").isNull().alias("outside")), "outlet")
    much = F.col("up_area") >= F.greatest(F.coalesce("here", F.lit(0.0)), F.lit(1e-9)) * ratio
    best = F.struct("up_area", (-F.col("unit")).alias("u"))
    by = both.groupBy("outlet", "first", "outside").agg(
        F.max(F.when(much & (F.col("km") <= river_km), best)).alias("stem"), F.max(F.when(much & (F.col("km") <= advisory_km), best)).alias("wide"),
    )
    by = by.withColumn("unit", F.coalesce(-F.col("stem.u"), F.col("first")))
    # a window of the few units in range of an outlet
    rank = F.row_number().over(Window.partitionBy("outlet").orderBy(F.col("up_area").desc(), "unit"))
    four = near.where(F.col("km") <= max(river_km, 2.0)).withColumn("r", rank).where("r <= 4").groupBy("outlet").agg(F.sort_array(F.collect_list(F.struct("r", "unit"))).alias("alt"))
    out = by.join(four, "outlet", "left")
    alternatives = F.array_join(F.transform(F.filter("alt", lambda a: a["unit"] != F.col("unit")), lambda a: a["unit"].cast("string")), ",")
    snapped = F.when(F.col("stem").isNotNull(), "main-stem").when(F.col("outside"), "nearest")
    return out.select("outlet", "unit", snapped.alias("snapped"), F.when(F.col("stem").isNull(), -F.col("wide.u")).alias("off_channel"), F.coalesce(alternatives, F.lit("")).alias("alternatives"))


def choose_backend(basins: DataFrame, small_km2: float = 2000.0, most_km2: float = 5000.0, near_km: float = 1.0, factor: float = 2.0) -> DataFrame:
    """id and backend of (id, unit_km2, agrees, suggested_km2, reach_km, dem_km2).

    Basins below small_km2 are routed on elevations; a larger one only where the outlet check disagrees
    with a suggestion of at most most_km2, a reach within near_km, and an elevation basin within `factor` of it.
    """
    close = (F.col("dem_km2") <= F.col("suggested_km2") * factor) & (F.col("dem_km2") * factor >= F.col("suggested_km2"))
    switch = ~F.col("agrees") & (F.col("suggested_km2") <= most_km2) & (F.col("reach_km") <= near_km) & close
    return basins.select("id", F.when(F.col("unit_km2") < small_km2, "dem").when(F.coalesce(switch, F.lit(False)), "dem").otherwise("units").alias("backend"))


def verdict(value: Column, advisory: float, unmet: float) -> Column:
    """pass, advisory or unmet; larger is better where unmet is the smaller limit."""
    if advisory < unmet:
        return F.when(value >= unmet, "unmet").when(value >= advisory, "advisory").when(value.isNotNull(), "pass")
    return F.when(value <= unmet, "unmet").when(value <= advisory, "advisory").when(value.isNotNull(), "pass")


def vertical_error(product: Column) -> Column:
    out = F.lit(UNKNOWN_ERROR)
    for name, metres in VERTICAL_ERROR.items():
        out = F.when(product == name, metres).otherwise(out)
    return out


def suitability(cells: DataFrame, product: Column) -> DataFrame:
    """One row per layer of (layer, value, filled, slope, cell_m, level_pct): each test's figure and verdict, and the grade.

    filled is the surface after depressions were filled; level_pct the share of the layer under its largest level surface.
    """
    known = F.col("value").isNotNull()
    share = lambda c, of: F.try_divide(F.count_if(c).cast("double"), F.count_if(of)) * 100
    by = cells.withColumn("error", vertical_error(product)).groupBy("layer", "error").agg(
        share(known & (F.col("filled") - F.col("value") > 0.01), known).alias("filling"),
        share(F.col("slope") < F.degrees(F.atan(F.col("error") / F.col("cell_m"))), F.col("slope").isNotNull()).alias("slope"),
        (F.max("value") - F.min("value")).alias("height"), F.max("level_pct").alias("water"), share(~known, F.lit(True)).alias("coverage"),
    ).withColumn("relief", F.col("height") / F.col("error"))
    out = by.select("layer", *[F.round(k, 6).alias(k) for k in SUITABILITY], *[verdict(F.col(k), *v).alias(f"{k}_verdict") for k, v in SUITABILITY.items()])
    all_ = F.array(*[F.col(f"{k}_verdict") for k in SUITABILITY])
    return out.withColumn("grade", F.when(F.array_contains(all_, "unmet"), "LIMITED").when(F.array_contains(all_, "advisory"), "MODERATE").otherwise("HIGH"))


def grade(value: Column, good: float, bad: float) -> Column:
    """HIGH, MODERATE or LIMITED, larger being better where good is the larger limit; null without a value."""
    known = value.isNotNull() & ~F.isnan(value.cast("double"))
    high, moderate = (value >= good, value >= bad) if good > bad else (value <= good, value <= bad)
    return F.when(known, F.when(high, "HIGH").when(moderate, "MODERATE").otherwise("LIMITED"))


def worst(grades: list[Column]) -> Column:
    """The worst of the grades that are known; HIGH if none is."""
    all_ = F.array(*grades)
    return F.when(F.array_contains(all_, "LIMITED"), "LIMITED").when(F.array_contains(all_, "MODERATE"), "MODERATE").otherwise("HIGH")


def common_class(code: Column, which: int) -> Column:
    """The class that both land cover maps define; null for others. which: 0 or 1, the map of the code."""
    out = F.lit(None).cast("string")
    for name, codes in COMMON_CLASSES.items():
        out = F.when(code.isin(*codes[which]), name).otherwise(out)
    return out


def landcover_agreement(cells: DataFrame) -> DataFrame:
    """By layer of (layer, first, second), codes of two maps: compared cells, share that agree, grade, and the weakest class of at least 1 %."""
    c = cells.select("layer", common_class(F.col("first"), 0).alias("a"), common_class(F.col("second"), 1).alias("b")).where("a is not null and b is not null")
    by = c.groupBy("layer", "a").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    whole = Window.partitionBy("layer")  # as many rows as classes
    by = by.withColumn("cells", F.sum("n").over(whole))
    weak = F.min(F.when(F.col("n") >= F.col("cells") * 0.01, F.struct((F.col("same") / F.col("n")).alias("share"), F.col("a").alias("class"))))
    out = by.groupBy("layer").agg(F.sum("n").alias("cells"), (F.sum("same") / F.sum("n")).alias("agreement"), weak.alias("w"))
    return out.select("layer", "cells", "agreement", grade(F.col("agreement"), *QUALITY["landcover_agreement"]).alias("grade"), F.col("w.class").alias("weakest"))


def terrain_quality(cells: DataFrame) -> DataFrame:
    """By layer and class of local relief of (layer, roughness, slope, floor): cells, share of the layer, share of slopes below the noise floor."""
    kind = F.lit(RELIEF_CLASSES[-1][1])
    for top, name in reversed(RELIEF_CLASSES[:-1]):
        kind = F.when(F.col("roughness") < top, name).otherwise(kind)
    by = cells.where("roughness is not null").groupBy("layer", kind.alias("class")).agg(
        F.count("*").alias("cells"), F.round(F.try_divide(F.count_if(F.col("slope") < F.col("floor")), F.count("slope")), 6).alias("below_floor")
    )
    return by.withColumn("share", F.round(F.col("cells") / F.sum("cells").over(Window.partitionBy("layer")), 6))  # as many rows as classes


def envelope_axes(basins: DataFrame) -> DataFrame:
    """id, axis, measured, position of (id, area_km2, filling, slope, water, relief, coverage): the size and each figure of the terrain.

    inside, edge or outside of what the published figures were measured on; axes without a figure are absent.
    """
    error = F.lit(AREA_ERROR[-1][1])
    for top, pct in reversed(AREA_ERROR[:-1]):
        error = F.when(F.col("area_km2") < top, pct).otherwise(error)
    size = F.when(error <= INSIDE_PCT, "inside").when(error <= EDGE_PCT, "edge").otherwise("outside")
    axes = [F.struct(F.lit("size").alias("axis"), F.col("area_km2").alias("measured"), F.when(F.col("area_km2").isNotNull(), size).alias("position"))]
    for name, (least, low, high, most) in STUDY.items():
        v = F.col(name)
        place = F.when((v < least) | (v > most), "outside").when((v < low) | (v > high), "edge").when(v.isNotNull(), "inside")
        axes.append(F.struct(F.lit(name).alias("axis"), v.alias("measured"), place.alias("position")))
    return basins.select("id", F.explode(F.array(*axes)).alias("a")).select("id", "a.*").where("measured is not null")


def envelope_position(axes: DataFrame) -> DataFrame:
    """id, position (the worst axis decides), outside and edge (axes so, by name)."""
    names = lambda p: F.array_join(F.sort_array(F.collect_list(F.when(F.col("position") == p, F.col("axis")))), ",")
    by = axes.groupBy("id").agg(names("outside").alias("outside"), names("edge").alias("edge"))
    return by.select("id", F.when(F.col("outside") != "", "outside").when(F.col("edge") != "", "edge").otherwise("inside").alias("position"), "outside", "edge")


def delineation_grade(basins: DataFrame) -> DataFrame:
    """id and grade of (id, area_km2, agrees): HIGH from 2 000 km2, MODERATE below, LIMITED where the outlet check disagrees."""
    size = F.when(F.col("area_km2") >= 2000, "HIGH").when(F.col("area_km2").isNotNull(), "MODERATE")
    return basins.select("id", F.when(F.col("agrees") == F.lit(False), "LIMITED").otherwise(size).alias("grade"))
