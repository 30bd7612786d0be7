"""Statistics of a field by class, and of classes by area. Aggregates combine map-side; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.sources.grids import cell_km2


def zonal(cells: DataFrame, zone: Column, step: float = 0.01) -> DataFrame:
    """layer, zone, cells, area_km2, share, mean, std, min, max, p10, p50, p90 of `value`, nodata left out.

    share is of the area of all cells with a value, those without a zone included.
    """
    known = cells.where(F.col("value").isNotNull()).withColumn("zone", zone).withColumn("area", cell_km2(F.col("y"), step))
    v = F.col("value")
    exact = v.cast("decimal(18,4)")
    by = known.groupBy("layer", "zone").agg(
        F.count("*").alias("cells"),
        F.sum("area").cast("double").alias("area_km2"),
        (F.sum(exact).cast("double") / F.count("*")).alias("mean"),
        F.round(F.stddev_pop("value"), 6).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *[F.round(F.percentile("value", F.lit(q)), 6).alias(n) for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))],
    )
    whole = F.sum("area_km2").over(Window.partitionBy("layer"))
    return by.withColumn("share", F.round(F.col("area_km2") / whole, 9)).where("zone is not null")


def zonal_bins(cells: DataFrame, edges: list[float], step: float = 0.01) -> DataFrame:
    """zonal() by bins of the value; what lies outside falls into the first or last bin."""
    inner = sum((F.col("value") >= e).cast("int") for e in edges[1:-1])
    return zonal(cells, inner, step)


def class_fractions(cells: DataFrame, code: Column) -> DataFrame:
    """Share of the cells of each code above 0."""
    n = cells.withColumn("code", code).where("code > 0").groupBy("layer", "code").agg(F.count("*").alias("cells"))
    return n.withColumn("fraction", F.col("cells") / F.sum("cells").over(Window.partitionBy("layer")))


def change(cells: DataFrame, before: Column, after: Column, step: float = 0.01) -> DataFrame:
    """Area of each transition between two classifications of the same cells."""
    area = cells.withColumns({"before": before, "after": after, "area": cell_km2(F.col("y"), step)})
    area = area.groupBy("layer", "before", "after").agg(F.sum("area").cast("double").alias("area_km2"))
    return area.withColumn("changed", F.col("before") != F.col("after"))


def coarsen(cells: DataFrame, factor: int) -> DataFrame:
    """Mean of each block of factor by factor cells; a block without values is nodata."""
    r, c = (F.floor(F.col(x) / factor).cast("int").alias(x) for x in ("row", "col"))
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return cells.groupBy("layer", r, c).agg((total / F.nullif(F.count("value"), F.lit(0))).alias("value"))


def zonal_mean(cells: DataFrame) -> DataFrame:
    """Mean of each layer weighted by the cosine of latitude, nodata left out."""
    w = F.cos(F.radians("y"))
    known = cells.where("value is not null")
    return known.groupBy("layer").agg(F.count("*").alias("cells"), F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("mean"))


def hypsometry(cells: DataFrame, steps: int = 10) -> DataFrame:
    """layer, area_share, elevation (reached or exceeded by that share of cells) and the layer's hypsometric integral."""
    marks = F.array(*[F.lit(1 - k / steps) for k in range(steps + 1)])
    mean = F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")
    by = cells.where("value is not null").groupBy("layer").agg(
        F.percentile("value", marks).alias("z"), F.round(F.try_divide(mean - F.min("value"), F.max("value") - F.min("value")), 6).alias("integral")
    )
    each = by.select("layer", "integral", F.posexplode("z").alias("k", "z"))
    return each.select("layer", (F.col("k") / steps).alias("area_share"), F.round("z", 6).alias("elevation"), "integral")


def histogram(cells: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Cells of each class [edge, next edge); the last class is open, nodata and values below the first edge have none."""
    number = sum((value >= e).cast("int") for e in edges[1:])
    return cells.where(value >= edges[0]).groupBy("layer", number.alias("class")).agg(F.count("*").alias("cells"))


def cover_bands(cells: DataFrame, covered: Column, height: float, step: float = 0.01) -> DataFrame:
    """By bands of the value: area, covered area, its share of all that is covered and of the band."""
    area = cell_km2(F.col("y"), step)
    known = cells.where("value is not null").select("layer", F.floor(F.col("value") / height).alias("band"), area.alias("area"), F.when(covered, area).otherwise(F.lit(0)).alias("hit"))
    by = known.groupBy("layer", "band").agg(F.sum("area").cast("double").alias("km2"), F.sum("hit").cast("double").alias("covered_km2"))
    whole = F.sum("covered_km2").over(Window.partitionBy("layer"))  # as many rows as bands
    return by.select("*", F.round(F.try_divide(F.col("covered_km2"), whole) * 100, 6).alias("pct_of_cover"), F.round(F.col("covered_km2") / F.col("km2") * 100, 6).alias("pct_of_band"))
