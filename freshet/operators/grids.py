"""Grids against grids and points: alignment, sampling, coarsening, composites, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.sources.grids import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON


def valid_points(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with lat and lon as numbers and `problem`: null for a point on the globe, else what is wrong."""
    y, x = F.col(lat).cast("string").try_cast("double"), F.col(lon).cast("string").try_cast("double")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    problem = F.when(bad(y) | bad(x), "not a number").when(~y.between(-90, 90), "latitude").when(~x.between(-180, 180), "longitude")
    return points.withColumns({lat: y, lon: x}).withColumn("problem", problem)


def degree_box(lat: Column, lon: Column, km: Column) -> dict[str, Column]:
    """West, south, east and north of a box of km about a point."""
    dy = km / (METRES_PER_DEGREE_LAT / 1000)
    dx = km / F.greatest(METRES_PER_DEGREE_LON / 1000 * F.cos(F.radians(lat)), F.lit(1e-6))
    return {"west": lon - dx, "south": lat - dy, "east": lon + dx, "north": lat + dy}


def cell_of(x: Column, y: Column, west: float, north: float, step: float) -> tuple[Column, Column]:
    """Row and column of the cell that holds a point."""
    return F.floor((F.lit(north) - y) / step).cast("int"), F.floor((x - F.lit(west)) / step).cast("int")


def _axis(cells: DataFrame, name: str, at: str, sign: int, origin: float, step: float, mean: bool) -> DataFrame:
    """layer, to_<name>, <name>, w_<name>: which source rows or columns each of the target's takes, and with what weight.

    The source is regular: its spacing follows from its first and last row or column, as many rows as layers.
    """
    pos = F.col(at) * sign  # grows with the number of the row or column
    ends = cells.groupBy("layer").agg(F.min(name).alias("n0"), F.max(name).alias("n1"), F.min(pos).alias("p0"), F.max(pos).alias("p1"))
    gap = F.when(F.col("n1") > F.col("n0"), (F.col("p1") - F.col("p0")) / (F.col("n1") - F.col("n0"))).otherwise(step)
    ends = ends.withColumn("gap", gap)
    # tiny shifts keep borders that agree but for rounding from counting as overlaps
    low, high = F.col("p0") - F.col("gap") / 2, F.col("p1") + F.col("gap") / 2
    to = F.explode(F.sequence(F.floor((low - origin) / step + 1e-9).cast("int"), F.ceil((high - origin) / step - 1e-9).cast("int") - 1)).alias("to")
    each = ends.select("layer", "n0", "n1", "p0", "gap", to)
    left = F.lit(origin) + F.col("to") * F.lit(step)
    place = lambda p: (p - F.col("p0")) / F.col("gap") + F.col("n0")
    if not mean:
        near = each.select("layer", F.col("to").alias(f"to_{name}"), F.floor(place(left + step / 2) + 0.5).cast("int").alias(name), F.lit(1.0).alias(f"w_{name}"), "n0", "n1")
        return near.where(F.col(name).between(F.col("n0"), F.col("n1"))).drop("n0", "n1")
    first, last = F.floor(place(left) + 0.5 + 1e-9).cast("int"), F.ceil(place(left + step) - 0.5 - 1e-9).cast("int")
    each = each.select("*", F.explode(F.sequence(F.greatest(first, "n0"), F.least(F.greatest(last, first), "n1"))).alias(name))
    start = F.col("p0") + (F.col(name) - F.col("n0") - 0.5) * F.col("gap")
    overlap = F.least(left + step, start + F.col("gap")) - F.greatest(left, start)
    return each.select("layer", F.col("to").alias(f"to_{name}"), name, F.round(overlap, 9).alias(f"w_{name}")).where(F.col(f"w_{name}") > 0)


def align(cells: DataFrame, west: float, north: float, step: float, mean: bool = False) -> DataFrame:
    """layer, row, col, value on another grid of (layer, row, col, x, y, value): coarser, finer or shifted, without holes.

    Each target cell whose centre lies in the source takes its nearest cell (of two as near the one to the
    east or south), or with mean the average of all that it overlaps, by area, nulls left out. Sources of
    rows and columns are found once for each axis and joined, so no cell is compared with another.
    """
    rows = _axis(cells, "row", "y", -1, -north, step, mean)
    cols = _axis(cells, "col", "x", 1, west, step, mean)
    met = cells.select("layer", "row", "col", "value").join(rows, ["layer", "row"]).join(cols, ["layer", "col"])
    if not mean:
        return met.select("layer", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "value")
    weight = F.when(F.col("value").isNotNull(), F.col("w_row") * F.col("w_col"))
    by = met.groupBy("layer", F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum(weight * F.col("value")).alias("s"), F.sum(weight).alias("w"))
    return by.select("layer", "row", "col", F.round(F.col("s") / F.col("w"), 6).alias("value"))


def sample(points: DataFrame, cells: DataFrame, west: float, north: float, step: float) -> DataFrame:
    """id and value of the cell (row, col, value) that holds each point (id, x, y); null outside the grid."""
    row, col = cell_of(F.col("x"), F.col("y"), west, north, step)
    return points.select("id", row.alias("row"), col.alias("col")).join(cells.select("row", "col", "value"), ["row", "col"], "left").select("id", "value")


def stride(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column."""
    return cells.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def within_budget(cells: DataFrame, most: int, categorical: bool = False) -> DataFrame:
    """layer, row, col, value of at most about `most` cells a layer: blocks of a whole number of cells become their mean, or their first cell if categorical.

    The factor is the least whole number that brings the layer within the budget, and 1 where it is.
    """
    size = cells.groupBy("layer").agg(F.ceil(F.sqrt(F.count("*") / most)).cast("int").alias("factor"))  # a row for each layer
    both = cells.join(size, "layer")
    r, c = (F.floor(F.col(x) / F.col("factor")).cast("int").alias(x) for x in ("row", "col"))
    mean = F.sum(F.col("value").cast("decimal(28,6)")).cast("double") / F.nullif(F.count("value"), F.lit(0))
    value = F.min(F.struct("row", "col", "value"))["value"] if categorical else mean
    return both.groupBy("layer", r, c).agg(value.alias("value"))


def composite(stack: DataFrame, how: str = "median") -> DataFrame:
    """cell, band, scenes, value: one value over time, nodata skipped. how: median, mean, min, max, first or last (by t)."""
    v = F.col("value")
    timed = F.when(v.isNotNull(), F.struct("t", "value"))
    ways = {
        "median": F.percentile("value", F.lit(0.5)), "mean": F.sum(v.cast("decimal(28,6)")).cast("double") / F.count(v), "min": F.min(v), "max": F.max(v),
        "first": F.min(timed)["value"], "last": F.max(timed)["value"],
    }
    return stack.groupBy("cell", "band").agg(F.count("value").alias("scenes"), ways[how].alias("value"))


def compare_products(a: DataFrame, b: DataFrame) -> DataFrame:
    """By layer of two grids (layer, row, col, value): cells in common, mean and median difference, 90th percentile of its size, correlation."""
    d = F.col("value") - F.col("other")
    both = a.join(b.withColumnRenamed("value", "other"), ["layer", "row", "col"]).where("value is not null and other is not null")
    return both.groupBy("layer").agg(
        F.count("*").alias("cells"), (F.sum(d.cast("decimal(28,6)")).cast("double") / F.count("*")).alias("mean_difference"), F.round(F.percentile(d, F.lit(0.5)), 6).alias("median_difference"),
        F.round(F.percentile(F.abs(d), F.lit(0.9)), 6).alias("p90_difference"), F.round(F.corr("value", "other"), 6).alias("r"),
    )


def noise_floor(error_m: Column, cell_m: Column) -> Column:
    """Slope in degrees that a model cannot tell from its vertical error over one cell."""
    return F.degrees(F.atan(error_m / cell_m))


def depth_medians(profiles: DataFrame) -> DataFrame:
    """depth, n, median of each soil property (depth, property, value), and for pH the share above 7.5."""
    by = profiles.where("value is not null").groupBy("property", "depth").agg(
        F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.when(F.first("property") == "phh2o", F.avg((F.col("value") > 7.5).cast("double"))).alias("alkaline_share")
    )
    return by


def ice_summary(cells: DataFrame, code: int = 70, trace_pct: float = 0.1, outlier_m: float = 500.0, covered: tuple[float, float] | None = (-60.0, 82.75)) -> DataFrame:
    """One row a layer of (layer, lat, cover, value): area and share of ice, where it begins (first percentile), lowest, median and highest ice.

    Outside the latitudes that the map covers area and share are null, not 0; None for a map without such limits. trace: less than trace_pct of
    the area; outlier: the lowest ice lies more than outlier_m below where ice begins.
    """
    from freshet.sources.grids import cell_km2

    area = cell_km2(F.col("lat"))
    ice = F.col("cover") == code
    high = F.when(ice, F.col("value"))
    by = cells.where("cover is not null").groupBy("layer").agg(
        F.sum(area).cast("double").alias("km2"), F.coalesce(F.sum(F.when(ice, area)).cast("double"), F.lit(0.0)).alias("ice_km2"), F.percentile(high, F.array(F.lit(0.01), F.lit(0.5))).alias("q"),
        F.min(high).alias("lowest"), F.max(high).alias("highest"), F.min("lat").alias("south"), F.max("lat").alias("north"),
    )
    seen = F.lit(True) if covered is None else (F.col("south") >= covered[0]) & (F.col("north") <= covered[1])
    pct = F.col("ice_km2") / F.col("km2") * 100
    return by.select(
        "layer", F.when(seen, F.col("ice_km2")).alias("ice_km2"), F.when(seen, F.round(pct, 6)).alias("ice_pct"), F.round(F.col("q")[0], 6).alias("floor"), "lowest", F.round(F.col("q")[1], 6).alias("median"), "highest",
        (seen & (pct > 0) & (pct < trace_pct)).alias("trace"), F.coalesce(F.col("q")[0] - F.col("lowest") > outlier_m, F.lit(False)).alias("outlier"),
    )


def largest_shares(units: DataFrame, whole: float, n: int = 5) -> DataFrame:
    """The n largest units (id, area), their share of the whole in percent and the running share."""
    from freshet.operators.network import largest

    top = largest(units, "area", n)  # n rows
    run = F.sum("area").over(Window.orderBy("place"))
    return top.select("place", "id", "area", (F.col("area") / whole * 100).alias("share_pct"), (run / whole * 100).alias("running_pct"))


def quality_report(indicators: DataFrame) -> DataFrame:
    """basin, layers, graded, failed and overall of indicators (basin, layer, grade, error): the worst known grade; failures stay as rows elsewhere."""
    from freshet.operators.checks import worst

    by = indicators.groupBy("basin").agg(F.count("*").alias("layers"), F.count("grade").alias("graded"), F.count("error").alias("failed"), F.collect_set("grade").alias("g"))
    has = lambda name: F.when(F.array_contains("g", name), name)
    overall = worst([F.coalesce(has(n), F.lit("")) for n in ("LIMITED", "MODERATE", "HIGH")])
    return by.select("basin", "layers", "graded", "failed", F.when(F.col("graded") > 0, overall).alias("overall"))


def compare_basins(points: DataFrame, *blocks: DataFrame) -> DataFrame:
    """One row for each point (id), with the columns of each block (id, ...) where it has them, and error where none has."""
    out = points.select("id")
    for b in blocks:
        out = out.join(b, "id", "left")
    own = [c for c in out.columns if c != "id"]
    return out.withColumn("error", F.when(F.coalesce(*[F.col(c).cast("string") for c in own]).isNull(), "no data"))
