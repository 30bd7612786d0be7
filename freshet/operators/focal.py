"""Terrain surfaces from cells and their neighbours, as windows along rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.sources.grids import cell_km2, cell_metres


def _along():
    return Window.partitionBy("layer", "row").orderBy("col")


def _across():
    return Window.partitionBy("layer", "col").orderBy("row")


def _difference(w, of: str = "value") -> Column:
    """Half the difference of both neighbours, one-sided at the edge of the grid; null beside nodata."""
    v = F.col(of)
    edge0, edge1 = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    ahead, behind = F.lead(v).over(w), F.lag(v).over(w)
    d = F.when(edge0 & edge1, None).when(edge0, ahead - v).when(edge1, v - behind).otherwise((ahead - behind) / 2)
    return F.when(v.isNotNull(), d)


def gradient(cells: DataFrame, step: float = 0.01) -> DataFrame:
    """cells with gx (to the east) and gy (to the north), in units of value for a metre."""
    dx, dy = cell_metres(F.col("y"), step)
    return cells.withColumn("gx", _difference(_along()) / dx).withColumn("gy", -_difference(_across()) / dy)


def surfaces(cells: DataFrame, step: float = 0.01, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """slope (degrees), aspect (degrees from north that the slope faces, null where flat) and hillshade."""
    g = gradient(cells, step)
    rise = F.hypot("gx", "gy")
    facing = F.pmod(F.degrees(F.atan2(-F.col("gx"), -F.col("gy"))) + 360, F.lit(360.0))
    g = g.withColumn("s", F.atan(rise)).withColumn("a", F.when(rise >= 1e-9, facing))
    alt, az = F.radians(F.lit(altitude)), F.radians(F.lit(azimuth))
    lit = F.sin(alt) * F.cos("s") + F.cos(alt) * F.sin("s") * F.cos(az - F.radians(F.coalesce("a", F.lit(0.0))))
    shade = F.when(F.col("s").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), lit)))
    return g.select("layer", "row", "col", F.round(F.degrees("s"), 6).alias("slope"), F.round("a", 6).alias("aspect"), F.round(shade, 6).alias("hillshade"))


def position(cells: DataFrame, window: int = 3) -> DataFrame:
    """tpi (value less the mean of its window) and roughness (range of the 3 by 3 cells about it).

    Both are separable: one pass along rows, one along columns. Null at nodata.
    """
    p = window // 2
    wide, tall = _along().rowsBetween(-p, p), _across().rowsBetween(-p, p)
    near, over = _along().rowsBetween(-1, 1), _across().rowsBetween(-1, 1)
    exact = F.col("value").cast("decimal(18,4)")
    rows = cells.select("layer", "row", "col", "value", F.sum(exact).over(wide).alias("t"), F.count("value").over(wide).alias("n"), F.min("value").over(near).alias("lo"), F.max("value").over(near).alias("hi"))
    mean = F.sum("t").over(tall).cast("double") / F.nullif(F.sum("n").over(tall), F.lit(0))
    known = F.col("value").isNotNull()
    return rows.select(
        "layer", "row", "col",
        F.when(known, F.round(F.col("value") - mean, 6) + 0.0).alias("tpi"),
        F.when(known, F.round(F.max("hi").over(over) - F.min("lo").over(over), 6)).alias("roughness"),
    )


def ruggedness(cells: DataFrame) -> DataFrame:
    """tri: root of the summed squared differences to the 8 neighbours, the edge repeated outward, nodata skipped."""

    def both(c: Column, w):
        first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
        return F.when(first, c).otherwise(F.lag(c).over(w)), F.when(last, c).otherwise(F.lead(c).over(w))

    v = F.col("value")
    rows = cells.select("layer", "row", "col", "value", F.array(v, *both(v, _along())).alias("near"))
    around = F.concat("near", *both(F.col("near"), _across()))
    rows = rows.select("layer", "row", "col", "value", around.alias("near"))
    # the centre itself adds nothing
    total = F.aggregate("near", F.lit(0.0), lambda a, x: a + F.coalesce((x - F.col("value")) * (x - F.col("value")), F.lit(0.0)))
    return rows.select("layer", "row", "col", F.when(v.isNotNull(), F.round(F.sqrt(total), 6)).alias("tri"))


# The classes of slope position, by number.
LANDFORMS = ("valley", "lower slope", "flat", "mid slope", "upper slope", "ridge")


def landform(cells: DataFrame, window: int = 11, flat: float = 5.0) -> DataFrame:
    """Slope position 0 to 5, and its name, from tpi in units of its standard deviation over the layer, and slope.

    The middle classes need a known slope; without one they are null.
    """
    tpi = position(cells, window).select("layer", "row", "col", "tpi")
    # one row a layer, so the spread is joined and no layer passes through one task
    spread = tpi.groupBy("layer").agg(F.stddev_pop("tpi").alias("sd")).where("sd > 0")
    both = tpi.join(surfaces(cells).select("layer", "row", "col", "slope"), ["layer", "row", "col"]).join(spread, "layer")
    z, sd = F.col("tpi"), F.col("sd")
    kind = F.when(z <= -sd, 0).when(z <= -sd / 2, 1).when(z >= sd, 5).when(z >= sd / 2, 4).when(F.col("slope") <= flat, 2).when(F.col("slope") > flat, 3)
    names = F.array(*[F.lit(n) for n in LANDFORMS])
    return both.select("layer", "row", "col", kind.alias("landform")).withColumn("name", F.get(names, F.col("landform")))


def curvature(cells: DataFrame, step: float = 0.01) -> DataFrame:
    """laplacian: second differences along both axes, per metre; negative on a ridge, null beside nodata."""
    g = gradient(cells, step)
    dx, dy = cell_metres(F.col("y"), step)
    second = _difference(_along(), "gx") / dx - _difference(_across(), "gy") / dy
    return g.select("layer", "row", "col", (F.round(second, 9) + 0.0).alias("laplacian"))


def wetness(cells: DataFrame, drained: Column, step: float = 0.01) -> DataFrame:
    """twi of (layer, row, col, y, value): ln of the area drained per metre of width over the slope's tangent.

    drained: upstream cells. Slopes below a hundredth of a degree count as that.
    """
    dx, dy = cell_metres(F.col("y"), step)
    g = gradient(cells.withColumn("drained", drained), step)
    tangent = F.greatest(F.hypot("gx", "gy"), F.tan(F.radians(F.lit(0.01))))
    specific = (F.col("drained") + 1) * F.sqrt(dx * dy)
    return g.select("layer", "row", "col", F.when(F.col("gx").isNotNull() & F.col("gy").isNotNull(), F.round(F.log(specific / tangent), 6)).alias("twi"))


def level_surface(cells: DataFrame, smooth: float = 0.6, spread: float = 2.5, least_km2: float = 0.5, step: float = 0.01) -> DataFrame:
    """layer, area_km2, elevation of the largest connected level surface of each layer: standing water, as a radar model sees it.

    Cells whose 3 by 3 range is below `smooth` are joined to their eight neighbours; a body counts if
    98 of 100 of its cells lie within `spread` and it has least_km2.
    """
    from freshet.operators.network import components

    flat = cells.join(position(cells, 3).select("layer", "row", "col", "roughness"), ["layer", "row", "col"]).where(F.col("roughness") < smooth)
    flat = flat.select("layer", "row", "col", "value", cell_km2(F.col("y"), step).alias("km2"), F.struct("layer", "row", "col").alias("cell"))
    ahead = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    near = flat.select("layer", "cell", F.explode(ahead).alias("o"), "row", "col")
    near = near.select("cell", "layer", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))
    edges = near.join(flat.select("layer", "row", "col", F.col("cell").alias("other")), ["layer", "row", "col"]).select(F.col("cell").alias("a"), F.col("other").alias("b"))
    body = components(edges).select(F.col("node").alias("cell"), "component")
    by = flat.join(body, "cell", "left").groupBy("layer", F.coalesce("component", "cell").alias("body")).agg(
        F.sum("km2").cast("double").alias("area_km2"), F.percentile("value", F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))).alias("q")
    )
    by = by.where((F.col("area_km2") >= least_km2) & (F.col("q")[2] - F.col("q")[0] <= spread))
    best = by.groupBy("layer").agg(F.max(F.struct("area_km2", F.col("q")[1].alias("z"))).alias("b"))
    return best.select("layer", F.col("b.area_km2").alias("area_km2"), F.round("b.z", 6).alias("elevation"))
