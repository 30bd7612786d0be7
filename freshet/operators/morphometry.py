"""Basin morphometry from stream orders, dimensions and elevations. One row per basin unless said otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PI = 3.141592653589793


def linear(orders: DataFrame, dims: DataFrame) -> DataFrame:
    """Linear measures by basin of orders (basin, order, streams, length) and dims (basin, area_km2, perimeter_km, length_km, stem_km, straight_km).

    Ratios skip pairs of orders without streams; the weighted ratio counts each pair by its streams.
    """
    w = Window.partitionBy("basin").orderBy("order")  # as many rows as orders
    n, ahead = F.col("streams").cast("double"), F.lead("streams").over(w)
    mean = F.try_divide(F.col("length"), n)
    pairs = orders.select(
        "basin", "order", "streams", "length", F.try_divide(n, ahead).alias("rb"), (n + ahead).alias("weight"),
        F.when(F.lag("streams").over(w) > 0, F.try_divide(mean, F.lag(mean).over(w))).alias("rl"),
    )
    by = pairs.groupBy("basin").agg(
        F.count("*").alias("orders"), F.max("order").alias("highest_order"), F.sum("streams").alias("streams"), F.sum(F.col("length").cast("decimal(28,6)")).cast("double").alias("stream_km"),
        F.round(F.avg("rb"), 6).alias("mean_rb"), F.round(F.try_divide(F.sum(F.col("rb") * F.col("weight")), F.sum(F.when(F.col("rb").isNotNull(), F.col("weight")))), 6).alias("weighted_rb"),
        F.round(F.avg("rl"), 6).alias("mean_rl"),
    )
    out = by.join(dims.select("basin", "area_km2", "perimeter_km", "length_km", "stem_km", "straight_km"), "basin")
    return out.select(
        *by.columns, F.round(F.try_divide("mean_rl", "mean_rb"), 6).alias("rho"), F.round(F.try_divide(F.col("area_km2"), 2 * F.col("stream_km")), 6).alias("overland_km"),
        "length_km", "perimeter_km", "stem_km", F.round(F.try_divide("stem_km", "straight_km"), 6).alias("sinuosity"),
    )


def areal(measures: DataFrame) -> DataFrame:
    """Areal measures of (basin, area_km2, perimeter_km, length_km, stem_km, streams, first_order, stream_km)."""
    a, p, length, n, km = (F.col(c).cast("double") for c in ("area_km2", "perimeter_km", "length_km", "streams", "stream_km"))
    dd, fs = km / a, n / a
    found = {
        "drainage_density": dd, "stream_frequency": fs, "drainage_texture": n / p, "texture_ratio": F.col("first_order") / p, "form_factor": a / (length * length),
        "elongation_ratio": 2 * F.sqrt(a / PI) / length, "circularity_ratio": 4 * PI * a / (p * p), "compactness": 0.2821 * p / F.sqrt(a), "shape_factor": length * length / a,
        "lemniscate_ratio": length * length / (4 * a), "channel_maintenance": F.try_divide(a, km), "infiltration_number": dd * fs, "drainage_intensity": F.try_divide(n, km),
        "length_area_relation": 1.4 * F.pow(a, F.lit(0.6)), "fitness_ratio": F.col("stem_km") / p, "wandering_ratio": F.col("stem_km") / length,
    }
    return measures.where("area_km2 > 0 and perimeter_km > 0 and length_km > 0").select("basin", "area_km2", *[F.round(e, 6).alias(k) for k, e in found.items()])


def relief(cells: DataFrame, dims: DataFrame, steps: int = 64) -> DataFrame:
    """Relief measures of cells (basin, z) and dims (basin, area_km2, perimeter_km, length_km, stem_km, stream_km, z_head, z_mouth).

    The integral is that of the curve of steps + 1 percentiles by trapezoids.
    """
    marks = F.array(*[F.lit(1 - k / steps) for k in range(steps + 1)])
    by = cells.where("z is not null").groupBy("basin").agg(
        F.min("z").alias("z_min"), F.max("z").alias("z_max"), (F.sum(F.col("z").cast("decimal(28,6)")).cast("double") / F.count("z")).alias("z_mean"), F.percentile("z", marks).alias("curve")
    )
    h = F.col("z_max") - F.col("z_min")
    ends = (F.get("curve", F.lit(0)) + F.get("curve", F.lit(steps))) / 2
    area = (F.aggregate("curve", F.lit(0.0), lambda a, x: a + x) - ends) / steps
    out = by.join(dims, "basin").withColumn("relief", h)
    km = F.col("relief") / 1000
    found = {
        "relief_ratio": km / F.col("length_km"), "relative_relief": F.col("relief") / (F.col("perimeter_km") * 1000) * 100, "ruggedness": km * F.col("stream_km") / F.col("area_km2"),
        "melton": km / F.sqrt("area_km2"), "hypsometric_integral": F.try_divide(area - F.col("z_min"), F.col("relief")), "elevation_relief_ratio": F.try_divide(F.col("z_mean") - F.col("z_min"), F.col("relief")),
        "channel_relief": F.col("z_head") - F.col("z_mouth"), "channel_gradient": F.try_divide(F.col("z_head") - F.col("z_mouth"), F.col("stem_km")),
    }
    return out.select("basin", "z_min", "z_max", F.round("z_mean", 6).alias("z_mean"), F.round("relief", 6).alias("relief"), *[F.round(e, 6).alias(k) for k, e in found.items()])


def warnings(orders: DataFrame) -> DataFrame:
    """What the stream counts (basin, order, streams) say against themselves: basin, check, severity, order.

    A ratio below 2 or several streams of the highest order are impossible; a mean ratio outside 3 to 5 is unusual.
    """
    w = Window.partitionBy("basin").orderBy("order")  # as many rows as orders
    pairs = orders.select("basin", "order", "streams", F.lead("streams").over(w).alias("ahead"))
    floor = pairs.where((F.col("ahead") > 0) & (F.col("streams") < 2 * F.col("ahead"))).select("basin", F.lit("bifurcation_ratio_floor").alias("check"), F.lit("impossible").alias("severity"), "order")
    top = pairs.where(F.col("ahead").isNull() & (F.col("streams") > 1)).select("basin", F.lit("single_highest_order_stream"), F.lit("impossible"), "order")
    mean = pairs.groupBy("basin").agg(F.avg(F.try_divide(F.col("streams").cast("double"), "ahead")).alias("rb"))
    odd = mean.where(~F.col("rb").between(3.0, 5.0)).select("basin", F.lit("bifurcation_ratio_range"), F.lit("unusual"), F.lit(None).cast(dict(orders.dtypes)["order"]))
    return floor.union(top).union(odd)


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n, 2), by monotone chains."""
    p = np.unique(points, axis=0).tolist()
    if len(p) < 3:
        return np.array(p)

    def chain(rows):
        out: list = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_corners(points: DataFrame) -> DataFrame:
    """basin, seq, x, y: corners of the convex hull of each basin's points (basin, x, y), counterclockwise.

    Each batch sends the corners of its own points; a basin's task sees no more than those.
    """
    kind = dict(points.dtypes)["basin"]

    def corners(batches):
        for t in batches:
            for basin, g in t.dropna().groupby("basin", sort=False):
                h = _hull(g[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({"basin": basin, "seq": range(len(h)), "x": h[:, 0], "y": h[:, 1]})

    schema = f"basin {kind}, seq int, x double, y double"
    few = points.select("basin", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(corners, schema)
    return few.groupBy("basin").applyInPandas(lambda t: next(iter(corners([t])), t.head(0)), schema)


def basin_length(points: DataFrame) -> DataFrame:
    """basin and length: the largest distance between two points (basin, x, y) of a basin.

    Only corners of the hull can be farthest apart, so only they are compared with each other.
    """
    hull = hull_corners(points)
    other = hull.select(F.col("basin").alias("_b"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    far = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    return hull.join(other, F.col("basin") == F.col("_b")).groupBy("basin").agg(F.round(F.max(far), 6).alias("length"))
