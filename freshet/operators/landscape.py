"""Channel steepness over a routing tree of cells, and what is read off a terrain that was routed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.network import main_stem, main_upstream, path_sums, path_window

# Reference concavity and reference area in m2.
THETA, A0 = 0.45, 1.0e6
# Least median slope in degrees and the area in km2 that starts a channel there.
INITIATION = [(15.0, 0.05), (5.0, 0.25), (None, 1.0)]


def link_lengths(cells: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """id, next and step_m of (id, next, row, col): the way from a cell to the one it drains to; 0 at an outlet."""
    ahead = cells.select(F.col("id").alias("_id"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    both = cells.join(ahead, F.col("next") == F.col("_id"), "left")
    step = F.sqrt(F.pow((F.col("_r") - F.col("row")) * dy, 2) + F.pow((F.col("_c") - F.col("col")) * dx, 2))
    return both.select("id", "next", F.coalesce(F.round(step, 6), F.lit(0.0)).alias("step_m"))


def steepness(cells: DataFrame, theta: float = THETA, a0: float = A0, least_m2: float = 1.0e6) -> DataFrame:
    """id, chi, dist_out, slope, ksn of (id, next, z, area_m2, step_m); null off the channels (area below least_m2).

    chi adds (a0 / area)^theta for each metre of the way down, its own step included; a rise downstream
    counts as slope 0. Ways are summed by doubling pointers.
    """
    area, step = F.col("area_m2"), F.col("step_m")
    ok = (step > 0) & (area > 0)
    ways = path_sums(cells, {"chi": F.when(ok, F.pow(a0 / area, F.lit(theta)) * step).otherwise(0.0), "dist_out": F.when(ok, step).otherwise(0.0)})
    ahead = cells.select(F.col("id").alias("_id"), F.col("z").alias("_z"))
    both = cells.join(ahead, F.col("next") == F.col("_id"), "left").join(ways.select("id", "chi", "dist_out"), "id")
    slope = F.when(ok, F.greatest(F.col("z") - F.col("_z"), F.lit(0.0)) / step)
    on = area >= least_m2
    return both.select(
        "id", "area_m2", F.when(on, F.round("chi", 6)).alias("chi"), F.round("dist_out", 6).alias("dist_out"),
        F.when(on, F.round(slope, 9)).alias("slope"), F.when(on, F.round(slope * F.pow(area, F.lit(theta)), 6)).alias("ksn"),
    )


def smoothed(cells: DataFrame, n: int) -> DataFrame:
    """id and z_fit of (id, next, z, area_m2): the mean of z over a cell, the n below it and the n above it on the main stem.

    Fewer where the way ends; a cell without z has none. Heights count to a millionth.
    """
    down = path_window(cells, F.col("z"), n).select("id", F.col("total").alias("_d"), F.col("count").alias("_dn"))
    up = main_upstream(cells, F.col("area_m2")).join(cells.select("id", "z"), "id")
    up = path_window(up, F.col("z"), n).select("id", F.col("total").alias("_u"), F.col("count").alias("_un"))
    both = cells.select("id", "z").join(down, "id").join(up, "id")
    return both.select("id", F.when(F.col("z").isNotNull(), (F.col("z").cast("decimal(20,6)") + F.col("_d") + F.col("_u")).cast("double") / (1 + F.col("_dn") + F.col("_un"))).alias("z_fit"))


def steepness_fit(cells: DataFrame, n: int, theta: float = THETA, least_m2: float = 1.0e6) -> DataFrame:
    """id, slope_fit and ksn_smoothed of (id, next, z, area_m2, step_m) after heights are averaged along the flow over n cells either way.

    For the fit of concavity, which noise from cell to cell would bias; ksn itself is not smoothed, as
    that would flatten steep reaches. n of 0 leaves the heights as they are. Null off the channels.
    """
    fit = cells.join(smoothed(cells, n), "id")
    ahead = fit.select(F.col("id").alias("_id"), F.col("z_fit").alias("_z"))
    ok = (F.col("step_m") > 0) & (F.col("area_m2") > 0) & (F.col("area_m2") >= least_m2)
    slope = F.when(ok, F.greatest(F.col("z_fit") - F.col("_z"), F.lit(0.0)) / F.col("step_m"))
    both = fit.join(ahead, F.col("next") == F.col("_id"), "left")
    return both.select("id", "area_m2", F.round(slope, 9).alias("slope_fit"), F.round(slope * F.pow(F.col("area_m2"), F.lit(theta)), 6).alias("ksn_smoothed"))


def concavity(channels: DataFrame, least_m2: float = 1.0e6, bins: int = 30, in_bin: int = 10, least_bins: int = 5, least_cells: int = 50) -> DataFrame:
    """One row: theta, ks, bins, cells, r2 of the fit of log median slope on log area by bins of equal width.

    Only cells above least_m2 that fall count; too few cells or bins give no row. The last bin is open
    above, as the largest area lies on its edge.
    """
    used = channels.where((F.col("area_m2") > least_m2) & (F.col("slope") > 0)).select(F.log10("area_m2").alias("la"), "slope")
    span = used.agg(F.min("la").alias("lo"), F.max("la").alias("hi"), F.count("*").alias("cells"))
    k = F.floor((F.col("la") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    binned = used.join(F.broadcast(span)).where("hi > lo").withColumn("k", k).where(F.col("k") < bins)  # span is one row
    by = binned.groupBy("k", "lo", "hi", "cells").agg(F.count("*").alias("n"), F.percentile("slope", F.lit(0.5)).alias("mid")).where(F.col("n") >= in_bin)
    x, y = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") + 0.5) / bins, F.log10("mid")
    fit = by.select("cells", x.alias("x"), y.alias("y")).groupBy("cells").agg(
        F.count("*").alias("bins"), F.regr_slope("y", "x").alias("m"), F.regr_intercept("y", "x").alias("c"), F.regr_r2("y", "x").alias("r2")
    )
    fit = fit.where((F.col("bins") >= least_bins) & (F.col("cells") >= least_cells))
    return fit.select(F.round(-F.col("m"), 6).alias("theta"), F.round(F.pow(F.lit(10.0), "c"), 6).alias("ks"), "bins", "cells", F.round("r2", 6).alias("r2"))


def trunk(cells: DataFrame, least_m2: float = 1.0e6) -> DataFrame:
    """id and distance of the trunk of (id, next, area_m2, step_m): from the channel cell with the largest area up to the largest above it."""
    on = cells.where(F.col("area_m2") >= least_m2).select("id", "next", F.col("area_m2").alias("area"), F.col("step_m").alias("length"))
    mouth = on.groupBy().agg(F.max_by("id", F.struct("area", -F.col("id"))).alias("_mouth"))  # one row
    cut = on.join(F.broadcast(mouth)).withColumn("next", F.when(F.col("id") == F.col("_mouth"), None).otherwise(F.col("next"))).drop("_mouth")
    stem = main_stem(cut)
    ways = path_sums(cut, {}).select("id", "root").join(F.broadcast(mouth), F.col("root") == F.col("_mouth"), "left_semi").select("id")
    return stem.join(ways, "id", "left_semi")


def knickpoints(profile: DataFrame, min_drop: float = 30.0, window: int = 9) -> DataFrame:
    """trunk, chi, elevation, step, sigma of (trunk, chi, z): steps that stand out of the profile, upstream of the outlet.

    Points without chi or z are passed over. The gradient dz/dchi is scored by its distance from the
    trunk's median in units of the spread about it: a step begins where the score is above 3 and ends at
    the first point from there with 1.5 or less, else at the last point. The first and last `window`
    points begin none, and after a step (of whatever height) the next begins `window` points beyond its
    end at the earliest; trunks of fewer than three windows have none.
    """
    known = profile.where("chi is not null and z is not null and not isnan(chi) and not isnan(z)").select("trunk", F.col("chi").cast("double").alias("chi"), F.col("z").cast("double").alias("z"))
    line = Window.partitionBy("trunk").orderBy("chi", "z")
    near = [f(c).over(line).alias(n) for c in ("chi", "z") for f, n in ((F.lag, f"{c}_a"), (F.lead, f"{c}_b"))]
    rows = known.select("*", *near, (F.row_number().over(line) - 1).alias("i"), F.count("*").over(Window.partitionBy("trunk")).alias("n")).where(F.col("n") >= 3 * window)
    back, ahead = F.try_divide(F.col("z") - F.col("z_a"), F.col("chi") - F.col("chi_a")), F.try_divide(F.col("z_b") - F.col("z"), F.col("chi_b") - F.col("chi"))
    # between two points the slopes on either side, each by the other's share of the way
    share = (F.col("chi") - F.col("chi_a")) / (F.col("chi_b") - F.col("chi_a"))
    rows = rows.withColumn("g", F.when(F.col("chi_a").isNull(), ahead).when(F.col("chi_b").isNull(), back).otherwise(back * (1 - share) + ahead * share))
    middle = rows.groupBy("trunk").agg(F.percentile("g", F.lit(0.5)).alias("middle"))
    rows = rows.join(middle, "trunk")
    spread = rows.groupBy("trunk").agg(F.percentile(F.abs(F.col("g") - F.col("middle")), F.lit(0.5)).alias("spread"))
    rows = rows.join(spread, "trunk")
    rows = rows.withColumn("score", (F.col("g") - F.col("middle")) / (1.4826 * F.when(F.col("spread") > 0, F.col("spread")).otherwise(1e-9)))
    # read from the end, as a frame from each row to the end would be read anew for each row
    later = Window.partitionBy("trunk").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    calm = F.when(F.col("score") <= 1.5, F.struct("i", "z"))
    ends = rows.withColumn("end", F.coalesce(F.last(calm, True).over(later), F.first(F.struct("i", "z")).over(later)))
    starts = ends.where((F.col("score") > 3) & F.col("i").between(window, F.col("n") - window - 1))
    starts = starts.select("trunk", "i", F.col("end.i").alias("j"), "chi", F.col("z").alias("elevation"), (F.col("end.z") - F.col("z")).alias("step"), F.col("score").alias("sigma"))

    def apart(t: pd.DataFrame) -> pd.DataFrame:
        """Of the points where a step could begin, those that come after the one before has ended."""
        t, free, keep = t.sort_values("i"), -1, []
        for k, (i, j) in enumerate(zip(t["i"], t["j"], strict=True)):
            if i >= free:
                keep.append(k)
                free = j + window
        return t.iloc[keep]

    kind = dict(profile.dtypes)["trunk"]
    found = starts.groupBy("trunk").applyInPandas(apart, f"trunk {kind}, i int, j int, chi double, elevation double, step double, sigma double")
    return found.where(F.col("step") >= min_drop).select("trunk", "chi", "elevation", F.round("step", 6).alias("step"), F.round("sigma", 6).alias("sigma"))


def steepness_summary(channels: DataFrame) -> DataFrame:
    """One row: channel cells, median, 90th and 99th percentile of ksn above 0, share of flat channel cells, largest chi."""
    known = channels.where("ksn is not null")
    up = F.when(F.col("ksn") > 0, F.col("ksn"))
    return known.agg(
        F.count("*").alias("channel_cells"), *[F.round(F.percentile(up, F.lit(q)), 6).alias(n) for q, n in ((0.5, "ksn_median"), (0.9, "ksn_p90"), (0.99, "ksn_p99"))],
        F.round(F.try_divide(F.count_if(F.col("ksn") == 0), F.count("*")), 6).alias("zero_fraction"), F.max("chi").alias("chi_max"),
    )


def initiation(slopes: DataFrame) -> DataFrame:
    """layer, median slope and the area in km2 at which a channel begins."""
    by = slopes.groupBy("layer").agg(F.round(F.percentile("slope", F.lit(0.5)), 6).alias("median_slope"))
    area = F.lit(INITIATION[-1][1])
    for least, km2 in reversed(INITIATION[:-1]):
        area = F.when(F.col("median_slope") >= least, km2).otherwise(area)
    return by.select("layer", "median_slope", F.when(F.col("median_slope").isNotNull(), area).alias("initiation_km2"))


def density_curve(cells: DataFrame, chosen_km2: float, factors: tuple[float, ...] = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """Channel cells, length and drainage density of (drained_km2, step_m, area_km2) for thresholds about the chosen one.

    range_factor is the largest density over the least above 0; chosen marks the nearest threshold, the lower of two as near.
    """
    marks = F.array(*[F.lit(round(chosen_km2 * f, 9)) for f in factors])
    whole = cells.agg(F.sum(F.col("area_km2").cast("decimal(28,9)")).cast("double").alias("basin_km2"))
    # a cell counts for each threshold it reaches; counts are combined map-side
    each = cells.select(F.explode(marks).alias("threshold_km2"), "drained_km2", "step_m")
    on = F.col("drained_km2") >= F.col("threshold_km2")
    by = each.groupBy("threshold_km2").agg(F.count_if(on).alias("channel_cells"), (F.coalesce(F.sum(F.when(on, F.col("step_m").cast("decimal(28,6)"))), F.lit(0)).cast("double") / 1000).alias("length_km"))
    by = by.join(F.broadcast(whole)).withColumn("density", F.col("length_km") / F.col("basin_km2"))  # whole is one row
    span = Window.partitionBy()  # as many rows as thresholds
    some = F.when(F.col("density") > 0, F.col("density"))
    return by.select(
        "threshold_km2", "channel_cells", F.round("length_km", 6).alias("length_km"), F.round("density", 6).alias("density"),
        (F.col("threshold_km2") == F.min_by("threshold_km2", F.struct(F.abs(F.col("threshold_km2") - chosen_km2), "threshold_km2")).over(span)).alias("chosen"), F.round(F.coalesce(F.max(some).over(span) / F.min(some).over(span), F.lit(1.0)), 6).alias("range_factor"),
    )


def snap_to_stream(outlets: DataFrame, cells: DataFrame, rows: int, cols: int, reach: int = 12, least_km2: float = 1.0) -> DataFrame:
    """outlet, row, col, up_km2: the cell with the largest upstream area within `reach` cells of each outlet (outlet, row, col).

    Cells on the edge of the grid don't count, and outlets whose best cell drains less than least_km2 are
    absent. Each outlet meets its window as an equi-join of cells; ties go to the first by row and col.
    """
    inner = cells.where(F.col("row").between(1, rows - 2) & F.col("col").between(1, cols - 2) & F.col("up_km2").isNotNull()).select("row", "col", "up_km2")
    near = outlets.select("outlet", F.explode(F.sequence(F.col("row") - reach, F.col("row") + reach)).alias("row"), "col")
    near = near.select("outlet", "row", F.explode(F.sequence(F.col("col") - reach, F.col("col") + reach)).alias("col"))
    best = near.join(inner, ["row", "col"]).groupBy("outlet").agg(F.max(F.struct("up_km2", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("b"))
    return best.where(F.col("b.up_km2") >= least_km2).select("outlet", (-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col"), F.col("b.up_km2").alias("up_km2"))
