"""Statistics of series and groups, and joins on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Chebyshev-like coefficients of the complementary error function (Press et al., erfcc), constant first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p_sql(z: str) -> str:
    """Probability of a standard normal at least as far from 0 as z, to seven digits, as SQL for Spark and others."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = repr(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {poly}))"


def normal_cdf_sql(z: str) -> str:
    return f"(CASE WHEN {z} < 0 THEN {two_sided_p_sql(z)} / 2 ELSE 1 - {two_sided_p_sql(z)} / 2 END)"


def extremes(annual: DataFrame) -> DataFrame:
    """One row of (year, total): n, mean, least and most with their years (the first of equals)."""
    low, high = F.min(F.struct("total", "year")), F.max(F.struct("total", (-F.col("year")).alias("y")))
    by = annual.where("total is not null").agg(F.count("*").alias("n"), (F.sum(F.col("total").cast("decimal(28,4)")).cast("double") / F.count("*")).alias("mean"), low.alias("lo"), high.alias("hi"))
    return by.select("n", "mean", F.col("lo.total").alias("least"), F.col("lo.year").alias("least_year"), F.col("hi.total").alias("most"), (-F.col("hi.y")).alias("most_year"))


def wet_season(climatology: DataFrame, first: int = 6, last: int = 9) -> DataFrame:
    """One row of (month, mean): the wettest month and the share in percent of the months from first to last."""
    by = climatology.agg(F.max(F.struct("mean", (-F.col("month")).alias("m"))).alias("b"), F.sum("mean").alias("all"), F.sum(F.when(F.col("month").between(first, last), F.col("mean"))).alias("wet"))
    return by.select((-F.col("b.m")).alias("wettest_month"), F.round(F.try_divide("wet", "all") * 100, 6).alias("season_pct"))


def significance(trends: DataFrame, per: float = 1.0, level: float = 0.05) -> DataFrame:
    """trend rows (n, s, var, z, sen) with p, significant, direction and the slope for `per` steps (12 for a year of months)."""
    p = F.expr(two_sided_p_sql("z"))
    out = trends.withColumn("p", F.round(p, 6)).withColumn("significant", F.col("p") < level)
    way = F.when(~F.col("significant"), "none").when(F.col("s") > 0, "increasing").otherwise("decreasing")
    return out.withColumn("direction", way).withColumn("slope", F.round(F.col("sen") * per, 6))


def median_and_spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, quartiles, and the median distance from the median."""
    q = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    away = rows.join(q.select(by, "q"), by).groupBy(by).agg(F.percentile(F.abs(F.col(value) - F.col("q")[1]), F.lit(0.5)).alias("mad"))
    return q.join(away, by).select(by, "n", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], F.round("mad", 6).alias("mad"))


def linear_fit(rows: DataFrame, by: str, x: Column, y: Column) -> DataFrame:
    """by, n, slope, intercept and r2 of the least-squares line; null where x is constant."""
    both = rows.select(by, x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    fit = both.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("m"), F.regr_intercept("y", "x").alias("c"), F.regr_r2("y", "x").alias("r"))
    return fit.select(by, "n", F.round("m", 6).alias("slope"), F.round("c", 6).alias("intercept"), F.round("r", 6).alias("r2"))


def mann_whitney(rows: DataFrame, group: Column, value: Column) -> DataFrame:
    """One row: n1, n2, u, z, p of two groups (true and false), ties averaged, by the normal approximation.

    Ranks need the counts of equal values only, and those are ranked in steps of ranges of the value.
    """
    v = rows.select(value.cast("double").alias("v"), group.alias("g")).where("v is not null and g is not null")
    by = v.groupBy("v").agg(F.count("*").alias("n"), F.count_if("g").alias("n1"))
    parts = by.repartitionByRange("v").withColumn("_part", F.spark_partition_id())
    from freshet.operators.lineage import checkpoint

    parts = checkpoint(parts)
    size = parts.groupBy("_part").agg(F.sum("n").alias("_n"))  # a row for each range
    before = size.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
    ranked = parts.join(F.broadcast(before), "_part").withColumn("rank", below + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n2"), F.sum(F.col("rank") * F.col("n1")).alias("r1"))
    u = s.withColumn("u", F.col("r1") - F.expr("n1 * (n1 + 1) / 2"))
    z = F.expr("(u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12)")
    out = u.where("n1 > 0 and n2 > 0").select("n1", "n2", F.col("u").cast("double").alias("u"), F.round(z, 6).alias("z"))
    return out.withColumn("p", F.round(F.expr(two_sided_p_sql("z")), 6))


def accuracy(rows: DataFrame, by: Column) -> DataFrame:
    """band, n, median absolute and signed error in percent, shares within 5 and 20 %, of (found, reported)."""
    e = rows.where("reported > 0 and found is not null").select(by.alias("band"), ((F.col("found") - F.col("reported")) / F.col("reported") * 100).alias("e"))
    within = lambda k: F.round(F.count_if(F.abs("e") <= k) / F.count("*") * 100, 6).alias(f"within_{k}_pct")
    return e.groupBy("band").agg(F.count("*").alias("n"), F.round(F.percentile(F.abs("e"), F.lit(0.5)), 6).alias("median_error_pct"), F.round(F.percentile("e", F.lit(0.5)), 6).alias("median_signed_pct"), within(5), within(20))


def as_of(rows: DataFrame, states: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows (key, at, ...) with the value of the last state (key, at, value) not after them; before the first one, that of the first.

    Both are sorted together once for each key: states come before rows of the same place.
    """
    both = rows.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(at).alias("t"), F.lit(None).cast(dict(states.dtypes)[value]).alias("v"), F.lit(1).alias("kind")).unionByName(
        states.select(F.lit(None).cast(rows.select(F.struct("*").alias("row")).schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col(at).alias("t"), F.col(value).alias("v"), F.lit(0).alias("kind"))
    )
    line = Window.partitionBy("k").orderBy("t", "kind")
    # only rows before the first state lack one before them; a frame from each row to the end would be read anew for each row
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.coalesce(F.last("v", True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.first("v", True).over(whole))
    return both.withColumn("found", found).where("kind = 1").select("row.*", F.col("found").alias(value))


def missing_months(series: DataFrame, start: str, end: str, by: str) -> DataFrame:
    """by and t of each month from start to end that a series (by, t) lacks."""
    calendar = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month")))
    wanted = series.select(by).distinct().withColumn("t", calendar)
    return wanted.join(series.select(by, F.trunc("t", "month").alias("t")), [by, "t"], "left_anti")


def river_measures(reaches: DataFrame) -> DataFrame:
    """river, reaches, length_km, straight_km, sinuosity, highest_order, relief_m and gradient of (river, seq, x, y, z, length_km, order)."""
    ends = [f(F.struct("seq", "x", "y", "z")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))]
    by = reaches.groupBy("river").agg(F.count("*").alias("reaches"), F.sum(F.col("length_km").cast("decimal(28,6)")).cast("double").alias("length_km"), F.max("order").alias("highest_order"), *ends)
    straight = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2))
    fall = F.col("a.z") - F.col("b.z")
    return by.select(
        "river", "reaches", "length_km", F.round(straight, 6).alias("straight_km"), F.round(F.try_divide("length_km", straight), 6).alias("sinuosity"), "highest_order",
        F.round(fall, 6).alias("relief_m"), F.round(F.try_divide(fall, F.col("length_km")), 6).alias("gradient_m_per_km"),
    )


def profile_shape(profile: DataFrame) -> DataFrame:
    """By river of (river, distance, z) in downstream order: steepest, gentlest and median fall, concavity, drop in the upper third (null with one point there), whether it falls all the way."""
    line = Window.partitionBy("river").orderBy("distance")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = profile.where("z is not null").select(
        "river", "distance", "z", F.lag("z").over(line).alias("z0"), F.lag("distance").over(line).alias("x0"), F.lead("z").over(line).alias("z1"), F.lead("distance").over(line).alias("x1"),
        F.first("z").over(whole).alias("za"), F.last("z").over(whole).alias("zb"), F.first("distance").over(whole).alias("xa"), F.last("distance").over(whole).alias("xb"),
    )
    hs, hd = F.col("distance") - F.col("x0"), F.col("x1") - F.col("distance")
    middle = (hs * hs * F.col("z1") + (hd * hd - hs * hs) * F.col("z") - hd * hd * F.col("z0")) / (hs * hd * (hd + hs))
    g = F.when(F.col("x0").isNull(), (F.col("z1") - F.col("z")) / hd).when(F.col("x1").isNull(), (F.col("z") - F.col("z0")) / hs).otherwise(middle)
    drop = F.col("za") - F.col("zb")
    part = F.when(F.col("x0").isNotNull(), ((F.col("z") - F.col("zb")) + (F.col("z0") - F.col("zb"))) / 2 * hs)
    upper = (F.col("distance") - F.col("xa")) * 3 <= F.col("xb") - F.col("xa")
    by = p.select("river", (-g).alias("fall"), drop.alias("drop"), part.alias("part"), (F.col("xb") - F.col("xa")).alias("span"), F.when(upper, F.struct("distance", "z")).alias("upper"), "za", (F.col("z") > F.col("z0")).alias("rises"))
    by = by.groupBy("river", "drop", "span", "za").agg(F.count("*").alias("points"), F.max("fall").alias("hi"), F.min("fall").alias("lo"), F.percentile("fall", F.lit(0.5)).alias("mid"), F.sum("part").alias("under"), F.max("upper").alias("u"), F.count("upper").alias("in_upper"), F.count_if("rises").alias("rises"))
    under = F.try_divide("under", F.col("drop") * F.col("span"))
    return by.select(
        "river", "points", F.round("hi", 6).alias("steepest"), F.round("lo", 6).alias("gentlest"), F.round("mid", 6).alias("median_fall"),
        F.when(F.col("drop") > 0, F.round((0.5 - under) * 2, 6)).alias("concavity"), F.when((F.col("drop") > 0) & (F.col("in_upper") > 1), F.round((F.col("za") - F.col("u.z")) / F.col("drop") * 100, 6)).alias("upper_third_pct"),
        (F.col("rises") == 0).alias("falls"),
    )
