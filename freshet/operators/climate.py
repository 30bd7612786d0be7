"""Series (t, value) by period."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annual_total(series: DataFrame) -> DataFrame:
    return series.groupBy(F.year("t").alias("year")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


def monthly_climatology(series: DataFrame) -> DataFrame:
    """Mean over all rows of each calendar month."""
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return series.groupBy(F.month("t").alias("month")).agg((total / F.count("value")).alias("mean"))


def trend(series: DataFrame) -> DataFrame:
    """Mann-Kendall S, its variance corrected for ties, z, and Sen's slope for a step of t (a whole number).

    All pairs of a series meet, so it is for series of periods, whose number does not grow with the
    rows behind them. Fewer than ten values give no row.
    """
    a, b = series.select(F.col("t").alias("t0"), F.col("value").alias("v0")), series.select("t", "value")
    pairs = a.join(b, F.col("t0") < F.col("t")).agg(
        F.sum(F.signum(F.col("value") - F.col("v0"))).cast("long").alias("s"),
        F.round(F.percentile((F.col("value") - F.col("v0")) / (F.col("t") - F.col("t0")), F.lit(0.5)), 6).alias("sen"),
    )
    ties = series.groupBy("value").agg(F.count("*").alias("m")).agg(F.sum("m").alias("n"), F.sum(F.expr("m * (m - 1) * (2 * m + 5)")).alias("tied"))
    both = pairs.crossJoin(ties).where("n >= 10")  # one row each
    var = F.expr("(n * (n - 1) * (2 * n + 5) - tied) / 18.0D")
    return both.select("n", "s", var.alias("var"), F.round(F.expr("(s - sign(s))") / F.sqrt(var), 6).alias("z"), "sen")


def _inversions(x: np.ndarray) -> int:
    """Pairs of which the first is the larger: ranks are dealt by one bit after another from the highest, in order."""
    n = len(x)
    if n < 2:
        return 0
    order = np.argsort(x, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)  # equal values rise, so they make no pair
    total, at = 0, np.arange(n)
    for bit in range(int(n - 1).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1
        start = (rank >> (bit + 1)) << (bit + 1)  # ranks of a group fill the places from here on
        before = np.cumsum(one) - one
        ones = before - before[start]
        total += int(ones[one == 0].sum())
        place = np.where(one == 1, start + (1 << bit) + ones, at - ones)
        moved = np.empty(n, np.int64)
        moved[place] = rank
        rank = moved
    return total


def _slopes_below(t: np.ndarray, y: np.ndarray, m: float) -> int:
    """Pairs of different t whose slope is below m."""
    by = np.lexsort((y, t))
    return _inversions(y[by] - m * t[by])


def _median_slope(t: np.ndarray, y: np.ndarray, most: int = 1 << 20) -> float | None:
    """Sen's slope: the median over all pairs of different t, in memory of the length of the series.

    Up to `most` pairs are sorted. Of more, the pairs with a slope below a mark are those that y less
    mark times t puts in reverse order, and are counted by sorting; the mark is halved in until the slopes
    about the median agree to some twelve digits, and one of these pairs' slope is taken.
    """
    by = np.lexsort((y, t))
    t, y = t[by] - t.min(initial=np.inf) if len(t) else t, y[by]
    n = len(t)
    same = np.unique(t, return_counts=True)[1].astype(object)
    total = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not total:
        return None
    if n * n <= most:
        dt = t[None, :] - t[:, None]
        use = dt > 0
        return float(np.median((y[None, :] - y[:, None])[use] / dt[use]))
    steps = np.diff(t)
    far = float((y.max() - y.min()) / steps[steps > 0].min()) * 1.001
    falling, rising = _slopes_below(t, y, 0.0), _slopes_below(t, -y, 0.0)
    out, low, high, last = [], 0.0, 0.0, 0
    for k in sorted({(total - 1) // 2, total // 2}):
        if out and k < last:
            out.append(out[0])  # the bracket of the one before holds this one too
            continue
        if falling <= k < total - rising:
            out.append(0.0)
            continue
        low, high, last = (-far, 0.0, falling) if k < falling else (0.0, far, total)
        while high - low > 2.0**-44 * max(abs(low), abs(high)):
            mid = (low + high) / 2
            count = _slopes_below(t, y, mid)
            if count > k:
                high, last = mid, count
            else:
                low = mid
        one = np.argsort(y - low * t, kind="stable")
        other = np.empty(n, np.int64)
        other[np.argsort(y - high * t, kind="stable")] = np.arange(n)
        turned = np.flatnonzero((other[one[1:]] < other[one[:-1]]) & (t[one[1:]] != t[one[:-1]]))
        i, j = (one[turned[0]], one[turned[0] + 1]) if len(turned) else (None, None)
        out.append(float((y[j] - y[i]) / (t[j] - t[i])) if len(turned) else (low + high) / 2)
    return float(np.mean(out))


def trends(series: DataFrame) -> DataFrame:
    """key, n, s, var, z, p, sen, direction for each key of (key, t, value): a trend for each cell of a stack, say.

    Mann-Kendall with ties corrected for, its two-sided p, and Sen's slope for a step of t. Nulls are left
    out, rows of one t are ordered by value and make no slope; fewer than ten values give no row. A
    key is one group, in memory of its own length.
    """
    kind = dict(series.dtypes)["key"]

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["t", "value"], kind="stable")
        x, y = t["t"].to_numpy(np.float64), t["value"].to_numpy(np.float64)
        n = len(y)
        if n < 10:
            return pd.DataFrame(columns=["key", "n", "s", "var", "z", "p", "sen"])
        s = _slopes_below(x, -y, 0.0) - _slopes_below(x, y, 0.0)  # no order among rows of one t
        same = np.unique(y, return_counts=True)[1].astype(object)
        var = float(n * (n - 1) * (2 * n + 5) - (same * (same - 1) * (2 * same + 5)).sum()) / 18
        z = (s - np.sign(s)) / var**0.5 if var > 0 else 0.0
        return pd.DataFrame({"key": [t["key"].iloc[0]], "n": [n], "s": [s], "var": [var], "z": [z], "p": [math.erfc(abs(z) / 2**0.5)], "sen": [_median_slope(x, y)]})

    known = series.where("value is not null and not isnan(value)").select("key", F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))
    found = known.groupBy("key").applyInPandas(one, f"key {kind}, n long, s long, var double, z double, p double, sen double")
    sen = F.round("sen", 6)
    direction = F.when(sen > 0, "increasing").when(sen < 0, "decreasing").when(sen == 0, "flat")
    return found.select("key", "n", "s", "var", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"), sen.alias("sen"), direction.alias("direction"))


def rank_average(series: DataFrame) -> DataFrame:
    """t, value and the rank of a value in its calendar month, ties averaged."""
    month = F.month("t")
    same = Window.partitionBy(month, "value")
    return series.select("t", "value", (F.rank().over(Window.partitionBy(month).orderBy("value")) + (F.count("*").over(same) - 1) / 2).alias("rank"))


# Degrees of drought, by the least index of each.
SPI_LABELS = [(2.0, "extremely wet"), (1.5, "very wet"), (1.0, "moderately wet"), (-1.0, "near normal"), (-1.5, "moderately dry"), (-2.0, "severely dry")]


def spi_label(value: Column) -> Column:
    """Words for a drought index; null where it is null."""
    out = F.lit("extremely dry")
    for least, name in reversed(SPI_LABELS):
        out = F.when(value >= least if least > -1 else value > least, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def spi(series: DataFrame, scale: int = 3, least: int = 10, step: str = "month") -> DataFrame:
    """series, t, total, spi of rows (series, t, value), at most one row for each step of t (month or day).

    total runs over `scale` steps of the calendar, and only windows without a null or a missing step count; each is ranked among the totals of its
    series and calendar month (ties averaged, Weibull positions). Fewer than `least` of them give null.
    """
    from freshet.functions.scalar import normal_quantile

    run = Window.partitionBy("series").orderBy("t").rowsBetween(1 - scale, 0)
    total = F.sum(F.col("value").cast("decimal(18,4)")).over(run)
    place = F.datediff("t", F.lit("1970-01-01")) if step == "day" else F.year("t") * 12 + F.month("t")
    first = F.min(place).over(run)
    full = series.select("series", "t", total.cast("double").alias("total"), F.count("value").over(run).alias("n"), (place - first).alias("span")).where((F.col("n") == scale) & (F.col("span") == scale - 1))
    full = full.drop("n", "span")
    month = Window.partitionBy("series", F.month("t"))
    rank = F.rank().over(month.orderBy("total")) + (F.count("*").over(Window.partitionBy("series", F.month("t"), "total")) - 1) / 2
    ranked = full.select("series", "t", "total", rank.alias("rank"), F.count("*").over(month).alias("m"))
    return ranked.select("series", "t", "total", F.when(F.col("m") >= least, F.round(normal_quantile(F.col("rank") / (F.col("m") + 1)), 6)).alias("spi"))


def water_balance(flows: DataFrame) -> DataFrame:
    """By year of (t, ppt, aet, pet, q): totals, residual, runoff coefficient and aridity; null where it would divide by 0."""
    total = {c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double") for c in ("ppt", "aet", "pet", "q")}
    by = flows.groupBy(F.year("t").alias("year")).agg(*[e.alias(c) for c, e in total.items()])
    return by.select("*", F.expr("ppt - aet - q").alias("residual"), F.expr("try_divide(q, ppt)").alias("runoff_coefficient"), F.expr("try_divide(ppt, pet)").alias("aridity"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two products (year, total) over their common years: n, Pearson r, bias of a against b."""
    both = a.join(b.withColumnRenamed("total", "other"), "year")
    return both.agg(F.count("*").alias("n"), F.round(F.corr("total", "other"), 6).alias("r"), F.round(F.try_divide(F.avg("total"), F.avg("other")) - 1, 6).alias("bias"))


def composite_median(stack: DataFrame) -> DataFrame:
    """Median over time of each cell and band, nodata skipped."""
    return stack.groupBy("cell", "band").agg(F.count("value").alias("scenes"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("value"))
