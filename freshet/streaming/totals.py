"""Totals of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(events: DataFrame, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """start, n and total by windows of ts of (ts, value); events later than the watermark are left out. For streams and tables.

    A watermark needs an instant, so a ts without a zone is taken as UTC, and start comes without a zone.
    """
    utc, here, ts = F.lit("UTC"), F.current_timezone(), F.col("ts")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        ts = F.convert_timezone(utc, here, ts)
    seen = events.select(ts.cast("timestamp").alias("ts"), "value").withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"))
    start = F.convert_timezone(here, utc, F.col("w.start").cast("timestamp_ntz"))
    return seen.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(start.alias("start"), "n", "total")
