"""Rasters, routing trees and series as DataFrames, read from Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRES_PER_DEGREE_LAT = 110574.0
METRES_PER_DEGREE_LON = 111320.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_grid(table: DataFrame, cell: str, value: Column, width: int, north: float = 45.0, step: float = 0.01, **more: Column) -> DataFrame:
    """layer, row, col, y, value (null: nodata) of a table whose cell numbers run row by row."""
    row = F.floor(F.col(cell) / width).cast("int")
    return table.select(
        F.lit(0).alias("layer"),
        row.alias("row"),
        F.pmod(F.col(cell), F.lit(width)).cast("int").alias("col"),
        (F.lit(north) - row * F.lit(step)).alias("y"),
        value.alias("value"),
        *[c.alias(n) for n, c in more.items()],
    )


def cell_metres(y: Column, step: float = 0.01) -> tuple[Column, Column]:
    """Width and height of a cell in metres."""
    return F.lit(step * METRES_PER_DEGREE_LON) * F.cos(F.radians(y)), F.lit(step * METRES_PER_DEGREE_LAT)


def cell_km2(y: Column, step: float = 0.01) -> Column:
    """Area of a cell, as a decimal so that sums don't depend on their order."""
    dx, dy = cell_metres(y, step)
    return (dx * dy / 1e6).cast("decimal(20,9)")
