"""Scalar functions as column expressions, all within code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
# Acklam's rational approximation of the inverse normal distribution, highest power first.
CENTRE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
TAIL_BELOW = 0.02425
# Texture classes of the USDA triangle by sand, clay and silt percentage; the first that holds counts.
TEXTURES = [
    ("clay", "clay >= 40 and silt < 40 and sand <= 45"),
    ("silty clay", "clay >= 40 and silt >= 40"),
    ("sandy clay", "clay >= 35 and sand >= 45"),
    ("clay loam", "clay >= 27 and clay < 40 and sand > 20 and sand <= 45"),
    ("silty clay loam", "clay >= 27 and clay < 40 and sand <= 20"),
    ("sandy clay loam", "clay >= 20 and clay < 35 and silt < 28 and sand > 45"),
    ("loam", "clay >= 7 and clay < 27 and silt >= 28 and silt < 50 and sand <= 52"),
    ("silt", "silt >= 80 and clay < 12"),
    ("silt loam", "silt >= 50 and clay < 27"),
    ("sand", "silt + 1.5D * clay < 15"),
    ("loamy sand", "silt + 2 * clay < 30"),
    ("sandy loam", "clay < 20 and sand >= 52"),
    ("loam", "sand is not null and clay is not null"),
]


def polynomial(x: Column, coefficients) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """z of a probability; null outside (0, 1)."""
    q = p - 0.5
    r = q * q
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = polynomial(t, TAIL[0]) / polynomial(t, TAIL[1])
    centre = polynomial(r, CENTRE[0]) * q / polynomial(r, CENTRE[1])
    inside = F.when(p < TAIL_BELOW, tail).when(p > 1 - TAIL_BELOW, -tail).otherwise(centre)
    return F.when((p > 0) & (p < 1), inside)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def texture_sql() -> str:
    """CASE over columns sand, clay and silt."""
    return "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in TEXTURES) + " END"


def banded(value: Column, bands: list[tuple[float, str]], above: str) -> Column:
    """Name of the first band whose upper limit lies above the value; null stays null."""
    out = F.lit(above)
    for top, name in reversed(bands):
        out = F.when(value < top, name).otherwise(out)
    return F.when(value.isNotNull(), out)
