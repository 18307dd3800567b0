"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors to convert (from, to) units.
UNITS = {("Mt CO2/yr", "Gt CO2/yr"): 1e-3, ("Gt CO2/yr", "Mt CO2/yr"): 1e3, ("kt CO2/yr", "Mt CO2/yr"): 1e-3, ("kt CO2/yr", "Gt CO2/yr"): 1e-6}


def half_even(x: Column, digits: int) -> Column:
    """Rounds a double by scaling, half to even: not decimal rounding, 1.005 gives 1.0."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def floor_to(x: Column, step: float) -> Column:
    """Multiple of step at or below x, in double arithmetic."""
    return F.floor(x / step) * step


def ceil_to(x: Column, step: float) -> Column:
    return F.ceil(x / step) * step


def centi(x: Column) -> Column:
    """Hundredths as int, the join key of warming levels."""
    return F.rint(x * 100.0).cast("int")


def finite(x: Column) -> Column:
    """x, or null if it is infinite or no number."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def convert(x: Column, from_unit: str, to_unit: str) -> Column:
    if from_unit == to_unit:
        return x
    if (from_unit, to_unit) not in UNITS:
        raise ValueError(f"no conversion from {from_unit} to {to_unit}")
    return x * UNITS[from_unit, to_unit]


def piecewise_bin(x: Column, edges: list[Column]) -> Column:
    """Score 0 to len(edges) - 1: clamped outside the edges, linear between them; equal edges make a step."""
    score = F.lit(float(len(edges) - 1))
    for k in reversed(range(len(edges) - 1)):
        a, b = edges[k], edges[k + 1]
        score = F.when(x < b, F.lit(float(k)) + F.when(b > a, (x - a) / (b - a)).otherwise(0.0)).otherwise(score)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x <= edges[0], 0.0).otherwise(score)


def nearest(x: Column, axis: Column) -> Column:
    """The element of a double array nearest to x; ties go up; null stays null."""
    ranked = F.transform(axis, lambda g: F.struct(F.abs(g - x).alias("d"), (-g).alias("n")))
    return F.when(x.isNotNull(), -F.array_min(ranked)["n"])


def nearest_centi(x: Column, low: Column, high: Column) -> Column:
    """The hundredth nearest to x, as int, clamped to low..high; distances are taken in doubles and ties go up."""
    below = F.floor(x * 100.0).cast("int")
    up = F.abs((below + 1) / 100.0 - x) <= F.abs(below / 100.0 - x)
    return F.greatest(low, F.least(high, F.when(up, below + 1).otherwise(below)))
