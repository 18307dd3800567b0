"""Scores of change: z-scores, quantile bins, and their sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from . import selection

QUARTILES = (0.0, 0.25, 0.5, 0.75)


def zscore(df: DataFrame, future: str = "future", hist: str = "hist", std: str = "std") -> DataFrame:
    """Adds z = (future - hist) / std, null where that is no finite number."""
    return df.withColumn("z", numeric.finite((F.col(future) - F.col(hist)) / F.nullif(F.col(std), F.lit(0.0))))


def quartiles(df: DataFrame, keys: list[str], value: str = "value", q: tuple[float, ...] = QUARTILES) -> DataFrame:
    """Exact quantiles with linear interpolation, as an array."""
    return selection.quantiles(df, keys, [value], q, "quartiles").drop("variable")


def binned(df: DataFrame, edges: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the score of `value` by its group's `quartiles`."""
    e = [F.element_at("quartiles", k + 1) for k in range(4)]
    return df.join(edges, keys, "left").withColumn(name, numeric.piecewise_bin(F.col(value), e)).drop("quartiles")


def binned_fixed(df: DataFrame, edges: list[float], value: str, name: str) -> DataFrame:
    return df.withColumn(name, numeric.piecewise_bin(F.col(value), [F.lit(float(x)) for x in edges]))


def bivariate(df: DataFrame, keys: list[str], level: str = "future", fixed: dict[str, list[float]] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Adds z_score, level_score and their sum, scored by the quartiles of each group of `keys`.

    Indicators in `fixed`, or in the table `edges` (indicator, edges: four ascending numbers), have their level scored by these
    edges instead."""
    found = selection.quantiles(df, keys, ["z", level], QUARTILES, "quartiles")
    of = lambda v: found.where(F.col("variable") == v).drop("variable")
    scored = binned(binned(df, of("z"), keys, "z", "z_score"), of(level), keys, level, "level_score")
    for indicator, four in (fixed or {}).items():
        own = numeric.piecewise_bin(F.col(level), [F.lit(float(x)) for x in four])
        scored = scored.withColumn("level_score", F.when(F.col("indicator") == indicator, own).otherwise(F.col("level_score")))
    if edges is not None:
        own = numeric.piecewise_bin(F.col(level), [F.element_at("edges", k + 1) for k in range(4)])
        scored = scored.join(edges.select("indicator", "edges"), "indicator", "left")
        scored = scored.withColumn("level_score", F.when(F.col("edges").isNotNull(), own).otherwise(F.col("level_score"))).drop("edges")
    return scored.withColumn("score", F.col("z_score") + F.col("level_score"))


def within(df: DataFrame, mask: DataFrame, on: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Cells of a mask or class raster, with its columns."""
    return df.join(mask, list(on))
