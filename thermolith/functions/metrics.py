"""Counts and extremes of a frame's values, observed while an action makes its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str = "rows", value: str = "value") -> tuple[DataFrame, Observation]:
    """The frame, and what an action on it will have seen: rows, rows with a value, the least and the greatest value."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high")), seen


def of(df: DataFrame, value: str = "value") -> DataFrame:
    """One row of these metrics, after a run that makes all rows and keeps none."""
    watched, seen = observed(df, value=value)
    watched.write.format("noop").mode("overwrite").save()
    got = seen.get
    return df.sparkSession.createDataFrame([(got["n_rows"], got["n_values"], got["low"], got["high"])], "n_rows long, n_values long, low double, high double")
