"""Between long rows and wide columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_wide(df: DataFrame, keys: list[str], years: list[int]) -> DataFrame:
    """One column for each of `years`; several rows of a cell are averaged."""
    out = df.groupBy(*keys).pivot("year", years).agg(F.avg("value"))
    return out


def to_long(df: DataFrame, keys: list[str], years: list[str] | None = None, drop_null: bool = True) -> DataFrame:
    """Columns that are years become rows."""
    years = years or [c for c in df.columns if c.isdigit()]
    out = df.unpivot(keys, years, "year", "value").withColumns({"year": F.col("year").cast("int"), "value": F.col("value").cast("double")})
    return out.where("value is not null") if drop_null else out
