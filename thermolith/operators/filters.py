"""Row filters on long scenario tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text


def _condition(df: DataFrame, column: str, wanted) -> Column:
    several = list(wanted) if isinstance(wanted, (list, tuple, set, range)) else [wanted]
    if all(isinstance(x, str) for x in several):
        return text.any_match(F.col(column), several)
    return F.col(column).isin(several)


def select(df: DataFrame, keep: bool = True, **wanted) -> DataFrame:
    """Rows that match all conditions (a list: any of it; * in strings is a wildcard), or with keep=False the others."""
    test = reduce(lambda a, b: a & b, (_condition(df, c, w) for c, w in wanted.items()), F.lit(True))
    return df.where(test if keep else ~F.coalesce(test, F.lit(False)))


def select_by_meta(df: DataFrame, meta: DataFrame, **wanted) -> DataFrame:
    """Rows of the (model, scenario) whose metadata match."""
    return df.join(select(meta, **wanted).select("model", "scenario").distinct(), ["model", "scenario"], "left_semi")


def containing(df: DataFrame, column: str, parts: list[str], keep: bool = True) -> DataFrame:
    test = text.contains_any(F.col(column), parts)
    return df.where(test if keep else ~test)


def with_suffix(df: DataFrame, suffixes: list[str]) -> DataFrame:
    """Variables that are a stem of the table followed by one of the suffixes."""
    rest = F.substring(F.col("variable"), F.length(text.stem(F.col("variable"))) + F.lit(1), F.length("variable"))
    return df.where(rest.isin(suffixes))


def of_stem(df: DataFrame, stem: str) -> DataFrame:
    """Variables of exactly this stem: `heat` does not take in `heatwave|...`."""
    return df.where(text.stem(F.col("variable")) == stem)


def nth(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows at the n-th (from 0) value of an axis in order; negative n count from the last."""
    order = F.col(column).asc() if n >= 0 else F.col(column).desc()
    several = df.select(column).distinct().orderBy(order).limit(n + 1 if n >= 0 else -n)
    last = several.agg(F.count(F.lit(1)).alias("_n"), (F.max(column) if n >= 0 else F.min(column)).alias("_value"))
    enough = last.where(F.col("_n") == (n + 1 if n >= 0 else -n)).select("_value")
    return df.join(F.broadcast(enough), F.col(column) == F.col("_value"), "left_semi")  # one row


def windowed(df: DataFrame, windows: dict[str, tuple[float, float]]) -> DataFrame:
    """Null for values that are no finite number, or not strictly inside the window of their indicator, if it has one."""
    value = numeric.finite(F.col("value"))
    for indicator, (low, high) in windows.items():
        value = F.when((F.col("indicator") == indicator) & ~F.coalesce((F.col("value") > low) & (F.col("value") < high), F.lit(False)), F.lit(None)).otherwise(value)
    return df.withColumn("value", value)


def first_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the first n values of a column in order."""
    return df.join(df.select(column).distinct().orderBy(column).limit(n), column, "left_semi")


def drop_empty(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna("all", subset=columns)


def append(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("model", "scenario", "region", "variable", "unit", "year")) -> DataFrame:
    """Rows of both; raises if a key is in both."""
    both = a.select(*keys).join(b.select(*keys), list(keys), "left_semi").limit(1).collect()
    if both:
        raise ValueError(f"both tables have {both[0].asDict()}")
    return a.unionByName(b)
