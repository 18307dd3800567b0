"""Scenario tables: wide CSV or Excel files, and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import reshape
from . import xlsx


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*(c if c.isdigit() else c.strip().lower() for c in df.columns))


def from_wide(df: DataFrame) -> DataFrame:
    """Wide rows (a column for each year) as canonical long rows; numbers may be text."""
    df = schema.require(_lower(df), schema.IAMC, "a scenario table")
    years = [c for c in df.columns if c.isdigit()]
    if not years:
        raise ValueError("a scenario table needs columns named by years")
    typed = df.select(*schema.IAMC, *(F.nanvl(F.col(f"`{y}`").try_cast("double"), F.lit(None)).alias(y) for y in years))
    return reshape.to_long(typed, list(schema.IAMC), years)


def read(spark: SparkSession, source, sheet: str | None = None) -> DataFrame:
    """Canonical long rows of a frame (wide or long) or of files: paths, lists of paths or globs of .csv, .xlsx or .parquet."""
    if isinstance(source, DataFrame):
        low = _lower(source)
        if {"year", "value"} <= set(low.columns):
            return schema.require(low, schema.IAMC, "a scenario table").select(*schema.IAMC, F.col("year").cast("int").alias("year"), F.nanvl(F.col("value").cast("double"), F.lit(None)).alias("value"))
        return from_wide(low)
    paths = [source] if isinstance(source, str) else list(source) if isinstance(source, (list, tuple)) else None
    if not paths or not all(isinstance(p, str) for p in paths):
        raise ValueError(f"no scenario table: {source!r}")
    if all(p.endswith("csv") for p in paths):
        return from_wide(spark.read.csv(paths, header=True))
    if all(p.endswith(".xlsx") for p in paths):
        frames = [from_wide(xlsx.read(spark, p, sheet)) for p in paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    if all(p.endswith("parquet") for p in paths):
        return read(spark, spark.read.parquet(*paths))
    raise ValueError(f"no scenario table: {source!r}")


def attach_meta(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata columns joined to rows by (model, scenario)."""
    return df.join(meta.dropDuplicates(["model", "scenario"]), ["model", "scenario"], "left")


def write_wide_csv(df: DataFrame, path: str, years: list[int], keys: tuple[str, ...] = schema.IAMC) -> None:
    """CSV part files with a column for each of `years`."""
    reshape.to_wide(df, list(keys), years).write.mode("overwrite").csv(path, header=True)
