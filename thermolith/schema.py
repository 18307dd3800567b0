"""Canonical long schemas and checks of frames against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IAMC = ("model", "scenario", "region", "variable", "unit")
SCENARIO_TS = "model string, scenario string, region string, variable string, unit string, year int, value double"
SCENARIO_META = "model string, scenario string, ssp_family string, category string"
GMT_PATHWAY = "model string, scenario string, ssp string, year int, gwl double"
REGION_IMPACTS = "indicator string, unit string, region string, ssp string, gwl double, gwl_c int, year int, value double"
RASTER_IMPACTS = "indicator string, lat double, lon double, gwl double, gwl_c int, value double"

#: Other names of axes, lower case.
AXIS_NAMES = {"gmt": "gwl", "threshold": "gwl", "x": "lon", "y": "lat"}


def normalise_names(df: DataFrame, swap_xy: bool = False) -> DataFrame:
    """Lower-case column names, and one name for each axis; `swap_xy` reads x as latitude."""
    names = AXIS_NAMES | ({"x": "lat", "y": "lon"} if swap_xy else {})
    return df.toDF(*(names.get(c.lower(), c.lower()) for c in df.columns))


def require(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def axis_report(df: DataFrame) -> DataFrame:
    """One row for each indicator: number of warming levels, the least and greatest, and whether they are valid.

    Valid axes have more than one level, all above 0.5."""
    seen = df.groupBy("indicator").agg(F.count_distinct("gwl").cast("long").alias("n_gwl"), F.min("gwl").alias("min_gwl"), F.max("gwl").alias("max_gwl"))
    return seen.withColumn("valid", (F.col("n_gwl") > 1) & (F.col("min_gwl") > 0.5))


def _numeric(df: DataFrame, columns: tuple[str, ...], what: str) -> None:
    kinds = dict(df.dtypes)
    wrong = [c for c in columns if kinds[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not kinds[c].startswith("decimal")]
    if wrong:
        raise ValueError(f"{what}: {', '.join(wrong)} must be numeric")


def check_axes(df: DataFrame) -> None:
    bad = axis_report(df).where(~F.col("valid")).limit(1).collect()
    if bad:
        raise ValueError(f"indicator {bad[0]['indicator']} needs more than one warming level, all above 0.5: {bad[0].asDict()}")


def region_impacts(df: DataFrame, check: bool = True) -> DataFrame:
    """A regional cube in its canonical schema."""
    df = require(normalise_names(df), ("indicator", "region", "ssp", "gwl", "year", "value"), "a regional cube")
    _numeric(df, ("gwl", "year", "value"), "a regional cube")
    unit = F.col("unit") if "unit" in df.columns else F.lit(None).cast("string")
    out = df.select("indicator", unit.alias("unit"), "region", F.upper("ssp").alias("ssp"), F.col("gwl").cast("double").alias("gwl"), F.rint(F.col("gwl") * 100).cast("int").alias("gwl_c"), F.col("year").cast("int").alias("year"), F.nanvl(F.col("value").cast("double"), F.lit(None)).alias("value"))
    if check:
        check_axes(out)
    return out


def raster_impacts(df: DataFrame, indicator: str | None = None, check: bool = True, swap_xy: bool = False) -> DataFrame:
    """A raster in its canonical schema; `indicator` names a raster of one variable."""
    df = normalise_names(df, swap_xy)
    if indicator is not None:
        df = df.withColumn("indicator", F.lit(indicator))
    df = require(df, ("indicator", "lat", "lon", "gwl", "value"), "a raster")
    _numeric(df, ("lat", "lon", "gwl", "value"), "a raster")
    out = df.select("indicator", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("gwl").cast("double").alias("gwl"), F.rint(F.col("gwl") * 100).cast("int").alias("gwl_c"), F.nanvl(F.col("value").cast("double"), F.lit(None)).alias("value"))
    if check:
        check_axes(out)
    return out


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
