"""Cumulative emissions and warming from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import DEFAULT, EngineConfig
from ..functions import numeric
from . import filters, pathway

SERIES = ["model", "scenario", "region", "variable", "unit"]


def cumulative(ts: DataFrame, first_year: int = 2020, years: list[int] | None = None, last_year: int = 2100) -> DataFrame:
    """Sum from first_year up to and with each year of the annually interpolated series; series that begin later have none.

    For a series that is linear between its years this is the running sum of its annual values, both ends counted in full."""
    all_years = pathway.annual(ts, SERIES)
    starts = F.min("year").over(W.partitionBy(*SERIES))
    run = F.sum("value").over(W.partitionBy(*SERIES).orderBy("year").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = all_years.withColumn("_start", starts).where((F.col("_start") <= first_year) & (F.col("year") >= first_year) & (F.col("year") <= last_year))
    out = out.withColumn("value", run)
    return (out if years is None else out.where(F.col("year").isin(list(years)))).drop("_start")


def prepare(ts: DataFrame, variable: str = "Emissions|CO2", unit_in: str = "Mt CO2/yr", unit_out: str = "Gt CO2/yr", years: list[int] | None = None, first_year: int = 2020, last_year: int = 2100, keep_unit: bool = True) -> DataFrame:
    """Cumulative emissions of every series in `unit_out` (or, with keep_unit unset, without its /yr)."""
    if years is not None and len(years) < 2:
        raise ValueError("cumulative emissions need at least two years")
    sel = filters.select(ts, variable=variable, unit=unit_in).withColumns({"value": numeric.convert(F.col("value"), unit_in, unit_out), "unit": F.lit(unit_out)})
    out = cumulative(sel, first_year, years, last_year)
    name = F.concat("variable", F.lit(f"|Cumulative|from {first_year}"))
    return out.withColumns({"variable": name} | ({} if keep_unit else {"unit": F.lit(unit_out.replace("/yr", ""))}))


def regression(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, r and r2 of the least-squares line."""
    both = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.corr(F.col(x), F.col(y))
    return both.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), r.alias("r"), (r * r).alias("r2"))


def to_gwl(cum: DataFrame, regr: dict | DataFrame | str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Adds gwl: slope * cumulative Gt CO2 + intercept.

    `regr`: None or "AR6" for the default line, a dict with slope and intercept, or a frame whose first two columns give it."""
    if regr is None or isinstance(regr, str) and regr == "AR6":
        regr = {"slope": config.tcre_slope, "intercept": config.tcre_intercept}
    if isinstance(regr, DataFrame):
        line = regression(regr, *regr.columns[:2]).select("slope", "intercept")
        return cum.crossJoin(F.broadcast(line)).withColumn("gwl", F.col("slope") * F.col("value") + F.col("intercept")).drop("slope", "intercept")
    if not isinstance(regr, dict):
        raise ValueError(f"no regression: {regr!r}")
    return cum.withColumn("gwl", F.lit(float(regr["slope"])) * F.col("value") + F.lit(float(regr["intercept"])))


def as_temperature(gwl: DataFrame, variable: str = "Emulated|GSAT_tcre", unit: str = "°C") -> DataFrame:
    return gwl.withColumns({"value": F.col("gwl"), "variable": F.lit(variable), "unit": F.lit(unit)}).drop("gwl")
