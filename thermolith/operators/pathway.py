"""Warming pathways: SSP resolution, construction, annual steps, duplicates, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import DEFAULT, EngineConfig
from ..functions import numeric, text
from . import filters

SCENARIO = ["model", "scenario"]


def resolve_ssp(meta: DataFrame, column: str = "ssp_family", default: str = DEFAULT.default_ssp) -> DataFrame:
    """`column` with SSP labels; a missing column holds the default."""
    if column not in meta.columns:
        return meta.withColumn(column, F.lit(default))
    return meta.withColumn(column, text.ssp_label(F.col(column), default))


def lookup_ssp(label: Column, config: EngineConfig = DEFAULT) -> Column:
    """The SSP to look impacts up with: unknown ones count as the default."""
    return F.when(label.isin(*config.ssps), label).otherwise(F.lit(config.default_ssp))


def make(ts: DataFrame, meta: DataFrame | None = None, variable: str | list[str] | None = None, ssp_column: str = "ssp_family", config: EngineConfig = DEFAULT, check: bool = True) -> DataFrame:
    """model, scenario, ssp, year, gwl (3 digits) of one temperature variable.

    Without `variable` the table must have only one; patterns may match only one; names without match raise.  That is
    asked of the table by a job of its own, but not of streams, and not with `check` unset."""
    if variable is not None:
        ts = filters.select(ts, variable=variable)
    if check and not ts.isStreaming:
        found = [r["variable"] for r in ts.select("variable").distinct().limit(2).collect()]
        if not found:
            raise ValueError(f"no variable {variable}")
        if len(found) > 1:
            raise ValueError(f"more than one temperature variable: {', '.join(sorted(found))}, ...; name one")
    out = ts.select(*SCENARIO, "year", numeric.half_even(F.nanvl(F.col("value"), F.lit(None)), 3).alias("gwl"))
    if meta is None:
        return out.select(*SCENARIO, F.lit(config.default_ssp).alias("ssp"), "year", "gwl")
    labels = resolve_ssp(meta, ssp_column, config.default_ssp).select(*SCENARIO, F.col(ssp_column).alias("ssp")).dropDuplicates(SCENARIO)
    joined = out.join(labels, SCENARIO, "left")
    return joined.select(*SCENARIO, F.coalesce("ssp", F.lit(config.default_ssp)).alias("ssp"), "year", "gwl")


def annual(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Each series at every year between its first and last, linear between its years."""
    w = W.partitionBy(*keys).orderBy("year")
    knots = df.where(F.col(value).isNotNull()).select(*keys, F.col("year").alias("y0"), F.col(value).alias("v0"), F.lead("year").over(w).alias("y1"), F.lead(value).over(w).alias("v1"))
    steps = F.sequence("y0", F.coalesce(F.col("y1") - 1, F.col("y0")))
    at = knots.select(*keys, "y0", "v0", "y1", "v1", F.explode(steps).alias("year"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * ((F.col("year") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    return at.select(*keys, F.col("year").cast("int").alias("year"), F.when(F.col("year") == F.col("y0"), F.col("v0")).otherwise(line).alias(value))


def duplicates(pathway: DataFrame) -> DataFrame:
    """Adds is_duplicate: a level that the pathway had in an earlier year."""
    return pathway.withColumn("is_duplicate", F.row_number().over(W.partitionBy(*SCENARIO, "gwl").orderBy("year")) > 1)


def spread_duplicates(pathway: DataFrame, seed: int = 0, width: float = 0.005) -> DataFrame:
    """Moves repeated levels by up to `width` either way: a draw from the md5 of `seed|model|scenario|year`, its first 28 bits."""
    key = F.concat_ws("|", F.lit(str(seed)), *SCENARIO, F.col("year").cast("string"))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long") / float(1 << 27) - 1.0
    return duplicates(pathway).withColumn("gwl", F.when(F.col("is_duplicate"), F.col("gwl") + width * draw).otherwise(F.col("gwl"))).drop("is_duplicate")


def _extremes(pathway: DataFrame, years: list[int] | None) -> DataFrame:
    """Each scenario's extremes and last level, to two digits, in `years` (None: all)."""
    two = numeric.half_even(F.col("gwl"), 2)
    rows = pathway.where("gwl is not null")
    if years is not None:
        rows = rows.where(F.col("year").isin(list(years)))
    return rows.groupBy(*SCENARIO).agg(F.max(two).alias("max_gwl"), F.min(two).alias("min_gwl"), F.max_by(two, "year").alias("last_gwl"))


def bounds(pathway: DataFrame, axis: DataFrame, config: EngineConfig = DEFAULT, honour_user: bool = False, years: list[int] | None = None) -> DataFrame:
    """Each scenario's extremes in `years`, the data's range and the bounds that hold: outside the data its range replaces the user's."""
    data = axis.agg(F.min("gwl").alias("data_min"), F.max("gwl").alias("data_max"))
    top, bottom = F.lit(config.temp_max), F.lit(config.temp_min)
    out = _extremes(pathway, years).crossJoin(F.broadcast(data))  # one row
    high = F.when(F.col("max_gwl") > F.col("data_max"), F.least("data_max", top) if honour_user else F.col("data_max")).otherwise(top)
    low = F.when(F.col("min_gwl") < F.col("data_min"), F.greatest("data_min", bottom) if honour_user else F.col("data_min")).otherwise(bottom)
    return out.withColumns({"high": high, "low": low})


def warnings(pathway: DataFrame, config: EngineConfig = DEFAULT, years: list[int] | None = None) -> DataFrame:
    """What to be cautious about in each scenario's `years`: a fall after the peak, to two digits, and levels outside the bounds."""
    fall = numeric.half_even(F.col("max_gwl") - F.col("last_gwl"), 2)
    return _extremes(pathway, years).withColumns({"drawdown": fall > config.drawdown_max, "too_hot": F.col("max_gwl") > config.temp_max, "too_cold": F.col("min_gwl") < config.temp_min})
