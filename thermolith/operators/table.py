"""Regional tables: nearest lookup of pathways in cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import numeric
from . import cube, pathway

KEY = ["model", "scenario"]


def axes(knots: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row: the cube's years (their number is bounded by the calendar) and its outermost levels."""
    level = F.when(F.col("value").isNotNull(), F.col("gwl"))
    return knots.agg(F.sort_array(F.collect_set(F.col("year").cast("double"))).alias("years"), F.min(numeric.floor_to(level, config.smooth_resolution)).alias("lo"), F.max(numeric.ceil_to(level, config.smooth_resolution)).alias("hi"))


def targets(path: DataFrame, knots: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Pathway rows with the cube's nearest year (cube_year), nearest level (gwl_c) and the SSP to look up."""
    t = path.where("gwl is not null").crossJoin(F.broadcast(axes(knots, config)))
    year = numeric.nearest(F.col("year").cast("double"), F.col("years")).cast("int")
    level = numeric.nearest_centi(F.col("gwl"), numeric.centi(F.col("lo")), numeric.centi(F.col("hi")))
    return t.select(*KEY, pathway.lookup_ssp(F.col("ssp"), config).alias("ssp"), "year", year.alias("cube_year"), "gwl", level.alias("gwl_c"))


def lookup(path: DataFrame, knots: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """A row for each pathway year, indicator and region, with the interpolated impact.

    Only the levels asked for are interpolated: straight pieces meet pathway rows by SSP, year and bucket of levels."""
    t = targets(path, knots, config).withColumn("bucket", F.floor(F.col("gwl_c") / config.bucket).cast("int"))
    p = cube.bucketed(cube.pieces(knots, [*cube.SERIES, "year"], config.smooth_resolution), config.bucket).withColumnRenamed("year", "cube_year")
    met = t.join(p, ["ssp", "cube_year", "bucket"]).where("gwl_c >= lo_c and gwl_c < hi_c")
    return met.select(*KEY, "ssp", "indicator", "unit", "region", "year", "cube_year", "gwl", "gwl_c", cube.value_at().alias("value"))


def emulate(path: DataFrame, knots: DataFrame, prefix: str | None = None, keep_requested_year: bool = False, config: EngineConfig = DEFAULT, all_regions: bool = False) -> DataFrame:
    """model, scenario, region, variable, unit, year, value: impacts of every scenario.

    Requested years that fall on one year of the cube are averaged under it, or with keep_requested_year stay apart.
    With `all_regions` each series of the cube has a row for each year of each scenario, null where it has no value."""
    prefix = config.prefix if prefix is None else prefix
    rows = lookup(path, knots, config).withColumn("out_year", F.col("year" if keep_requested_year else "cube_year"))
    out = rows.groupBy(*KEY, "indicator", "unit", "region", "out_year").agg(F.avg("value").alias("value"))
    if all_regions:
        series = ["indicator", "unit", "region"]
        salts = int(path.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked = targets(path, knots, config).select(*KEY, F.col("year" if keep_requested_year else "cube_year").alias("out_year")).distinct()
        asked = asked.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(salts)).cast("int"))
        named = knots.select(*series).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        every = asked.join(named, "salt").drop("salt")
        same = [F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*KEY, *series, "out_year")]
        out = every.alias("e").join(out.alias("o"), same, "left").select(*(F.col(f"e.{c}") for c in (*KEY, *series, "out_year")), "o.value")
    return out.select(*KEY, "region", F.concat(F.lit(prefix), "indicator").alias("variable"), "unit", F.col("out_year").alias("year"), "value")


def missing_ssps(path: DataFrame, knots: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """SSPs asked for that the cube lacks."""
    return path.select(pathway.lookup_ssp(F.col("ssp"), config).alias("ssp")).distinct().join(knots.select("ssp").distinct(), "ssp", "left_anti")


def emulate_strict(path: DataFrame, knots: DataFrame, **how) -> DataFrame:
    absent = [r["ssp"] for r in missing_ssps(path, knots, how.get("config", DEFAULT)).collect()]
    if absent:
        raise KeyError(f"the cube has no {', '.join(sorted(absent))}")
    return emulate(path, knots, **how)
