"""Maps: bracketed interpolation of rasters along pathways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import numeric, text
from . import pathway

SENTINEL = 999.0
KEY = ["model", "scenario"]


def axes_of(raster: DataFrame) -> DataFrame:
    """A row for each indicator with its levels in order (their number is bounded by the method), of rows with and without a
    value."""
    return raster.groupBy("indicator").agg(F.sort_array(F.collect_set("gwl")).alias("levels"))


def targets(path: DataFrame, axes: DataFrame, years: list[int] | None = None, config: EngineConfig = DEFAULT, honour_user: bool = False) -> DataFrame:
    """Pathway rows by indicator, with the level to look up, its status (ok, above or below the bounds of the years asked for)
    and, where that is ok, the indicator's levels around it: g0 <= gwl <= g1, one level twice at a level itself."""
    ends = axes.select(F.explode(F.array(F.array_min("levels"), F.array_max("levels"))).alias("gwl"))
    limits = pathway.bounds(path, ends, config, honour_user, years).select(*KEY, "high", "low")
    t = path.where("gwl is not null").join(limits, KEY).withColumn("gwl", numeric.half_even(F.col("gwl"), 2))
    if years is not None:
        t = t.where(F.col("year").isin(list(years)))
    status = F.when(F.col("gwl") > F.col("high"), "above").when(F.col("gwl") < F.col("low"), "below").otherwise("ok")
    one = axes.agg(F.collect_list(F.struct("indicator", "levels")).alias("axes"))  # one row, an entry for each indicator
    t = t.select(*KEY, "year", "gwl", status.alias("status")).crossJoin(F.broadcast(one)).select("*", F.explode("axes").alias("a")).drop("axes")
    t = t.select(*KEY, "year", "gwl", numeric.centi(F.col("gwl")).alias("gwl_c"), "status", "a.indicator", "a.levels")
    g = F.col("gwl_c") / 100.0
    near = lambda side, test: F.when(F.col("status") == "ok", side(F.filter("levels", test)))
    t = t.withColumns({"g0": near(F.array_max, lambda x: x <= g), "g1": near(F.array_min, lambda x: x >= g)})
    return t.drop("levels")


def needed_levels(t: DataFrame) -> DataFrame:
    """The distinct levels that `targets` look at: no more than the axes have."""
    return t.where((F.col("status") == "ok") & F.col("g0").isNotNull() & F.col("g1").isNotNull()).select(F.explode(F.array("g0", "g1")).alias("gwl")).distinct()


def emulate(path: DataFrame, raster: DataFrame, years: list[int] | None = None, strict: bool = False, config: EngineConfig = DEFAULT, honour_user: bool = False, axes: DataFrame | None = None, masked: bool = True, bridge: bool = False) -> DataFrame:
    """model, scenario, indicator, lat, lon, year, gwl, value, status for every scenario, indicator and cell.

    A cell's value is linear between the two levels of its indicator's axis around the pathway's level; where the cell has no
    row or no value at either of them, it has none: nulls are never crossed.  With `bridge` the line is drawn between the
    nearest levels at which the cell has a value instead.  Out of bounds the value is null; with `masked` unset rows out of bounds
    are not made at all.  With `strict` only one scenario or one indicator may have several of the other.

    With `axes` (the levels by indicator, known from elsewhere, such as folder names) only rows of levels that a pathway needs
    are taken.  A job over the pathways finds these levels, and they become a filter on `level` (the level as text, a
    folder's name) or gwl: where the raster is partitioned by it, other files are not opened.  Cells are then those of the
    levels taken.

    Each cell becomes one row, a map from its levels to values, where it stands after one shuffle by cell.  Cells are salted, and
    the pathways, small beside the maps made of them, go to every salt of an indicator: an equality join whose pairs all are
    rows of the result."""
    if strict and path.select(*KEY).distinct().count() > 1 and raster.select("indicator").distinct().count() > 1:
        raise ValueError("several scenarios and several indicators")
    known = axes if axes is not None else axes_of(raster)
    t = targets(path, known, years, config, honour_user)
    if strict and config.resolution > 0.01:
        step = round(config.resolution * 100)
        if t.where(F.col("gwl_c") % step != 0).limit(1).count():
            raise ValueError(f"levels off the grid of {config.resolution}")
    if axes is not None:
        by = "level" if "level" in raster.columns else "gwl"
        needed = needed_levels(t).select(F.col("gwl").cast(raster.schema[by].dataType)).collect()  # no more than the axes have
        raster = raster.where(F.col(by).isin([r["gwl"] for r in needed]))
    if not masked:
        t = t.where("status = 'ok'")
    salts = int(path.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cell = ["indicator", "lat", "lon"]
    at = F.map_from_entries(F.collect_list(F.struct("gwl", "value")))  # no more entries than the axis has levels
    cells = raster.groupBy(*cell).agg(at.alias("at")).withColumn("salt", F.pmod(F.xxhash64(*cell), F.lit(salts)).cast("int"))
    g = F.col("gwl_c") / 100.0
    if bridge:
        known_at = F.map_filter("at", lambda k, v: v.isNotNull())
        met = cells.withColumn("at", known_at).join(t.drop("g0", "g1"), ["indicator", "salt"])
        near = lambda side, test: F.when(F.col("status") == "ok", side(F.filter(F.map_keys("at"), test)))
        met = met.withColumns({"g0": near(F.array_max, lambda x: x <= g), "g1": near(F.array_min, lambda x: x >= g)})
    else:
        met = cells.join(t, ["indicator", "salt"])
    v0, v1 = (F.try_element_at("at", F.col(c)) for c in ("g0", "g1"))
    line = v0 + (v1 - v0) * ((g - F.col("g0")) / (F.col("g1") - F.col("g0")))
    value = F.when(F.col("g0") == F.col("g1"), v0).when(F.col("g0").isNotNull() & F.col("g1").isNotNull(), line)
    return met.select(*KEY, *cell, "year", "gwl", value.alias("value"), "status")


def with_sentinel(maps: DataFrame) -> DataFrame:
    """999 as the value of what is out of bounds."""
    return maps.withColumn("value", F.when(F.col("status") != "ok", F.lit(SENTINEL)).otherwise(F.col("value")))


def labelled(maps: DataFrame) -> DataFrame:
    return maps.withColumn("label", text.map_label(F.col("model"), F.col("scenario")))


def to_wide(maps: DataFrame, labels: list[str]) -> DataFrame:
    """One column for each scenario label; two scenarios with one label raise when the rows are made."""
    return labelled(maps).groupBy("indicator", "lat", "lon", "year").pivot("label", labels).agg(_only("label"))


def by_indicator(maps: DataFrame, indicators: list[str]) -> DataFrame:
    """One column for each indicator."""
    return maps.groupBy(*KEY, "lat", "lon", "year").pivot("indicator", indicators).agg(_only("indicator"))


def _only(name: str) -> F.Column:
    """The value of the one row of a group."""
    several = F.raise_error(F.concat(F.lit("several rows of a cell are called "), F.first(name))).cast("double")
    return F.when(F.count(F.lit(1)) > 1, several).otherwise(F.first("value"))
