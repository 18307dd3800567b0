"""Impact cubes: filling years, and interpolation along warming levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import DEFAULT, EngineConfig
from ..functions import numeric

SERIES = ["indicator", "unit", "region", "ssp"]
#: Combinations of axis values that are made from one row.
BLOCK = 10_000


def from_impacts(df: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Impact rows whose scenario is `<ssp>_<int>p<frac>` as a regional cube; other scenarios raise nothing and go."""
    from ..functions import text

    gwl = text.gwl_of(F.col("scenario"))
    out = df.select(text.remove_literal(F.col("variable"), config.percentile_suffix).alias("indicator"), "unit", "region", text.ssp_of(F.col("scenario")).alias("ssp"), gwl.alias("gwl"), numeric.centi(gwl).alias("gwl_c"), "year", "value")
    return out.where("ssp is not null and gwl is not null")


def fill_years(df: DataFrame, keys: list[str], first: int, last: int, include_end: bool = False) -> DataFrame:
    """Each series at every year from `first` to before `last`, by position between its years; the edges stay constant."""
    years = df.select(*keys).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last if include_end else last - 1))))
    both = years.join(df.select(*keys, "year", "value"), [*keys, "year"], "left")
    w = W.partitionBy(*keys).orderBy("year")
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.col("year"))
    both = both.withColumns({"y0": F.last(known, True).over(before), "v0": F.last("value", True).over(before), "y1": F.first(known, True).over(after), "v1": F.first("value", True).over(after)})
    line = F.when(F.col("y0") == F.col("y1"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * ((F.col("year") - F.col("y0")) / (F.col("y1") - F.col("y0"))))
    return both.select(*keys, "year", F.coalesce(line, "v0", "v1").alias("value"))


def pieces(knots: DataFrame, keys: list[str], smooth: float | None = None) -> DataFrame:
    """Straight pieces between neighbouring knots of each series: (lo_c, hi_c) with both ends in hundredths.

    A piece holds lo_c to hi_c - 1; the last level is a piece of its own.  `smooth` extends the first and the last level
    constantly to multiples of it outside."""
    w = W.partitionBy(*keys).orderBy("gwl")
    k = knots.where("value is not null").select(*keys, F.col("gwl").alias("g0"), F.col("value").alias("v0"), F.lead("gwl").over(w).alias("g1"), F.lead("value").over(w).alias("v1"), F.lag("gwl").over(w).isNull().alias("head"))
    inner = k.select(*keys, "g0", "v0", "g1", "v1", F.ceil(numeric.half_even(F.col("g0") * 100, 6)).cast("int").alias("lo_c"), F.coalesce(F.ceil(numeric.half_even(F.col("g1") * 100, 6)).cast("int"), F.floor(numeric.half_even(F.col("g0") * 100, 6)).cast("int") + 1).alias("hi_c"), "head")
    if smooth is None:
        return inner.drop("head").where("lo_c < hi_c")
    low = numeric.centi(numeric.floor_to(F.col("g0"), smooth))
    high = numeric.centi(numeric.ceil_to(F.col("g0"), smooth))
    flat = lambda a, b: F.struct(F.col("g0").alias("g0"), F.col("v0").alias("v0"), F.lit(None).cast("double").alias("g1"), F.lit(None).cast("double").alias("v1"), a.alias("lo_c"), b.alias("hi_c"))
    own = F.struct("g0", "v0", "g1", "v1", "lo_c", "hi_c")
    parts = F.array(own, F.when(F.col("head"), flat(low, F.col("lo_c"))), F.when(F.col("g1").isNull(), flat(F.col("hi_c"), high + 1)))
    return inner.select(*keys, F.explode(F.filter(parts, lambda x: x.isNotNull() & (x["lo_c"] < x["hi_c"]))).alias("p")).select(*keys, "p.*")


def value_at(level_c: str = "gwl_c") -> F.Column:
    """Value of a piece at a level in hundredths."""
    g = F.col(level_c) / 100.0
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * ((g - F.col("g0")) / (F.col("g1") - F.col("g0")))
    return F.when(F.col("g1").isNull() | (g == F.col("g0")), F.col("v0")).otherwise(line)


def on_grid(knots: DataFrame) -> DataFrame:
    """Only knots whose level is a whole number of hundredths."""
    return knots.where(numeric.centi(F.col("gwl")) / 100.0 == F.col("gwl"))


def gwl_grid(knots: DataFrame, keys: list[str] | None = None, config: EngineConfig = DEFAULT, strict_knots: bool = False) -> DataFrame:
    """Each series at every 0.01 degrees: linear between knots, constant outside up to multiples of 0.05.  With `strict_knots`
    knots off this grid are left out."""
    keys = keys or [*SERIES, "year"]
    knots = on_grid(knots) if strict_knots else knots
    p = pieces(knots, keys, config.smooth_resolution)
    at = p.select(*keys, "g0", "v0", "g1", "v1", F.explode(F.sequence("lo_c", F.col("hi_c") - 1)).alias("gwl_c"))
    return at.select(*keys, (F.col("gwl_c") / 100.0).alias("gwl"), "gwl_c", value_at().alias("value"))


def prepare(impacts: DataFrame, first: int, last: int, keys: list[str] | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """A cube from sparse impacts: each level's years are filled from `first` to `last` first, then each year's levels."""
    keys = keys or SERIES
    return gwl_grid(fill_years(impacts, [*keys, "gwl"], first, last, include_end=True), [*keys, "year"], config)


def dense(df: DataFrame, axes: tuple[str, ...] = ("gwl_c", "year", "ssp", "region"), by: tuple[str, ...] = ("indicator",)) -> DataFrame:
    """Each group's rows at every combination of its own axis values, null where there is none.

    Axes are bounded by their nature (levels, years, SSPs, regions); their combinations, the cube itself, are numbered: a group's
    numbers are cut into blocks that are spread over the tasks, and a number's digits, with the axes' sizes as their bases, say
    which value of each axis it has.  So tasks grow with the rows, not with the groups."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.groupBy(*by).agg(*(F.sort_array(F.collect_set(a)).alias(f"_{a}") for a in axes))
    size = F.lit(1).cast("long")
    for a in axes:
        size = size * F.size(f"_{a}")
    blocks = found.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / BLOCK)))).repartition(spread, *by, "_block")
    # where there is no value of an axis at all there is no combination
    numbered = blocks.where(size > 0).withColumn("_n", F.explode(F.sequence(F.col("_block") * BLOCK, F.least(size, (F.col("_block") + 1) * BLOCK) - 1)))
    out, rest = [], F.col("_n")
    for a in axes:
        out.append(F.get(f"_{a}", (rest % F.size(f"_{a}")).cast("int")).alias(a))
        rest = F.floor(rest / F.size(f"_{a}"))
    return numbered.select(*by, *out).join(df.select(*by, *axes, "value"), [*by, *axes], "left")


def align(a: DataFrame, b: DataFrame, on: tuple[str, ...], names: tuple[str, str]) -> DataFrame:
    """Two cubes side by side at all coordinates of either, null where one has none."""
    side = lambda df, name: df.select(*on, F.col("value").alias(name))
    return side(a, names[0]).join(side(b, names[1]), list(on), "full")


def at_years(df: DataFrame, years: list[int], strict: bool = True) -> DataFrame:
    """The rows at exactly these years; with `strict`, years that the cube lacks raise."""
    if strict:
        there = {r["year"] for r in df.where(F.col("year").isin(list(years))).select("year").distinct().collect()}  # no more than were asked for
        if absent := sorted(set(years) - there):
            raise KeyError(f"the cube has no {', '.join(map(str, absent))}")
    return df.where(F.col("year").isin(list(years)))


def bucketed(p: DataFrame, size: int) -> DataFrame:
    """Pieces once for each bucket of hundredths they touch: the equality key of range joins."""
    return p.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo_c") / size).cast("int"), F.floor((F.col("hi_c") - 1) / size).cast("int"))))
