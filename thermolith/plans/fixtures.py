"""Canonical tables made from the driver's star schema.

Averages are decimal sums divided as doubles, so they don't depend on the order of rows.  The cube, the raster and the
paths stand for tables that are loaded once: they are small, and kept, as an operator reads its input more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_even

VARIABLE = "Surface Temperature"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mean(x: str) -> Column:
    return F.sum(F.col(x).cast("decimal(18,2)")).cast("double") / F.count(F.col(x))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One temperature path for each market segment and order priority, a year for each month of orders."""
    year = (F.lit(2020) + (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("int")
    g = _orders(spark, sf_dir).groupBy(F.col("c_mktsegment").alias("model"), F.col("o_orderpriority").alias("scenario"), year.alias("year")).agg(mean("o_totalprice").alias("m"))
    return g.select("model", "scenario", F.lit("World").alias("region"), F.lit(VARIABLE).alias("variable"), F.lit("°C").alias("unit"), "year", half_even(1.1 + F.col("m") / 500000 * 2.4, 3).alias("value")).persist()


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _orders(spark, sf_dir).select(F.col("c_mktsegment").alias("model"), F.col("o_orderpriority").alias("scenario")).distinct()
    first = F.substring("scenario", 1, 1)
    family = F.when(first == "1", "1.0").when(first == "2", "SSP2").when(first == "4", "").when(first == "5", "6.0")
    return pairs.select("model", "scenario", family.alias("ssp_family"), F.concat(F.lit("C"), (1 + F.length("model") % 8).cast("string")).alias("category"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    places = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(places.select("c_custkey", F.col("r_name").alias("region")), F.col("o_custkey") == F.col("c_custkey"))


def _gwl() -> tuple[Column, Column]:
    return 1.0 + 0.5 * (F.col("l_linenumber") - 1), (100 + 50 * (F.col("l_linenumber") - 1)).cast("int")


def _melted(grouped: DataFrame, keys: list[str]) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(n).alias("indicator"), F.lit(u).alias("unit"), F.col(n).alias("value")) for n, u in (("price", "USD"), ("quantity", "items"), ("discount", "%"))))
    return grouped.select(*keys, F.explode(kinds).alias("k")).select("k.indicator", "k.unit", *keys, "k.value")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three indicators by region, SSP, warming level and decade."""
    gwl, gwl_c = _gwl()
    keys = {"region": F.col("region"), "ssp": F.concat(F.lit("SSP"), (1 + F.col("o_custkey") % 5).cast("string")), "gwl": gwl, "gwl_c": gwl_c, "year": (2020 + 10 * (F.year("o_orderdate") - 1995)).cast("int")}
    g = _facts(spark, sf_dir).groupBy(*(c.alias(n) for n, c in keys.items())).agg(mean("l_extendedprice").alias("price"), mean("l_quantity").alias("quantity"), mean("l_discount").alias("discount"))
    return _melted(g, list(keys)).persist()


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three indicators on a grid of 18 x 36 cells by warming level."""
    gwl, gwl_c = _gwl()
    keys = {"lat": (-85.0 + 10 * (F.col("l_partkey") % 18)).cast("double"), "lon": (-175.0 + 10 * (F.col("l_suppkey") % 36)).cast("double"), "gwl": gwl, "gwl_c": gwl_c}
    g = read(spark, sf_dir, "lineitem").groupBy(*(c.alias(n) for n, c in keys.items())).agg(mean("l_extendedprice").alias("price"), mean("l_quantity").alias("quantity"), mean("l_tax").alias("discount"))
    return _melted(g, list(keys)).drop("unit").persist()


def co2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions every fifth year, falling below zero."""
    half = (F.year("o_orderdate") - 1995) * 2 + F.floor((F.month("o_orderdate") - 1) / 6)
    g = _orders(spark, sf_dir).groupBy(F.col("c_mktsegment").alias("model"), F.col("o_orderpriority").alias("scenario"), (2020 + 5 * half).cast("int").alias("year")).agg(mean("o_totalprice").alias("m"))
    return g.select("model", "scenario", F.lit("World").alias("region"), F.lit("Emissions|CO2").alias("variable"), F.lit("Mt CO2/yr").alias("unit"), "year", (F.col("m") / 10 - 20000).alias("value"))


def impact_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as impact rows: `ssp1_1p5`, and suffixed variables."""
    c = cube(spark, sf_dir)
    level = F.replace(F.format_number("gwl", 1), F.lit("."), F.lit("p"))
    return c.select(F.lit("Climate Solutions").alias("model"), F.concat_ws("_", F.lower("ssp"), level).alias("scenario"), "region", F.concat("indicator", F.when(F.col("indicator") == "price", "|Exposure|50.0th Percentile").when(F.col("indicator") == "quantity", "|Hazard|50.0th Percentile").otherwise("_ssp2|Hazard|95.0th Percentile")).alias("variable"), "unit", "year", "value")


def score_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per indicator and cell: hist (1.0 degrees), future (3.0), std, and a class 1 to 5 of the cell."""
    at = lambda c: F.max(F.when(F.col("gwl_c") == c, F.col("value")))
    g = raster(spark, sf_dir).groupBy("indicator", "lat", "lon").agg(at(100).alias("hist"), at(300).alias("future"), at(200).alias("mid"))
    std = F.abs(F.col("mid") - F.col("hist"))
    return g.select("indicator", "lat", "lon", "hist", "future", std.alias("std"), (1 + F.pmod((F.col("lat") + F.col("lon")).cast("int") / 10, F.lit(5))).cast("int").alias("class"))
