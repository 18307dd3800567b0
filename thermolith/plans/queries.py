"""The engine's queries over the fixtures, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT
from ..functions import metrics, numeric, text
from ..operators import carbon, cube, dashboard, emulators, filters, maps, nearest, pathway, reshape, scores, table
from ..sources import cubes, iamc, netcdf, params, scratch
from ..streaming import caution
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
YEARS = list(range(2020, 2100))
DECADES = list(range(2020, 2101, 10))
INDICATORS = ["discount", "price", "quantity"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ID = ["model", "scenario", "region", "variable", "unit"]
SUFFIXES = ["|Exposure|50.0th Percentile", "|Hazard|50.0th Percentile", "|Hazard|5.0th Percentile", "|Hazard|95.0th Percentile", "|Exposure|5.0th Percentile", "|Exposure|95.0th Percentile"]
_registered: dict[str, Query] = {}


def query(f: Query) -> Query:
    _registered[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_registered)


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; sums of doubles differ in their last bits.  Ties, common here as inputs are short decimals,
    would be decided by these bits, so the edge between two results is moved off them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**digits) + 0.500123) / float(10**digits)


def path(s: SparkSession, d: str) -> DataFrame:
    return pathway.make(fx.scenarios(s, d), fx.meta(s, d), fx.VARIABLE)


@query
def iamc_long_to_wide(s, d):
    return reshape.to_wide(fx.scenarios(s, d), ID, YEARS)


@query
def iamc_wide_to_long(s, d):
    return reshape.to_long(reshape.to_wide(fx.scenarios(s, d), ID, YEARS), ID)


@query
def filter_wildcard_variable(s, d):
    return filters.select(fx.impact_input(s, d), variable="*|50.0th Percentile").withColumn("value", r("value"))


@query
def filter_meta_category(s, d):
    return filters.select_by_meta(fx.scenarios(s, d), fx.meta(s, d), category=["C1", "C2"])


@query
def filter_years(s, d):
    return filters.select(fx.scenarios(s, d), year=[2030, 2050])


@query
def filter_complement(s, d):
    return filters.select(fx.scenarios(s, d), keep=False, scenario="1-*")


@query
def filter_substring_any(s, d):
    return filters.containing(fx.impact_input(s, d), "variable", ["quant", "disc"]).withColumn("value", r("value"))


@query
def filter_substring_none(s, d):
    return filters.containing(fx.impact_input(s, d), "variable", ["95.0th"], keep=False).withColumn("value", r("value"))


@query
def filter_suffix_whitelist(s, d):
    return filters.with_suffix(fx.impact_input(s, d), SUFFIXES).withColumn("value", r("value"))


@query
def first_n_indicators(s, d):
    return filters.first_n(fx.cube(s, d), "indicator", 2).withColumn("value", r("value"))


@query
def strip_ssp_suffix(s, d):
    return fx.impact_input(s, d).select("variable", text.strip_ssp(F.col("variable")).alias("stripped")).distinct()


@query
def stem_of_variable(s, d):
    return fx.impact_input(s, d).select("variable", text.stem(F.col("variable")).alias("stem")).distinct()


@query
def parse_ssp_gwl(s, d):
    return fx.impact_input(s, d).select("scenario", text.ssp_of(F.col("scenario")).alias("ssp"), text.gwl_of(F.col("scenario")).alias("gwl")).distinct()


@query
def remove_percentile_suffix(s, d):
    return fx.impact_input(s, d).select("variable", text.remove_literal(F.col("variable"), "|50.0th Percentile").alias("short")).distinct()


@query
def impact_cube_from_input(s, d):
    return cube.from_impacts(fx.impact_input(s, d)).withColumn("value", r("value"))


@query
def stem_cube(s, d):
    """The cube of one stem, by the exact stem."""
    rows = fx.impact_input(s, d)
    other = rows.withColumn("variable", F.concat(F.lit("pricey"), F.substring("variable", 6, 100))).where("variable like 'pricey%'")
    return cube.from_impacts(filters.of_stem(rows.unionByName(other), "price")).withColumn("value", r("value"))


@query
def drop_empty_rows(s, d):
    """Wide rows with no value in any of the years before 2060 go; one model has later years only."""
    wide = reshape.to_wide(fx.scenarios(s, d).where("model != 'BUILDING' or year >= 2060"), ID, YEARS)
    return filters.drop_empty(wide, [str(y) for y in YEARS if y < 2060])


@query
def outlier_windows(s, d):
    return filters.windowed(fx.cube(s, d), {"price": (30000.0, 40000.0), "discount": (-0.05, 0.05)}).withColumn("value", r("value"))


@query
def select_by_position(s, d):
    """The second warming level and the last but one year."""
    return filters.nth(filters.nth(fx.cube(s, d), "gwl_c", 1), "year", -2).withColumn("value", r("value"))


@query
def exact_year_select(s, d):
    return cube.at_years(fx.cube(s, d), [2030, 2050]).withColumn("value", r("value"))


@query
def dense_cube(s, d):
    """A sparse cube at every combination of its axes."""
    return cube.dense(fx.cube(s, d).where("region != 'ASIA' or year < 2050")).withColumn("value", r("value"))


@query
def aligned_cubes(s, d):
    """Two cubes of all indicators side by side, with different holes."""
    c = fx.cube(s, d)
    sides = c.where("region != 'ASIA' or year >= 2030"), c.where("ssp != 'SSP3' or year < 2060")
    return cube.align(*sides, ("indicator", "region", "ssp", "gwl_c", "year"), ("one", "other")).withColumns({n: r(n) for n in ("one", "other")})


@query
def pathway_ssp_resolved(s, d):
    return pathway.resolve_ssp(fx.meta(s, d))


@query
def pathway_meta_join(s, d):
    return path(s, d)


@query
def append_scenarios(s, d):
    ts = fx.scenarios(s, d)
    return filters.append(filters.select(ts, scenario="1-*"), filters.select(ts, keep=False, scenario="1-*"))


@query
def distinct_axes(s, d):
    return fx.cube(s, d).select("indicator", "region", "ssp", "gwl", "year").agg(*(F.count_distinct(c).cast("long").alias(f"n_{c}") for c in ("indicator", "region", "ssp", "gwl", "year")))


@query
def dedup_meta(s, d):
    m = fx.meta(s, d)
    return m.unionByName(m).dropDuplicates(["model", "scenario"])


@query
def annual_interpolation(s, d):
    return pathway.annual(fx.co2(s, d), ID).withColumn("value", r("value"))


@query
def year_fill_both_edges(s, d):
    """The years 2030 to 2060 filled, and carried on to both sides."""
    c = fx.cube(s, d).where("year between 2030 and 2060")
    return cube.fill_years(c, ["indicator", "unit", "region", "ssp", "gwl_c"], 2020, 2071).withColumn("value", r("value"))


@query
def gwl_grid_interpolation(s, d):
    return cube.gwl_grid(fx.cube(s, d)).withColumn("value", r("value"))


@query
def gwl_grid_strict_knots(s, d):
    """The grid without knots off its hundredths, which one level of each cube has."""
    c = fx.cube(s, d).withColumn("gwl", F.when(F.col("gwl") == 2.0, F.lit(2.003)).otherwise(F.col("gwl")))
    return cube.gwl_grid(c, strict_knots=True).withColumn("value", r("value"))


@query
def nearest_irregular_level(s, d):
    """Each pathway row's nearest level of its SSP on an axis of any spacing."""
    levels = fx.cube(s, d).select("ssp", (F.col("gwl") * F.col("gwl") / 2.0).alias("level")).where("ssp != 'SSP1'")
    return nearest.nearest(path(s, d), levels, ("gwl", "level"), ("ssp",))


@query
def user_emulator(s, d):
    """An emulator of a user's own, here one that flags levels seen before in its scenario."""

    def seen_before(rows):
        seen = set()
        for x in rows:
            yield x | {"is_duplicate": x["gwl"] in seen}
            seen.add(x["gwl"])

    emulators.register(s, "seen_before", seen_before, "model string, scenario string, ssp string, year int, gwl double, is_duplicate boolean")
    return emulators.run(path(s, d), "seen_before")


@query
def streamed_caution_checks(s, d):
    """Caution checks of pathways that arrive in files of mixed years, in two runs of one stream."""
    to = scratch.folder(s, "stream")
    half = F.xxhash64("year", "scenario") % 2 == 0
    path(s, d).where(half).repartition(6, F.xxhash64("model", "year")).write.parquet(f"{to}/in")
    arriving = s.readStream.schema(schema.GMT_PATHWAY).option("maxFilesPerTrigger", 2).parquet(f"{to}/in")
    found = caution.checks(arriving, years=list(DEFAULT.years))
    caution.keep(found, f"{to}/out", f"{to}/state").awaitTermination()
    path(s, d).where(~half).repartition(6, F.xxhash64("model", "year")).write.mode("append").parquet(f"{to}/in")
    caution.keep(found, f"{to}/out", f"{to}/state").awaitTermination()
    return caution.latest(s, f"{to}/out")


@query
def dashboard_zoom(s, d):
    """Means over squares of 10, 30 and 90 degrees."""
    return dashboard.zoom(_maps(s, d), (10.0, 30.0, 90.0)).withColumn("value", r("value"))


@query
def prepared_cube(s, d):
    """Years, then levels filled; means over the years, so that the rows are few."""
    out = cube.prepare(fx.cube(s, d), 2020, 2080)
    return out.groupBy("indicator", "unit", "region", "ssp", "gwl_c").agg(r(F.avg("value")).alias("mean_value"), F.count(F.lit(1)).alias("n"))


@query
def cube_round_trip(s, d):
    """A cube written in a folder for each indicator and read back."""
    to = scratch.folder(s, "cube")
    cubes.write(fx.cube(s, d), to)
    return cubes.region_cube(s, to, check=False).withColumn("value", r("value"))


@query
def netcdf_round_trip(s, d):
    """A raster written as a netCDF file for each indicator and level, and what the files say of two levels."""
    to = scratch.folder(s, "netcdf")
    netcdf.write(fx.raster(s, d), to)
    back = cubes.raster_cube(s, to, check=False, reader=netcdf.read)
    return back.where("value is not null and gwl >= 2.0").withColumn("value", r("value"))


@query
def iamc_csv_round_trip(s, d):
    to = scratch.folder(s, "iamc")
    iamc.write_wide_csv(fx.scenarios(s, d), to, YEARS)
    return iamc.read(s, f"{to}/*.csv")


@query
def nearest_gwl_lookup(s, d):
    return table.targets(path(s, d), fx.cube(s, d))


@query
def nearest_year_collapse_mean(s, d):
    out = table.emulate(path(s, d), fx.cube(s, d))
    return out.groupBy("region", "variable", "year").agg(r(F.avg("value")).alias("mean_value"), F.count(F.lit(1)).alias("n"))


@query
def table_emulation(s, d):
    """The flagship: impacts of every scenario, region and indicator."""
    return table.emulate(path(s, d), fx.cube(s, d)).withColumn("value", r("value"))


@query
def table_emulation_requested_years(s, d):
    return table.emulate(path(s, d).where(F.col("year").isin(DECADES)), fx.cube(s, d), keep_requested_year=True).withColumn("value", r("value"))


@query
def table_emulation_wide(s, d):
    out = table.emulate(path(s, d), fx.cube(s, d)).withColumn("value", r("value"))
    return reshape.to_wide(out, ID, list(range(2020, 2081, 10)))


@query
def table_emulation_all_regions(s, d):
    """A region without impacts for an SSP keeps its rows, with nulls."""
    return table.emulate(path(s, d), fx.cube(s, d).where("region != 'ASIA' or ssp != 'SSP2'"), all_regions=True).withColumn("value", r("value"))


@query
def table_emulation_metrics(s, d):
    """What one run of the emulation says of its rows, gathered while they are made."""
    seen = metrics.of(table.emulate(path(s, d), fx.cube(s, d)))
    return seen.withColumns({"low": r("low"), "high": r("high")})


@query
def table_emulation_from_co2(s, d):
    """Emissions to cumulative CO2, to warming, to regional impacts."""
    warming = carbon.as_temperature(carbon.to_gwl(carbon.prepare(fx.co2(s, d), years=DECADES)))
    p = pathway.make(warming, fx.meta(s, d), "Emulated|GSAT_tcre")
    return table.emulate(p, fx.cube(s, d), prefix="Climate impacts|").withColumn("value", r("value"))


@query
def missing_ssps(s, d):
    return table.missing_ssps(path(s, d), fx.cube(s, d).where("ssp != 'SSP1'"))


def _maps(s, d):
    return maps.emulate(path(s, d), fx.raster(s, d), DECADES)


@query
def map_emulation_multi_scenario(s, d):
    """Every scenario and indicator, a row for each cell and year."""
    return _maps(s, d).withColumn("value", r("value"))


def _with_gaps(s, d):
    """The raster without rows of one level on half its cells, and with null values at another on a third."""
    g = fx.raster(s, d)
    return g.where("not (gwl = 2.5 and lat > 0)").withColumn("value", F.when(~((F.col("gwl") == 1.5) & (F.col("lon") % 3 == 0)), F.col("value")))


@query
def map_emulation_null_levels(s, d):
    """Levels that a cell lacks, as a row or as a value, are not crossed."""
    return maps.emulate(path(s, d), _with_gaps(s, d), DECADES).withColumn("value", r("value"))


@query
def map_emulation_bridged_levels(s, d):
    """Levels that a cell lacks are crossed from one that it has to the next."""
    return maps.emulate(path(s, d), _with_gaps(s, d), DECADES, bridge=True).withColumn("value", r("value"))


@query
def map_emulation_by_level(s, d):
    """From a raster in a folder for each level, of which only those that a pathway needs are read."""
    to = scratch.folder(s, "levels")
    cubes.write_levels(fx.raster(s, d), to)
    raster, axes = cubes.read_levels(s, to)
    return maps.emulate(path(s, d), raster, DECADES, axes=axes, masked=False).withColumn("value", r("value"))


@query
def map_emulation_multi_indicator(s, d):
    """A column for each indicator."""
    out = maps.by_indicator(_maps(s, d), INDICATORS)
    return out.withColumns({i: r(i) for i in INDICATORS})


@query
def map_scenario_columns(s, d):
    """A column for each scenario."""
    labels = [f"{m}_{p}" for m in SEGMENTS for p in PRIORITIES]
    out = maps.to_wide(_maps(s, d), labels)
    return out.withColumns({x: r(F.col(f"`{x}`")) for x in labels})


@query
def map_range_mask_999(s, d):
    return maps.with_sentinel(_maps(s, d)).groupBy("model", "scenario", "indicator", "year", "status").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("valued"), r(F.min("value")).alias("low"), r(F.max("value")).alias("high"))


@query
def pathway_caution_checks(s, d):
    return pathway.warnings(path(s, d), years=list(DEFAULT.years))


@query
def effective_bounds(s, d):
    return pathway.bounds(path(s, d), fx.raster(s, d), years=list(DEFAULT.years))


@query
def pathway_extremes(s, d):
    return path(s, d).groupBy("model", "scenario").agg(F.min("gwl").alias("low"), F.max("gwl").alias("high"), F.max_by("gwl", "year").alias("last"))


@query
def unit_conversion(s, d):
    return fx.co2(s, d).select("model", "scenario", "year", r(numeric.convert(F.col("value"), "Mt CO2/yr", "Gt CO2/yr")).alias("gt"))


@query
def cumulative_co2(s, d):
    return carbon.prepare(fx.co2(s, d), years=DECADES).withColumn("value", r("value"))


@query
def co2_to_gwl_default(s, d):
    return carbon.to_gwl(carbon.prepare(fx.co2(s, d))).select("model", "scenario", "year", r("value").alias("cumulative"), r("gwl").alias("gwl"))


@query
def co2_to_gwl_as_temperature(s, d):
    return carbon.as_temperature(carbon.to_gwl(carbon.prepare(fx.co2(s, d), years=DECADES))).withColumn("value", r("value"))


def _points(s, d):
    c = carbon.prepare(fx.co2(s, d)).select("model", "scenario", "year", F.col("value").alias("cum"))
    return c.join(path(s, d), ["model", "scenario", "year"]).select("cum", "gwl")


@query
def tcre_regression(s, d):
    return carbon.regression(_points(s, d), "cum", "gwl").select(*(r(c, 9).alias(c) for c in ("slope", "intercept", "r", "r2")))


@query
def co2_to_gwl_regression(s, d):
    return carbon.to_gwl(carbon.prepare(fx.co2(s, d), years=DECADES), _points(s, d)).select("model", "scenario", "year", r("gwl").alias("gwl"))


@query
def duplicate_temps_flag(s, d):
    return pathway.duplicates(path(s, d))


@query
def duplicate_temps_spread(s, d):
    return pathway.spread_duplicates(path(s, d), seed=1)


@query
def map_year_interpolation(s, d):
    return dashboard.at_year(_maps(s, d), 2035, ["model", "scenario", "indicator", "lat", "lon"]).withColumn("value", r("value"))


@query
def colour_limits(s, d):
    return dashboard.colour_limits(maps.with_sentinel(_maps(s, d)), ["indicator"])


@query
def dashboard_frame(s, d):
    return dashboard.frame(_maps(s, d), 2040, ["price", "quantity"]).withColumn("value", r("value"))


@query
def zscore_change(s, d):
    return scores.zscore(fx.score_cells(s, d)).select("indicator", "lat", "lon", r("z").alias("z"))


@query
def score_bin(s, d):
    return scores.binned_fixed(fx.score_cells(s, d), [10.0, 20.0, 25.0, 30.0], "future", "score").select("indicator", "lat", "lon", r("future").alias("future"), r("score").alias("score"))


@query
def quartiles(s, d):
    q = scores.quartiles(fx.score_cells(s, d), ["indicator", "class"], "future")
    return q.select("indicator", "class", *(r(F.element_at("quartiles", k + 1)).alias(f"q{k}") for k in range(4)))


def _scored(s, d, keys):
    out = scores.bivariate(scores.zscore(fx.score_cells(s, d)), keys, fixed={"discount": [0.01, 0.02, 0.03, 0.04]})
    return out.select("indicator", "lat", "lon", r("z_score", 4).alias("z_score"), r("level_score", 4).alias("level_score"), r("score", 4).alias("score"))


@query
def bivariate_score(s, d):
    return _scored(s, d, ["indicator"])


@query
def class_bivariate_score(s, d):
    return _scored(s, d, ["indicator", "class"])


@query
def mask_join(s, d):
    mask = fx.score_cells(s, d).where("class <= 2").select("lat", "lon", "class").distinct()
    return scores.within(fx.raster(s, d), mask).withColumn("value", r("value"))


@query
def raster_union(s, d):
    g = fx.raster(s, d)
    one, two, three = (schema.raster_impacts(g.where(F.col("indicator") == i).drop("indicator").withColumnRenamed("gwl", "Threshold"), i) for i in INDICATORS)
    return one.unionByName(two).unionByName(three).withColumn("value", r("value"))


@query
def envelope_by_category(s, d):
    return dashboard.envelope(fx.scenarios(s, d).join(fx.meta(s, d), ["model", "scenario"]), "category")


@query
def scenario_labels(s, d):
    return fx.meta(s, d).select("model", "scenario", text.map_label(F.concat("model", F.lit(" 1.1/x,y")), F.col("scenario")).alias("label"))


@query
def axis_validation(s, d):
    return schema.axis_report(fx.cube(s, d))


@query
def duplicate_key_check(s, d):
    c = fx.cube(s, d).select("indicator", "region", "ssp", "gwl_c", "year")
    return schema.duplicate_keys(c.unionByName(c.where("year = 2030")), ("indicator", "region", "ssp", "gwl_c", "year"))


@query
def half_even_rounding(s, d):
    return fx.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.half_even(F.col("l_extendedprice") / 1000, 2).alias("rounded"))


@query
def indicator_params_table(s, d):
    """Each indicator of the cube with its parameters, and how many of its values lie outside the range these give."""
    p = params.frame(s, params.load(params.EXAMPLE)).withColumn("score_range", F.array_join(F.col("score_range").cast("array<string>"), " "))
    c = fx.cube(s, d).drop("unit").join(p, F.col("indicator") == F.col("var_name"))
    outside = F.count_if((F.col("value") < F.col("ind_min")) | (F.col("value") > F.col("ind_max")))
    return c.groupBy(*p.columns).agg(F.count("value").alias("n_values"), outside.alias("n_outside"))


@query
def score_by_params(s, d):
    """Scores whose level edges are those of the parameter table, for the indicators that have any there."""
    edges = params.score_edges(params.frame(s, params.load(params.EXAMPLE)))
    out = scores.bivariate(scores.zscore(fx.score_cells(s, d)), ["indicator", "class"], edges=edges)
    return out.select("indicator", "lat", "lon", r("z_score", 4).alias("z_score"), r("level_score", 4).alias("level_score"), r("score", 4).alias("score"))


@query
def cube_from_many_files(s, d):
    """A cube from a file for each SSP, which only the files' names tell, in one scan with a hook."""
    to = scratch.folder(s, "files")
    fx.cube(s, d).withColumn("of", F.col("ssp")).drop("ssp", "gwl_c").write.partitionBy("of").parquet(to)
    named = lambda df: df.withColumn("ssp", F.regexp_extract("_file", "of=(SSP[0-9])", 1))
    return cubes.region_cube(s, f"{to}/of=*", preprocess=named, check=False).withColumn("value", r("value"))
