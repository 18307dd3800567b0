"""Impact cubes as long Parquet tables: one or many files, file names with meaning, and sinks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text

Preprocess = Callable[[DataFrame], DataFrame]
#: Reads one path of another format (netCDF, ...) as a long frame; there is no decoder of these here.
Reader = Callable[[SparkSession, str], DataFrame]


def _load(spark: SparkSession, source, what: str, preprocess: Preprocess | None, reader: Reader | None = None) -> DataFrame:
    """All files of a path, a glob or a list of these in one scan; columns may differ and are matched by name.

    `preprocess` gets the rows of all files at once, each with the path of its file in `_file`, so that there is one plan for any
    number of files."""
    if isinstance(source, DataFrame):
        return preprocess(source) if preprocess else source
    paths = [source] if isinstance(source, str) else list(source) if isinstance(source, (list, tuple)) else None
    if not paths or not all(isinstance(p, str) for p in paths):
        raise ValueError(f"no {what}: {source!r}")
    if reader is None:
        df = spark.read.option("mergeSchema", "true").parquet(*paths)
        return preprocess(df.withColumn("_file", F.col("_metadata.file_path"))).drop("_file") if preprocess else df
    frames = [preprocess(reader(spark, p)) if preprocess else reader(spark, p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def region_cube(spark: SparkSession, source, preprocess: Preprocess | None = None, check: bool = True, reader: Reader | None = None) -> DataFrame:
    return schema.region_impacts(_load(spark, source, "regional cube", preprocess, reader), check)


def raster_cube(spark: SparkSession, source, indicator: str | None = None, preprocess: Preprocess | None = None, check: bool = True, swap_xy: bool = False, reader: Reader | None = None) -> DataFrame:
    """A raster; its indicators lose what follows _ssp."""
    df = _load(spark, source, "raster", preprocess, reader)
    out = schema.raster_impacts(df, indicator, check, swap_xy)
    return out.withColumn("indicator", text.strip_ssp(F.col("indicator")))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files below a path or glob, and what its folders' names say; no file is opened."""
    return spark.read.format("binaryFile").load(path).drop("content", "length", "modificationTime")


def discover(spark: SparkSession, template: str, one_each: str | None = None) -> list[dict[str, str]]:
    """The files (or folders) that a template such as `out/{indicator}_{ssp}.parquet` names, each with what its placeholders hold.

    With `one_each` no value of that placeholder may have two files.  Only names are listed, no file is read."""
    holes = re.findall(r"\{(\w+)\}", template)
    glob = re.sub(r"\{\w+\}", "*", template)
    pattern = re.escape(template.rsplit("/", 1)[-1])
    for h in holes:
        pattern = pattern.replace(re.escape(f"{{{h}}}"), f"(?P<{h}>[^/]+?)", 1)
    above = glob.rstrip("/").count("/") - (1 if glob.startswith("/") else 0)
    try:
        names = _listed(spark, glob)
    except AnalysisException:  # nothing has such a name
        return []
    # a folder is named once, not once for each of its files
    first = "[^:]*:/+" + "[^/]*/" * above + "[^/]*" if "://" not in template and template.startswith("/") else ".*/" + re.sub(r"\(\?P<\w+>", "(?:", pattern)
    found = [r["path"] for r in names.select(F.regexp_extract("path", f"^({first})(?:/.*)?$", 1).alias("path")).distinct().collect()]
    out = []
    for name in found:
        if m := re.fullmatch(pattern, name.rsplit("/", 1)[-1]):
            out.append({"path": name} | m.groupdict())
    if one_each:
        seen = [x[one_each] for x in out]
        if twice := sorted({x for x in seen if seen.count(x) > 1}):
            raise ValueError(f"several files of {', '.join(twice)}")
    return sorted(out, key=lambda x: x["path"])


def raster_by_level(spark: SparkSession, paths: list[str], pattern: str, indicator: str | None = None, preprocess: Preprocess | None = None, levels: list[float] | None = None) -> DataFrame:
    """One raster from one file (or folder) for each level: group `gwl` of `pattern`, with p for the point, is the level, and
    group `indicator`, if there is one, the indicator.  With `levels` only files of these are opened.

    `preprocess` gets the rows of all files, each with its file's path in `_file`."""
    named = re.compile(pattern)
    groups = named.groupindex
    if "gwl" not in groups:
        raise ValueError("the pattern needs a group gwl")
    if levels is not None:
        names = [r["path"] for p in paths for r in _listed(spark, p).select("path").distinct().collect()]
        level_of = lambda name: float(m["gwl"].replace("p", ".")) if (m := named.search(name)) else None
        paths = sorted({n for n in names if level_of(n) in set(map(float, levels))})
        if not paths:
            raise ValueError(f"no file of the levels {levels}")
    java = re.sub(r"\(\?P<", "(?<", pattern)
    df = spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("_file", F.col("_metadata.file_path"))
    level = F.replace(F.regexp_extract("_file", java, groups["gwl"]), F.lit("p"), F.lit(".")).try_cast("double")
    df = df.withColumn("gwl", level)
    if "indicator" in groups:
        df = df.withColumn("indicator", F.regexp_extract("_file", java, groups["indicator"]))
    df = preprocess(df) if preprocess else df
    return raster_cube(spark, df.drop("_file"), indicator)


#: Columns that place a value within an indicator, in the order files are clustered by.
PLACES = ("region", "lat", "lon", "ssp", "gwl", "year")


def write(df: DataFrame, path: str, by: tuple[str, ...] = ("indicator",), files: int | None = None, most_rows: int = 5_000_000, row_group: int = 8 << 20) -> None:
    """Compressed Parquet in a folder for each indicator (or stem, region), so that readers skip the others.

    Rows are range-partitioned by folder and place into `files` parts (as many as the shuffle has), however they are shared out
    among the folders: a large indicator has many files.  They are sorted by place and their row groups hold `row_group` bytes at
    most, so that a filter on a place reads few of them."""
    places = [c for c in PLACES if c in df.columns and c not in by]
    parts = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *by, *places).sortWithinPartitions(*by, *places)
    rows.write.mode("overwrite").partitionBy(*by).options(**{"compression": "zstd", "maxRecordsPerFile": most_rows, "parquet.block.size": row_group}).parquet(path)


def write_levels(raster: DataFrame, path: str) -> None:
    """A raster in a folder for each indicator and level."""
    write(raster.drop("gwl_c"), path, ("indicator", "gwl"))


def read_levels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A raster in folders by indicator and level, and its axes (indicator, levels) from the folders' names alone.

    `maps.emulate(path, raster, axes=axes)` opens the files of the levels it needs only."""
    kinds = "lat double, lon double, value double, indicator string, gwl string"
    # doubles are no keys for pruning: the folders' own names are
    raster = spark.read.schema(kinds).parquet(path).withColumnRenamed("gwl", "level").withColumn("gwl", F.col("level").cast("double"))
    named = _listed(spark, path).select(F.col("indicator").cast("string").alias("indicator"), F.col("gwl").cast("double").alias("gwl"))
    return raster, named.groupBy("indicator").agg(F.sort_array(F.collect_set("gwl")).alias("levels"))
