"""Indicator parameters from YAML: a `protocol` of groups, and `indicators` with variables by group."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TEXT = ("short_name", "long_name", "unit", "ind_cmap", "diff", "diff_cmap")
NUMBERS = ("ind_min", "ind_max", "diff_min", "diff_max")
SCHEMA = "group_name string, var_name string, protocol string, short_name string, long_name string, unit string, ind_cmap string, diff string, diff_cmap string, ind_min double, ind_max double, diff_min double, diff_max double, score_range array<double>"


#: Parameters of the fixtures' indicators.
EXAMPLE = str(Path(__file__).with_name("example.yml"))


def load(path: str) -> dict:
    """Parameters from a local YAML file; needs PyYAML."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def frame(spark: SparkSession, loaded: dict) -> DataFrame:
    """One row for each variable."""
    protocol = loaded.get("protocol") or {}
    rows = []
    for group, variables in (loaded.get("indicators") or {}).items():
        for name, x in (variables or {}).items():
            x = x or {}
            number = lambda k: None if x.get(k) is None else float(x[k])  # noqa: B023, E731
            rows.append((group, name, protocol.get(group), *(None if x.get(k) is None else str(x[k]) for k in TEXT), *map(number, NUMBERS), [float(v) for v in x["score_range"]] if x.get("score_range") else None))
    return spark.createDataFrame(rows, SCHEMA)


def score_edges(params: DataFrame) -> DataFrame:
    """indicator and `edges`, the ascending score_range, of the variables that have one."""
    from pyspark.sql import functions as F

    return params.where("score_range is not null").select(F.col("var_name").alias("indicator"), F.sort_array("score_range").alias("edges"))
