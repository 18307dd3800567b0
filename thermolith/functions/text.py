"""Column functions on names of variables, scenarios and models."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(column: Column, pattern: str) -> Column:
    """Whole-string match in which only * is special."""
    if "*" not in pattern:
        return column == pattern
    return column.rlike("(?s)^" + ".*".join(re.escape(x) for x in pattern.split("*")) + r"\z")


def any_match(column: Column, patterns: str | list[str] | tuple[str, ...]) -> Column:
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    plain = [p for p in patterns if "*" not in p]
    tests = ([column.isin(plain)] if plain else []) + [matches(column, p) for p in patterns if "*" in p]
    out = tests[0] if tests else F.lit(False)
    for t in tests[1:]:
        out = out | t
    return out


def contains_any(column: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | column.contains(p)
    return out


def strip_ssp(variable: Column) -> Column:
    """Text before the first _ssp."""
    return F.substring_index(variable, "_ssp", 1)


def stem(variable: Column) -> Column:
    return F.substring_index(variable, "|", 1)


def remove_literal(column: Column, literal: str) -> Column:
    return F.replace(column, F.lit(literal), F.lit(""))


def ssp_of(scenario: Column) -> Column:
    """SSP label of `<ssp>_<int>p<frac>`, or null if it hasn't two parts."""
    parts = F.split(scenario, "_")
    return F.when(F.size(parts) == 2, F.upper(parts[0]))


def gwl_of(scenario: Column) -> Column:
    parts = F.split(scenario, "_")
    return F.when(F.size(parts) == 2, F.replace(parts[1], F.lit("p"), F.lit(".")).try_cast("double"))


def map_label(model: Column, scenario: Column) -> Column:
    """Label of a map: space, slash, comma and dot of the model become _."""
    return F.concat_ws("_", F.translate(model, " /,.", "____"), scenario)


def ssp_label(family: Column, default: str) -> Column:
    """Numbers 1 to 5 (also as text) become SSPn, null and '' the default; anything else stays."""
    number = family.cast("string").try_cast("double")
    label = F.when(number.isin(1.0, 2.0, 3.0, 4.0, 5.0), F.concat(F.lit("SSP"), number.cast("int").cast("string"))).otherwise(family.cast("string"))
    return F.coalesce(F.nullif(label, F.lit("")), F.lit(default))
