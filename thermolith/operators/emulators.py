"""Emulators of the user's own, run for each scenario by Spark.

A function gets the rows of one scenario, in the order of years, as a list of dicts, and gives dicts of what it returns.  It
becomes a table function under a name of its own, so DataFrames and SQL can call it; Spark partitions and sorts the rows.  A
scenario's rows, bounded by the calendar, are what one call holds."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

Emulator = Callable[[list[dict]], Iterable[dict]]


def register(spark: SparkSession, name: str, emulator: Emulator, returns: str) -> None:
    """Makes `SELECT * FROM name(TABLE(rows) PARTITION BY (model, scenario) ORDER BY year)` known; `returns` is a schema."""
    if not name.isidentifier():
        raise ValueError(f"no name of a function: {name!r}")
    fields = StructType.fromDDL(returns).names

    class Scenario:
        def __init__(self):
            self.rows = []

        def eval(self, row):
            self.rows.append(row.asDict())

        def terminate(self):
            for out in emulator(self.rows):
                yield tuple(out.get(f) for f in fields)

    spark.udtf.register(name, udtf(Scenario, returnType=returns))


def run(rows: DataFrame, name: str, by: tuple[str, ...] = ("model", "scenario"), order: str = "year") -> DataFrame:
    """What the registered emulator gives for each scenario of `rows`."""
    spark = rows.sparkSession
    quoted = ", ".join(f"`{c}`" for c in by)
    return spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{rows}}) PARTITION BY ({quoted}) ORDER BY `{order}`)", rows=rows)
