"""Caution checks of pathways whose years arrive in any order.

The state is a scenario's peak, lowest and last level, kept by Spark's own streaming aggregation: as the last level is that of the
greatest year seen, years that come late count as in a batch.  Each trigger gives the scenarios it has changed; their rows
are written in a folder of the trigger's number, over what an earlier try left there, and the newest row of a scenario holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, EngineConfig
from ..operators import pathway

KEY = ["model", "scenario"]


def checks(stream: DataFrame, config: EngineConfig = DEFAULT, years: list[int] | None = None) -> DataFrame:
    """pathway.warnings of what has arrived so far."""
    return pathway.warnings(stream, config, years)


def keep(found: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes what each trigger changed; with `once` all that is there is processed and the query ends."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    writer = found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each scenario."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*KEY, "trigger")]
    newest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "trigger").alias("x"))
    return newest.select(*KEY, *(F.col(f"x.{c}").alias(c) for c in rest))
