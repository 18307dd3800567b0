"""Emulation of pathways that arrive as a stream, against static cubes.

Each pathway row is looked up on its own, so there is no state: stream-static joins in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..config import DEFAULT, EngineConfig
from ..operators import table


def pathways(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Pathway rows from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema.GMT_PATHWAY).option("maxFilesPerTrigger", files_at_once).parquet(path)


def lookup(stream: DataFrame, knots: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """table.lookup of streamed rows."""
    return table.lookup(stream, knots, config)


def write(impacts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends impacts as Parquet; with `once` all that is there is processed and the query ends."""
    writer = impacts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
