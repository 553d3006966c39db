"""Tail of an event log as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from quarry.sources.shared import shared_dir


def drain(log: DataFrame, new: Column, place: str) -> None:
    """Appends the new rows of a streamed log to the Parquet table at place, and ends when all that has arrived is there.

    Offsets are kept beside the table: the next call goes on after the last file read, and a repeated batch is written once.
    """
    written = log.where(new).writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/offsets")
    written.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def tail(spark: SparkSession, files: str, schema, new: Column) -> DataFrame:
    """The rows that are new, from a stream over Parquet files (a pattern)."""
    place = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    drain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(files), new, place)
    return spark.read.schema(schema).parquet(f"{place}/rows")
