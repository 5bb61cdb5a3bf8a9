"""File-driven runs as Structured Streaming: new inputs only, once each, then stop.

Checkpoints take the place of skip-if-exists, end files and re-scan loops; a
run is stopped with StreamingQuery.stop(), or by a stop file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from boxloom.sources.sinks import exists


def json_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a stateless plan over everything that is new, write Parquet, and stop."""
    return plan(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run any batch plan (joins, grouped steps) on each micro-batch; `write` gets the batch's number, for exactly-once output."""
    return stream.writeStream.foreachBatch(lambda df, n: write(plan(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_until(query: StreamingQuery, stop_file: str, poll: int = 5) -> bool:
    """Wait for a query, stopping it once stop_file exists; whether it ran to its end. A stopped run resumes from its checkpoint."""
    while query.isActive:
        if exists(SparkSession.active(), stop_file):
            query.stop()
            return False
        query.awaitTermination(poll)
    query.awaitTermination()  # raises what a failed run ended with
    return True
