"""Incremental intake of source pages: the batch functions over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Reads new Parquet files as they come, keeps the first row of each key, and hands each batch to the sink."""
    rows = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
