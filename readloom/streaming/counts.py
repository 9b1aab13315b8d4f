"""Counts that follow a landing directory of read tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_counts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Reads of each (round, sequence) over all Parquet files that have arrived; reads carry no event time, so none expire."""
    return spark.readStream.schema(schema).parquet(folder).groupBy("round", "sequence").agg(F.count("*").alias("reads"))


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the totals in a table in memory of that name."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
