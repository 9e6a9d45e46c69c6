"""Frequencies of a streaming table. Each micro-batch adds its counts as a partition of a table; reading sums them.

A batch that runs again after a failure overwrites its own partition, so that no row counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.cells import frequencies


def start(stream: DataFrame, name: str, path: str, checkpoint: str) -> StreamingQuery:
    """Count the stream's values into ``path``."""

    def add(batch: DataFrame, number: int) -> None:
        frequencies({name: batch}).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The frequencies of all batches so far."""
    by = ["table_name", "column_name", "ordinal", "family", "v", "len"]
    return spark.read.parquet(path).groupBy(*by).agg(F.sum("cnt").alias("cnt"))
