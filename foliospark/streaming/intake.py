"""Arrivals as a stream: admission, repeats, batch statistics, conversion.

Each function takes or returns a streaming DataFrame. `drain` runs one over everything that is there now, into a
Parquet table under the session's shared checkpoint folder, with its own checkpoint, so a restart repeats nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import admit_files
from ..sources.outputs import shared_folder


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at path, with the columns that they have."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def stream_intake(arrivals: DataFrame) -> DataFrame:
    """Arrivals with their admission: reason, and whether admitted."""
    return admit_files(arrivals)


def stream_dedup(arrivals: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The first of each (name, size) within the watermark."""
    return arrivals.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["name", "size"])


def stream_batch_stats(results: DataFrame, window: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Counts and time per tumbling window; in append mode a window is given out once the watermark has passed it."""
    w = F.window("arrived_at", window)
    return results.withWatermark("arrived_at", watermark).groupBy(w).agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.sum("processing_time").alias("total_time")).select(F.col("window.start").alias("window_start"), "total", "succeeded", "total_time")


def stream_convert(stream: DataFrame, convert: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Each micro-batch through a batch pipeline; a batch that is run again replaces its own output."""

    def run(batch: DataFrame, batch_id: int) -> None:
        convert(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, as a table."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
