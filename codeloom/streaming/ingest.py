"""New source files as a stream: the same extraction and graph as in batch, kept up to date per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph


def unit_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def arrivals(files: DataFrame, lateness: str = "30 days", window: str = "1 day") -> DataFrame:
    """(window, repo, files) of scanned files by the day of their scan, late rows up to lateness; for a stream or a table."""
    timed = files.where(F.col("scanned_at").isNotNull()).withColumn("at", F.col("scanned_at").cast("timestamp"))
    if files.isStreaming:
        timed = timed.withWatermark("at", lateness)
    return timed.groupBy(F.window("at", window), "repo").agg(F.count("*").alias("files"))


def maintain_edges(units: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the edges of each micro-batch below folder, once per batch id however often the batch is run."""

    def put(batch: DataFrame, n: int) -> None:
        graph.edges(batch).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return units.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
