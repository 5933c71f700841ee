"""Incremental runs: the batch transforms over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkweave.engine import Config, convert
from inkweave.sources.packages import ANY_CASE, format_of


def convert_stream(spark: SparkSession, path: str, out: str, checkpoint: str, config: Config = Config(), files_per_batch: int = 1000) -> StreamingQuery:
    """Converts packages that appear under ``path`` into Parquet result rows, each file once, and stops when it has caught up.

    A batch is written under its own number, so one that is run again after a
    failure replaces its rows.
    """
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    arrived = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", ANY_CASE).option("maxFilesPerTrigger", files_per_batch).load(path)
    source = arrived.select(F.col("path").alias("source_id"), format_of(F.col("path")).alias("format"), "content")

    def write(df: DataFrame, number: int) -> None:
        convert(df, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and their value by hour and type, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run_to_table(df: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a streaming aggregation over all that is there and leaves its complete result as Parquet."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
