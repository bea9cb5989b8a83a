"""Incremental ingestion of answer logs with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def answer_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """New JSON-lines files of a folder, each read once; malformed lines give null fields and are kept as such."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_answers(stream: DataFrame, key: str, at: str, delay: str = "2 days") -> DataFrame:
    """Non-empty answers, each key once within the watermark of `delay`; later repeats are dropped, state is bounded by it."""
    usable = stream.where("trim(coalesce(raw_output, '')) <> ''").where(F.col(at).isNotNull())
    return usable.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def rate_per_window(stream: DataFrame, at: str, window: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """Answers and failed answers per event-time window and source; late rows count until the watermark passes."""
    w = F.window(at, window)
    return (
        stream.withWatermark(at, delay).groupBy(w, "source").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.trim(F.coalesce("raw_output", F.lit(""))) == "").alias("empty"))
        .select(F.col("window.start").alias("window_start"), "source", "answers", "empty")
    )


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder, exactly once, until what is there now is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
