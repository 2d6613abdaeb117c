"""Incremental corpus intake with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_key, word_count
from ..operators.sampling import split_of


def stream_samples(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 64) -> DataFrame:
    """JSON lines as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def admitted(stream: DataFrame, text: str, time: str, late: str = "14 days", least: int = 50) -> DataFrame:
    """Word floor, one row of each content key while its state lasts (the watermark bounds it), and the split of the key."""
    rows = stream.where(word_count(F.col(text)) >= least).withColumn("key", content_key(F.col(text)))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["key"]).withColumn("split", split_of(F.col("key")))


def write_splits(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to one folder a split; exactly once by the file sink's log."""
    return stream.writeStream.format("parquet").partitionBy("split").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Rows a key and window of event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).count()
