"""[S1 to S5] Ingest as Structured Streaming: a file source in place of notifications, exactly once by offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def deduplicated(spark: SparkSession, path: str, schema: StructType, key: str, time: str, late: str = "1 hour", files: int = 64) -> DataFrame:
    """[S1, S2] A stream of new files in micro-batches, each key once within the watermark: state is bounded."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def embed_stream(stream: DataFrame, encode: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, backfill: bool = False) -> StreamingQuery:
    """[S1, S3] Encodes each micro-batch and appends it; a batch that runs again writes its own folder again.
    backfill: all that is there, then stop; else a batch every five seconds."""

    def write(batch: DataFrame, number: int) -> None:
        encode(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if backfill else writer.trigger(processingTime="5 seconds")).start()
