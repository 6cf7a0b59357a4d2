"""[S1 to S3] The embedding queue: keyed state with timers, rows that go back on the queue, a sweep by version.

The queue is a folder of Parquet files of (id, title, content_text, embedding_version, attempt). The stream keeps one state for each article: the version and
attempt that it saw last and, while it waits, the text. A row that is not newer than the state is dropped, so an article that is announced twice is encoded once.
A first attempt goes out at once; a further one waits for its timer, as the reference's catch-up looks every 30 seconds. Each micro-batch that goes out
is encoded in batches and written to a folder of its own, which a batch that runs again replaces; what got no embedding is written back on the queue with one more attempt. At a start
sweep() puts every article on the queue that has no embedding or one of another version."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

QUEUE = "id long, title string, content_text string, embedding_version string, attempt int"
EMBEDDED = "id long, embedding array<float>, embedding_version string, attempt int"
#: Seconds that a row waits before it is tried again, and files of a micro-batch.
DELAY, FILES = 30.0, 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["id", "title", "content_text", "embedding_version", "attempt"]


class Waiting(StatefulProcessor):
    def __init__(self, delay: float):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "title string, content_text string, embedding_version string, attempt int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (id_,) = key
        newest = None
        known = self.seen.get() if self.seen.exists() else None
        for pdf in rows:
            for _, r in pdf.iterrows():
                row = (r["title"], r["content_text"], r["embedding_version"], int(r["attempt"]))
                last = newest or known
                if last is None or row[2] != last[2] or row[3] > last[3]:
                    newest = row
        if newest is None:
            return
        title, text, version, attempt = newest
        if attempt == 0:
            self.seen.update((None, None, version, 0))
            yield pd.DataFrame([(id_, title, text, version, 0)], columns=COLUMNS)
        else:
            self.seen.update(newest)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.delay * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        title, text, version, attempt = self.seen.get()
        if title is None and text is None:
            return  # a row of another version came meanwhile
        self.seen.update((None, None, version, attempt))
        yield pd.DataFrame([(key[0], title, text, version, attempt)], columns=COLUMNS)

    def close(self) -> None:
        pass


def enqueue(rows: DataFrame, queue: str, version: str) -> None:
    """Puts articles (id, title, content_text) on the queue."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "content_text")]
    rows.select(F.col("id").cast("long").alias("id"), *texts, F.lit(version).alias("embedding_version"), F.lit(0).alias("attempt")).write.parquet(f"{queue}/new-{uuid.uuid4().hex}")


def embedded(spark: SparkSession, out: str) -> DataFrame:
    """(id, embedding, embedding_version): the latest of each article of what the stream wrote."""
    latest = Window.partitionBy("id").orderBy(F.desc("batch"), F.desc("run"))
    rows = spark.read.schema(EMBEDDED + ", run string, batch long").parquet(out)
    return rows.withColumn("rn", F.row_number().over(latest)).where("rn = 1").select("id", "embedding", "embedding_version")


def stale(articles: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """[S2, S3] The articles without an embedding of this version."""
    return articles.join(done.where(F.col("embedding_version") == version).select("id"), "id", "left_anti")


def sweep(articles: DataFrame, done: DataFrame, queue: str, version: str) -> None:
    """[S3] stale() articles go on the queue."""
    enqueue(stale(articles, done, version), queue, version)


def embed_queue(spark: SparkSession, queue: str, out: str, checkpoint: str, encode: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], *, delay: float = DELAY, every: str = "5 seconds", files: int = FILES) -> StreamingQuery:
    """Runs the queue. ``encode``: for mapInPandas, from (id, text) to (id, embedding), null where it fails; an error in it fails the batch, which runs again from its offsets."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", files).parquet(f"{queue}/*")
    due = stream.groupBy("id").transformWithStateInPandas(Waiting(delay), QUEUE, "append", "processingTime")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.checkpoint()
        made = batch.select("id", F.concat_ws(" ", "title", "content_text").alias("text")).mapInPandas(encode, "id long, embedding array<float>")
        tried = batch.join(made, "id", "left").checkpoint()
        good = tried.where("embedding IS NOT NULL").select("id", "embedding", "embedding_version", "attempt")
        good.write.mode("overwrite").parquet(f"{out}/run=0/batch={number}")
        failed = tried.where("embedding IS NULL")
        if not failed.isEmpty():
            failed.select("id", "title", "content_text", "embedding_version", (F.col("attempt") + 1).alias("attempt")).write.mode("overwrite").parquet(f"{queue}/retry-{number}")

    return due.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
