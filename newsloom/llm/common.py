"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.sinks import shared_folder

#: A side is broadcast only if its counted rows times its row width stay below this; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder, so that lost executors cost no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df``, written as a Parquet table in the shared checkpoint folder and read again: as checkpointed(), but compressed,
    for tables of many rows. The table stays until the owner of that folder clears it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``: the fold of a document. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % of, F.lit(0))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The key of a row: rows of one key are alike in id (or both without one) and text."""
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or that with underscores after it: no column of ``docs`` in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _meeting(docs: DataFrame, keys: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with row_key() as a column of the name that comes with it, joined to the column key of ``keys`` by a left anti or semi join."""
    row = unused(docs, "__row")
    other = row + "2"
    while other in docs.columns:
        other += "2"
    return docs.withColumn(row, row_key(id_col, text_col)).join(keys.select(F.col("key").alias(other)).distinct(), F.col(row) == F.col(other), how)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose row_key() is not in the column key of ``gone``, with their columns."""
    return _meeting(docs, gone, "left_anti", id_col, text_col).select(docs.columns)


def staying_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay by ``decided`` (key, stays; a row for each row of ``docs`` that is not alone), of rows with one key one."""
    odd = checkpointed(decided.groupBy("key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1").select("key", "stays"))
    out = without_rows(docs, odd, id_col, text_col)
    again = odd.where("stays")
    if again.isEmpty():
        return out
    return out.unionByName(_meeting(docs, again, "left_semi", id_col, text_col).dropDuplicates([unused(docs, "__row")]).select(docs.columns))


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (already materialised) has few enough rows to be broadcast."""
    return df.count() * row_bytes <= limit


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) of longs; component: the smallest node reachable.

    Large-star and small-star steps in turn (Kiverenko and others, 2014): each is one shuffle of the edges, and a
    hub's edges are re-hung rather than gathered, so no group is collected. Self loops and repeated or null edges
    do nothing; nodes without an edge to another do not occur in the result; an empty table gives an empty one."""
    edges = edges.select("a", "b").where("a <> b").distinct()
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs: (a, b), each node a with neighbours b. Larger (or else not larger) neighbours move to the least one."""
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = pairs.where("b > a" if large else "b < a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    for _ in range(limit):
        mark = now.select(sign.alias("s")).first()["s"]
        if mark == before:
            break
        before = mark
        now = checkpointed(star(star(both(now), True), False))
    else:
        raise RuntimeError(f"the components did not settle in {limit} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def arrow_sized(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers: long texts must not meet in one batch of 10,000 rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


#: log2 of the bits of a bitmap of integers: 16 MB, however many there are.
BITMAP = 27


def _bit(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP)


def bitmap(keys: DataFrame) -> Broadcast:
    """A broadcast filter of fixed size for the longs in the only column of ``keys``, for in_bitmap(); when it fills, more passes."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy().view(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> 5).astype(np.int32)), pa.array(np.int64(1) << (bit & 31))], ["at", "bits"])

    found = keys.mapInArrow(bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2^(BITMAP - 5) rows at most
    words = np.zeros(1 << (BITMAP - 5), np.dtype("<u4"))
    words[found["at"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(words.view(np.uint8))


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of the unsigned integers may be among the keys."""
    bit = _bit(keys)
    return (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Characters of text that Python holds the words of at once, or one text.
SLICE = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of the batches, whose last column is the text, in slices of about SLICE characters of text."""
    for batch in batches:
        upto = np.cumsum([len(t) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()])
        cuts = [0, *(np.flatnonzero(np.diff(upto // SLICE)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
