"""[A2, A3, A9 to A14, A17, A18] Sinks as functions from what is stored and what comes to what is to be stored."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """[A10] The incoming rows to append: the first of each key by ``order``, without keys that exist."""
    first = incoming.withColumn("rn__", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("rn__ = 1").drop("rn__")
    return first.join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """[A11, A13] Existing rows whose key doesn't come, and all incoming rows; incoming keys are distinct."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def insert_where_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], active: Column) -> DataFrame:
    """[A12] Incoming rows without an active row of their key."""
    return incoming.join(existing.where(active).select(*keys), keys, "left_anti")


def after(df: DataFrame, mark: int, key: str = "id") -> DataFrame:
    """[A2, S4] Rows beyond the high-water mark; the filter reaches the scan."""
    return df.where(F.col(key) > mark)


def due_work(df: DataFrame, score: str) -> DataFrame:
    """[A3, A9] Rows without a score, as one job rather than batches."""
    return df.where(F.col(score).isNull())


def replace_partition(df: DataFrame, path: str, by: str = "cluster_run_id") -> None:
    """[A14] Overwrites just the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def rejected(df: DataFrame, path: str) -> None:
    """[A17] Rejected rows as tab-separated text."""
    df.write.mode("append").option("sep", "\t").csv(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints, which all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (tests) takes a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="newsloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder, so that what several steps read is computed once and lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
