"""Sharding by extendible hashing, in DataFrame functions.

A document's hash is the first 60 bits of the md5 of its id. A directory is indexed by the first bits of the hash; a
bucket over the byte limit splits on the next bit, others stay, so shards have as many bits as they need and a shard
that does not overflow never moves. Bytes are summed per cell of DEPTH bits with map-side combining, the cells are summed
upwards, and a bucket is a shard if it fits and its parent did not. Where a cell itself is too large, the next DEPTH bits are
taken for its documents alone, until all fit. One hash that alone is too large (one document, or rows that repeat an id)
cannot split: it is a shard by itself, marked as oversized.

A null text has no bytes; a null id hashes as an empty string. Rows that repeat an id share a shard, and ids whose hashes tie
stay together. An empty table has no shards. Very long texts count by their bytes. Other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed

BITS, DEPTH = 60, 16
LIMIT = 4 << 20


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each document: doc_id, shard (its hash bits), depth, shard_bytes, shard_docs, oversized."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), hashed.alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")))
    done, base, left = None, 0, rows
    while True:
        low, high = base, min(BITS, base + DEPTH)
        cell = F.shiftright("h", BITS - high)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        levels = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        buckets = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("h0").alias("h0"), F.max("h1").alias("h1")).withColumn("stays", F.expr(f"bytes <= {limit} OR h0 = h1"))
        buckets = checkpointed(buckets)
        split = buckets.where("NOT stays").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        roots = buckets.where(F.col("depth") == low)
        below = buckets.withColumn("parent", F.shiftright("prefix", 1)).join(split, ["depth", "parent"], "left_semi").select(*buckets.columns)
        leaves = (roots if base == 0 else below).where("stays") if base else roots.where("stays").unionByName(below.where("stays"))
        named = levels.select("cell", "depth", "prefix").join(leaves.select("depth", "prefix", "bytes", "n"), ["depth", "prefix"])
        placed = left.withColumn("cell", cell).select("doc_id", "h", F.col("bytes").alias("own"), "cell").join(named, "cell")
        part = placed.select("doc_id", F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')")).alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_docs"), (F.col("bytes") > limit).alias("oversized"))
        done = part if done is None else done.unionByName(part)
        over = buckets.where((F.col("depth") == high) & ~F.col("stays")).select(F.col("prefix").alias("cell"))
        if high == BITS or not over.limit(1).count():
            return done
        left, base = checkpointed(left.withColumn("cell", cell).join(over, "cell", "left_semi").drop("cell")), high


SQL = f"""
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents),
l AS (SELECT doc_id, h, bytes, unnest(range(0, 33)) AS depth FROM d),
b AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) AS bytes, count(*) AS n, min(h) AS h0, max(h) AS h1 FROM l GROUP BY 1, 2),
s AS (SELECT *, bytes <= {LIMIT} OR h0 = h1 AS stays FROM b),
leaf AS (SELECT s.* FROM s LEFT JOIN s p ON p.depth = s.depth - 1 AND p.prefix = s.prefix >> 1 WHERE s.stays AND (s.depth = 0 OR NOT p.stays))
SELECT d.doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INT), '0') END AS shard, CAST(depth AS INT) AS depth, CAST(leaf.bytes AS BIGINT) AS shard_bytes, leaf.n AS shard_docs, leaf.bytes > {LIMIT} AS oversized
FROM d JOIN leaf ON leaf.prefix = d.h >> (60 - leaf.depth)
"""
