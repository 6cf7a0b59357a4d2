"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Pass one reduces each row to (id, length, digest) and deals small integer cells, two for each digest, to be counted
with map-side combining. Cells counted once prove that a digest is unique. The cells counted twice or more become a
bitmap (blocks of 32,768 bits) of bounded size, which is broadcast. Pass two looks both cells of every row up: a row
with a clear bit passes straight through as a group of one; only the rest shuffle, on the whole digest, so a false
positive of the filter costs a shuffled row and never changes a result.

Nulls: a null text counts as empty; a null id orders after all others. Rows that repeat an id with an equal text are
one document and share its decision. Very long texts are digested whole. An empty table gives an empty one. Columns other than the id
and the text are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed, row_key, staying_rows

#: Bits of the filter for each row, and at most: 2**29 bits are 64 MB. Beyond that more rows shuffle; results stay the same.
BITS_PER_ROW, MOST_BITS, BLOCK = 16, 1 << 29, 32_768


def normalised(text: Column | str) -> Column:
    """The text without ASCII white space (space, tab to carriage return); null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _cells(digest: str, bits: int) -> list[Column]:
    """Two independent cells of a hex digest: bits 0 to 59 and 60 to 119, modulo the size."""
    return [(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") % F.lit(bits)).cast("long") for at in (1, 16)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with most code points in the original text stays, of those the smallest id."""
    return _decided(docs, id_col, text_col, bits_per_row, most_bits, False)


def _decided(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, most_bits: int, by_row: bool) -> DataFrame:
    """exact_dedup(); by row, those rows only that may have copies, as key and stays: true for the rows of one key in each group."""
    own = ["key"] if by_row else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n"), F.sha2(normalised(text_col), 256).alias("text_sha256"), *([row_key(id_col, text_col).alias("key")] if by_row else [])))
    bits = BLOCK
    n = rows.count()
    while bits < min(n * bits_per_row, most_bits):
        bits *= 2

    counted = rows.select(F.explode(F.array(*_cells("text_sha256", bits))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    blocks = counted.groupBy(F.expr(f"cell div {BLOCK}").alias("block")).agg(F.expr(f"bitmap_construct_agg(cell % {BLOCK})").alias("bits"))
    # At most MOST_BITS / BLOCK rows of 4 KB: 64 MB.
    blocks = F.broadcast(checkpointed(blocks))

    def looked_up(df: DataFrame, k: int) -> DataFrame:
        """Adds hit<k>: whether bit cell<k> of the bitmap is set."""
        byte = f"cast(conv(hex(substring(bits, cast((cell{k} % {BLOCK}) div 8 as int) + 1, 1)), 16, 10) as int)"
        joined = df.join(blocks.select(F.col("block").alias("block_"), "bits"), F.expr(f"cell{k} div {BLOCK} = block_"), "left")
        return joined.withColumn(f"hit{k}", F.expr(f"coalesce((shiftright({byte}, cast(cell{k} % 8 as int)) & 1) = 1, false)")).drop("bits", "block_")

    first, second = _cells("text_sha256", bits)
    flagged = looked_up(looked_up(rows.withColumns({"cell0": first, "cell1": second}), 0), 1).withColumn("maybe", F.expr("hit0 and hit1")).select("doc_id", "n", "text_sha256", "maybe", *own)
    alone = flagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = flagged.where("maybe").select("doc_id", "n", "text_sha256", *own)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *own))
    groups = again.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = checkpointed(groups)  # so that the join's two sides are plain shuffles, of which a large group's rows can be split
    if by_row:
        return again.join(groups, "text_sha256").select("key", (F.col("key") == F.col("best.key")).alias("stays"))
    met = again.join(groups, "text_sha256").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group, decided by row, not by id."""
    return staying_rows(docs, _decided(docs, id_col, text_col, BITS_PER_ROW, MOST_BITS, True), id_col, text_col)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k FROM documents),
e AS (SELECT doc_id, sha256(k) AS text_sha256, length(t) AS n FROM d),
f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM e)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM f
"""
