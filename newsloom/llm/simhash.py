"""SimHash near-duplicates by a segment-popcount embedding and a grid join.

A fingerprint of 64 bits is cut into 32 segments of two bits; each segment's bit count (0, 1 or 2) is one coordinate.
The Manhattan distance of two embeddings never exceeds the Hamming distance of their fingerprints. The coordinates are
dealt into GROUPS groups: within Manhattan distance 4 at least GROUPS - 4 groups agree wholly, so the grid has a cell for
each choice of GROUPS - 4 groups and their coordinates, and every pair to be found shares a cell. Counts are kept in
unary (a segment of one set bit is 01), so that the distance is a popcount. Only distinct fingerprints take part. In a
cell pairs are filtered by the lower bound and verified on the fingerprints; a cell of many gives a spanning forest of
its links, not all pairs, found by growing from one fingerprint through those not yet reached.

A null or empty text has fingerprint zero. A null id takes part but is never the component's name unless it has no other
id. Very long texts are hashed whole, in pieces of 65,536 shingles. Rows that repeat are linked as any others; an empty table gives an
empty one. Columns other than the id and the text are not read. Ties: a bit set in exactly half of the hashes is 0."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_sized, checkpointed, connected_components, row_key, staying_rows

WORDS, SEED, DISTANCE, GROUPS = 4, 42, 4, 7
#: Cells up to this size compare all their pairs at once, larger ones grow a spanning forest; both are exact.
SMALL = 16
_ODD = 0x5555555555555555


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The signed 64-bit SimHash of a text in UTF-8."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined, hashed = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist(), strict=True)
        values = np.array([hashed(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row."""
    return _fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


def _fingerprints(rows: DataFrame) -> DataFrame:
    """Of rows (columns, text): the columns and fp."""
    names, schema = rows.columns[:-1], ", ".join(f"{c} long" for c in rows.columns[:-1])
    arrow_sized(rows.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch.column(len(names)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*names, "fp"])

    return rows.mapInArrow(prints, f"{schema}, fp long")


def embedding(fp: str) -> Column:
    """The bit counts of the 32 segments, in unary."""
    return F.expr(f"(({fp} | shiftrightunsigned({fp}, 1)) & {_ODD}L) | shiftleft({fp} & shiftrightunsigned({fp}, 1) & {_ODD}L, 1)")


def _unary(fp: np.ndarray) -> np.ndarray:
    odd, half = np.uint64(_ODD), fp >> np.uint64(1)
    return ((fp | half) & odd) | ((fp & half & odd) << np.uint64(1))


def _masks(groups: int, distance: int) -> list[int]:
    """The signed bit mask of each choice of groups."""
    cut = np.array_split(np.arange(32), groups)
    of = [sum(3 << (2 * int(s)) for s in g) for g in cut]
    masks = [sum(m) for m in combinations(of, groups - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    near = np.flatnonzero(np.bitwise_count(_unary(a) ^ _unary(b)) <= distance)  # the lower bound
    return near[np.bitwise_count(a[near] ^ b[near]) <= distance]


def spanning(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the distance connects among distinct fingerprints."""
    out, left = [], fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.zeros(len(left), bool)
            near[_linked(np.broadcast_to(x, left.shape), left, distance)] = True
            if near.any():
                out.append((np.full(near.sum(), x), left[near]))
                front.extend(left[near])
                left = left[~near]
    return out


def _cell_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Batches of (cell, fp) in the order of cells: the verified links."""
    rest_c, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        fps = fps.view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(cells)))
        found = []
        after = np.repeat(sizes, sizes) - (np.arange(len(cells)) - np.repeat(starts, sizes))  # rows left in the cell
        after[np.repeat(sizes > SMALL, sizes)] = 0
        for step in range(1, SMALL):
            at = np.flatnonzero(after > step)
            if not len(at):
                break
            near = at[_linked(fps[at], fps[at + step], distance)]
            found.append((fps[near], fps[near + step]))
        for k in np.flatnonzero(sizes > SMALL):
            found += spanning(fps[starts[k] : starts[k] + sizes[k]], distance)
        a, b = (np.concatenate([np.asarray(x[i], np.uint64) for x in found] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        cells, fps = (np.concatenate((r, c.to_numpy(zero_copy_only=False))) for r, c in zip((rest_c, rest_f), batch.columns, strict=True))
        if not len(cells):
            continue
        cut = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
        yield links(cells[:cut], fps[:cut])
        rest_c, rest_f = cells[cut:], fps[cut:]
    yield links(rest_c, rest_f)


def links(fps: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that lie within ``distance`` bits."""
    arrow_sized(fps.sparkSession)
    masks = ", ".join(f"xxhash64({i}, e & {m}L)" for i, m in enumerate(_masks(groups, distance)))
    cells = fps.select("fp", embedding("fp").alias("e")).select(F.explode(F.expr(f"array({masks})")).alias("cell"), "fp")
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(lambda b: _cell_links(b, distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(classes.select("fp"), distance))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # a large component's rows can be split in the join
    of = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, decided by row: that of the smallest id, one without an id only where no other is in the component."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    prints = checkpointed(_fingerprints(rows))
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = prints.groupBy("fp").agg(F.min(best).alias("least"))
    found = connected_components(links(classes.select("fp"), DISTANCE))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("best")))
    of = rooted.join(named, "root").select("fp", F.col("best.key").alias("best"))
    return staying_rows(docs, prints.join(of, "fp").select("key", (F.col("key") == F.col("best")).alias("stays")), id_col, text_col)
