"""Passages that repeat across documents, by compact windows over min-hashes.

Tokens are five-word shingles, hashed; a passage is SPAN of them (fifty words) or more. Two passages of SPAN shingles and of
similarity 0.8 differ by five shingles at most, which is one word changed, added or left out, so they share an unbroken
run of RUN = 21. Every stretch of RUN shingles has a least hash; the stretches around one least shingle form a compact
window, the subtree of the Cartesian tree that it roots, cut at RUN. A shared run has the same least shingle in both documents,
with ten shared shingles more on its right or on its left: a window has two signatures, the eleven shingles to each side, and
documents that share a passage share a signature with certainty, by one hash function. Signatures met in one document only are
dropped (a bitmap of the others, of fixed size, tells; a false positive costs a row).

The windows of a signature are laid on each other at the least shingle. What is equal over all SPAN shingles to either side
is one class, and its rows are members of the first (a further place of the first's row is a member of another row). Classes
are compared by sketches (a byte for each shingle, on the diagonal and on its two neighbours, so that nothing similar is left
out), all with all. A signature of more than HOT documents is not brought together: its classes are kept only if enough of
their content occurs in a second class of the signature (counted, so nothing that has a partner goes) and are then laid on each
other in blocks, all with all too. Links of one pair and diagonal that touch are joined, and all but the equal ones are
verified on the shingles of both passages: Jaccard of 0.8 or more, of all or else of the longest stretches that have it.

classes() gives the components of these pairs, one row for each document, without laying out all pairs: a spanning forest of each
signature is verified, and then every similar pair that this leaves in different classes.

Passages within one row only are none. Nulls, empty texts and texts under fifty words have no window, and an empty table gives
an empty one. Rows that repeat an id and text are one document; rows of one id and different texts are documents of that id, each with its own text. Very long
texts are whole. Of ties the smaller id is the first. Columns other than the id and the text are not read. Ids are integers; null ids take no part."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import arrow_sized, bitmap, in_bitmap, row_key, sliced, small_enough, stored
from newsloom.operators.components import components

WORDS, SPAN, RUN, SIMILARITY = 5, 46, 21, 0.8
SIDE = RUN // 2
NEED = 41  # of SPAN shingles, to be of similarity 0.8
SMALL, HOT, BLOCK = 16, 1_000, 256
_SALTS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD]  # fixed values: odd multipliers


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(salt)
        return (x ^ (x >> np.uint64(29))) * np.uint64(salt | 1)


class Shingles:
    """The shingle hashes of texts, one after the other; where each text begins; how many it has; and whose each is."""

    def __init__(self, texts: list[bytes | None]):
        found = [(t or b"").lower().split() for t in texts]
        words = pa.array([w for f in found for w in f], pa.large_binary()).dictionary_encode()
        h = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)[words.indices.to_numpy()]
        out = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WORDS):
                out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        n_words = np.array([len(f) for f in found], np.int64)
        self.sizes = np.maximum(n_words - WORDS + 1, 0)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(len(found)), self.sizes)
        self.all = _mixed(out[np.arange(len(self.of)) + (np.cumsum(n_words) - n_words - self.starts)[self.of]], _SALTS[5])

    def __getitem__(self, k: int) -> np.ndarray:
        return self.all[self.starts[k] : self.starts[k] + self.sizes[k]]


def least(v: np.ndarray, span: int) -> np.ndarray:
    """The least value of every ``span`` values in a row, by running minima within blocks from both sides."""
    n = len(v) - span + 1
    padded = np.full(-(-len(v) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[span - 1 : span - 1 + n])


def compact_windows(s: Shingles) -> np.ndarray:
    """The places of the least shingles, each of a compact window, in texts of SPAN shingles or more."""
    if len(s.all) < RUN:
        return np.zeros(0, np.int64)
    v = _mixed(s.all, _SALTS[0])
    low = least(v, RUN)
    of = s.of[: len(low)]
    fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (of[1:] != of[:-1])))
    first = np.flatnonzero(fresh & (of == s.of[RUN - 1 :]) & (s.sizes[of] >= SPAN))
    parts = [f + (v[f[:, None] + np.arange(RUN)] == low[f][:, None]).argmax(1) for f in np.array_split(first, 1 + len(first) // (1 << 15))]
    return np.unique(np.concatenate(parts))


def signatures(s: Shingles, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, centre): of each window the hash of its least shingle and the SIDE shingles after it, and the same before it."""
    out = []
    for way, salt in ((1, 1), (-1, 2)):
        there = centre - s.starts[s.of[centre]] + way * SIDE
        at = centre[(there >= 0) & (there < s.sizes[s.of[centre]])]
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SIDE + 1):
                h = h * np.uint64(_SALTS[3]) + s.all[at + way * k]
        out.append((_mixed(h, _SALTS[salt]), at))
    return np.concatenate([h for h, _ in out]), np.concatenate([at for _, at in out])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text): the signatures, each once for each text."""
    for batch in sliced(batches):
        s = Shingles(batch.column(0).cast(pa.binary()).to_pylist())
        sig, at = signatures(s, compact_windows(s))
        order = np.lexsort((sig, s.of[at]))
        sig, of = sig[order], s.of[at][order]
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (of[1:] != of[:-1]))) if len(sig) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(sig[fresh].view(np.int64))], ["sig"])


def _windows(wanted: Broadcast, hot: Broadcast | None) -> Callable:
    """Batches of (doc_id, row, text): the windows whose signature is in the one bitmap, and whether it is in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.arange(-SPAN, SPAN + 1)
        for batch in sliced(batches):
            ids, rows = (batch.column(k).to_numpy() for k in (0, 1))
            s = Shingles(batch.column(2).cast(pa.binary()).to_pylist())
            every, places = signatures(s, compact_windows(s))
            keep = in_bitmap(wanted.value, every)
            every, places = every[keep], places[keep]
            for part in range(0, len(places), 1 << 14):
                sig, at = every[part : part + (1 << 14)], places[part : part + (1 << 14)]
                of = s.of[at]
                low, high = s.starts[of], s.starts[of] + s.sizes[of]
                place = at[:, None] + around
                there = (place >= low[:, None]) & (place < high[:, None])
                content = np.where(there, (s.all[np.clip(place, 0, len(s.all) - 1)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                x = np.array(list(map(xxhash.xxh64_intdigest, content)), np.uint64)
                sketch = np.where(there, (content >> np.uint32(8)).astype(np.uint8) | np.uint8(1), np.uint8(0))
                hi = np.minimum(at + SPAN, high - 1) - low
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(x.view(np.int64)), pa.array(ids[of]), pa.array(rows[of]), pa.array((at - low).astype(np.int32)), pa.array(hi.astype(np.int32)), _binary(sketch), pa.array(in_bitmap(hot.value, sig) if hot is not None else np.zeros(len(sig), bool))], ["sig", "x", "doc_id", "row", "c", "hi", "sk", "hot"])

    return run


def _binary(sketch: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(sketch)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, data.size + 1, 2 * SPAN + 1, dtype=np.int32)), pa.py_buffer(data)])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, 2 * SPAN + 1)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For sketches laid on each other, row by row, the most shingles of one stretch of SPAN that are met in the other."""
    same = a == b
    same[:, 1:] |= a[:, 1:] == b[:, :-1]
    same[:, :-1] |= a[:, :-1] == b[:, 1:]
    same &= a > 0
    sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
    return (sums[:, SPAN:] - sums[:, :-SPAN]).max(1)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches laid on each other, row by row, are similar, counted on either one."""
    found = shared(a, b)
    out, near = found >= NEED, np.flatnonzero((found < NEED) & (found >= NEED - WORDS))
    if len(near):
        out[near] = shared(b[near], a[near]) >= NEED
    return out


def _forest(sketches: np.ndarray) -> list[tuple[int, int]]:
    """The links among sketches: all pairs that are similar."""
    out = []
    for x in range(len(sketches) - 1):
        rest = sketches[x + 1 :]
        out += [(x, x + 1 + int(y)) for y in np.flatnonzero(similar(np.broadcast_to(sketches[x], rest.shape), rest))]
    return out


def _links_of(sig: np.ndarray, x: np.ndarray, doc: np.ndarray, row: np.ndarray, c: np.ndarray, hi: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
    """The links among whole signatures, given in the order of signature, x, doc_id and row."""
    n = len(sig)
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (x[1:] != x[:-1]))) if n else np.zeros(0, bool)
    one = np.flatnonzero(new)  # the first of each class
    of = np.cumsum(new) - 1
    member = np.flatnonzero(row != row[one[of]]) if n else one
    other = np.full(len(one), -1)  # one of each class that is not of the first's row
    other[of[member[::-1]]] = member[::-1]
    again = np.flatnonzero((row == row[one[of]]) & ~new & (other[of] >= 0))  # other places in the first's row
    pairs = [np.stack((member, one[of[member]]), 1), np.stack((again, other[of[again]]), 1)]
    equal = len(member) + len(again)
    starts = np.flatnonzero(np.concatenate(([True], sig[one][1:] != sig[one][:-1]))) if n else one
    sizes = np.diff(np.append(starts, len(one)))
    left = np.repeat(sizes, sizes) - (np.arange(len(one)) - np.repeat(starts, sizes))  # classes from here on
    left[np.repeat(sizes > SMALL, sizes)] = 0
    near = []
    for step in range(1, SMALL):
        at = np.flatnonzero(left > step)
        for part in np.array_split(at, 1 + len(at) // 20_000):
            part = part[similar(sk[one[part]], sk[one[part + step]])]
            near.append(np.stack((part, part + step), 1))
    for k in np.flatnonzero(sizes > SMALL):
        near.append(np.array(_forest(sk[one[starts[k] : starts[k] + sizes[k]]]), np.int64).reshape(-1, 2) + starts[k])
    a, b = (np.concatenate([p[:, k] for p in near]) for k in (0, 1))
    i, j = one[a], one[b]
    j = np.where((row[i] == row[j]) & (other[b] >= 0), other[b], j)
    i = np.where((row[i] == row[j]) & (other[a] >= 0), other[a], i)
    pairs.append(np.stack((i, j), 1)[row[i] != row[j]])
    i, j = np.concatenate(pairs).T
    return pa.RecordBatch.from_arrays([*(pa.array(v[k]) for k in (i, j) for v in (doc, row, c, hi)), pa.array(np.arange(len(i)) < equal)], ["doc_id", "row", "c", "hi", "other_id", "other", "oc", "ohi", "equal"])


_LINK = "doc_id long, row long, c int, hi int, other_id long, other long, oc int, ohi int, equal boolean"


def _trees_of(sig: np.ndarray, x: np.ndarray, doc: np.ndarray, row: np.ndarray, c: np.ndarray, hi: np.ndarray, sk: np.ndarray, whole: bool = False) -> pa.RecordBatch:
    """A spanning forest of the classes of whole signatures, given in the order of signature and x: each class with the one that it hangs on, the rows of
    which are null for a root. Sketches go with trees of three classes or more, where further pairs are similar; trees of one are left out.
    Before them, without a signature, the rows that are equal to the first of their class. ``whole``: every class, with its sketch."""
    n = len(sig)
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (x[1:] != x[:-1]))) if n else np.zeros(0, bool)
    one = np.lexsort((c, row, doc, x, sig))[np.flatnonzero(new)]  # the first of each class
    of = np.cumsum(new) - 1
    apart = np.flatnonzero(row != row[one[of]])
    equal = np.unique(np.stack((row[apart], row[one[of[apart]]]), 1), axis=0)
    one = one[np.lexsort((row[one], doc[one], sig[one]))]
    starts = np.flatnonzero(np.concatenate(([True], sig[one][1:] != sig[one][:-1]))) if n else one
    sizes = np.diff(np.append(starts, len(one)))
    tree = np.arange(len(one))
    first, up = np.repeat(starts, sizes), np.full(len(one), -1)
    rest = np.flatnonzero(first != tree)
    for part in np.array_split(rest, 1 + len(rest) // 20_000):  # all on the first of the signature
        part = part[similar(sk[one[first[part]]], sk[one[part]])]
        up[part] = tree[part] = first[part]
    for k in np.unique(first[rest[up[rest] < 0]]):  # then each on one of those that hang already
        group = np.arange(k + 1, k + sizes[np.searchsorted(starts, k)])
        root, left, queue = k, group[up[group] < 0], group[up[group] >= 0].tolist()
        while len(left):
            if not queue:
                root, left, queue = left[0], left[1:], [left[0]]
            at = queue.pop(0)
            hit = similar(np.broadcast_to(sk[one[at]], (len(left), sk.shape[1])), sk[one[left]])
            up[left[hit]], tree[left[hit]] = at, root
            queue += left[hit].tolist()
            left = left[~hit]
    count = np.bincount(tree, minlength=len(one))[tree]
    kept = np.flatnonzero((up >= 0) | (count > 2) | whole)
    i, none = one[kept], up[kept] < 0
    j = one[np.maximum(up[kept], 0)]
    e, blank = len(equal), pa.nulls
    with_sk = pc.if_else(pa.array((count[kept] > 2) | whole), _binary(sk[i]), pa.scalar(None, pa.binary()))
    columns = [
        (blank(e, pa.int64()), pa.array(sig[i])), (blank(e, pa.int64()), pa.array(x[one[tree[kept]]])), (blank(e, pa.int64()), pa.array(x[i])), (blank(e, pa.int64()), pa.array(doc[i])),
        (pa.array(equal[:, 0]), pa.array(row[i])), (blank(e, pa.int32()), pa.array(c[i])), (blank(e, pa.int32()), pa.array(hi[i])), (blank(e, pa.int64()), pa.array(doc[j], mask=none)),
        (pa.array(equal[:, 1]), pa.array(row[j], mask=none)), (blank(e, pa.int32()), pa.array(c[j], mask=none)), (blank(e, pa.int32()), pa.array(hi[j], mask=none)), (blank(e, pa.binary()), with_sk),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in columns], ["sig", "tree", "x", "doc_id", "row", "c", "hi", "other_id", "other", "oc", "ohi", "sk"])


_TREE = "sig long, tree long, x long, doc_id long, row long, c int, hi int, other_id long, other long, oc int, ohi int, sk binary"


def _brought_together(batches: Iterator[pa.RecordBatch], of: Callable = _links_of) -> Iterator[pa.RecordBatch]:
    """Batches of windows in the order of signatures, none of which is of many rows, as ``of`` has them."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(k).to_numpy() for k in range(6)] + [_sketches(batch.column(6))]
        rest = [np.concatenate(both) for both in zip(rest, now, strict=True)] if rest else now
        cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0  # the last signature may go on
        if cut:
            yield of(*(r[:cut] for r in rest))
            rest = [r[cut:] for r in rest]
    if rest:
        yield of(*rest)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (sig, block, x, own, sk, blocks of others' sketches): which are similar, as (sig, block, x, own, nth)."""
    for batch in batches:
        sk, rows = _sketches(batch.column(4)), []
        for k, block in enumerate(batch.column(5).to_pylist()):
            others = np.frombuffer(b"".join(block), np.uint8).reshape(-1, sk.shape[1])
            rows += [(k, int(j)) for j in np.flatnonzero(similar(others, np.broadcast_to(sk[k], others.shape)))]
        at = pa.array([k for k, _ in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(4)), pa.array([j for _, j in rows], pa.int32())], ["sig", "block", "x", "own", "nth"])


def _quads(sig: pa.Array, sketches: pa.Array) -> np.ndarray:
    """For each class the keys, of signature and content, of each four shingles of the sketch in a row; 0 where there are not four."""
    sk = _sketches(sketches).astype(np.uint64)
    quad = (sk[:, :-3] << np.uint64(24)) | (sk[:, 1:-2] << np.uint64(16)) | (sk[:, 2:-1] << np.uint64(8)) | sk[:, 3:]
    with np.errstate(over="ignore"):
        key = _mixed(_mixed(sig.to_numpy().view(np.uint64), _SALTS[4])[:, None] + quad, _SALTS[3])
    return np.where((sk[:, :-3] > 0) & (sk[:, 3:] > 0), key | np.uint64(1), np.uint64(0))


def _quads_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (sig, sk) of classes: the keys of its quads, each once for each class."""
    for batch in batches:
        key = np.sort(_quads(batch.column(0), batch.column(1)), axis=1)
        fresh = key > 0
        fresh[:, 1:] &= key[:, 1:] != key[:, :-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[fresh].view(np.int64))], ["key"])


def _able(common: Broadcast) -> Callable:
    """Batches of classes, the first column sig and the last sk: those of which enough content may occur in a second class of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _quads(batch.column(0), batch.column(batch.num_columns - 1))
            sums = np.cumsum(np.pad(in_bitmap(common.value, key) & (key > 0), ((0, 0), (1, 0))), axis=1)
            yield batch.filter(pa.array((sums[:, SPAN - 3 :] - sums[:, : 3 - SPAN]).max(1) >= SPAN - 3 - 8))

    return run


def _asking(classes: DataFrame) -> DataFrame:
    """Of the stored classes of hot signatures, the first column sig and the last sk, those that may be similar to another."""
    common = classes.select("sig", "sk").mapInArrow(_quads_once, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return stored(classes.mapInArrow(_able(bitmap(common)), classes.schema))


def _hot_links(windows: DataFrame) -> DataFrame:
    """The links among the windows of hot signatures, none of which is brought together."""
    who = F.struct("doc_id", "row", "c", "hi")
    classes = stored(windows.groupBy("sig", "x").agg(F.min(who).alias("one"), F.max(who).alias("other"), F.first("sk").alias("sk")))
    differ = lambda a, b: F.col(f"{a}.row") != F.col(f"{b}.row")
    first = F.when(F.col("row") != F.col("one.row"), F.col("one")).when(differ("other", "one") & (F.col("c") != F.col("one.c")), F.col("other"))
    members = windows.join(classes.select("sig", "x", "one", "other"), ["sig", "x"]).withColumn("o", first).where("o IS NOT NULL").select("doc_id", "row", "c", "hi", "o", F.lit(True).alias("equal"))
    found = members
    asking = _asking(classes)
    if not asking.isEmpty():
        sizes = asking.groupBy("sig").agg(F.count(F.lit(1)).alias("asking"))
        asking = stored(asking.join(sizes, "sig").withColumn("own", F.expr(f"CAST(pmod(xxhash64(x), 1 + asking div {BLOCK}) AS INT)")).drop("asking"))
        blocks = stored(asking.groupBy("sig", F.col("own").alias("block")).agg(F.array_sort(F.collect_list(F.struct("x", "sk", "one", "other"))).alias("b")))
        # Each class is laid on the blocks up to its own: a pair is met once, or in one block twice.
        laid = asking.select("sig", "x", "own", "sk", F.explode(F.sequence(F.lit(0), "own")).alias("block")).join(blocks.select("sig", "block", F.col("b.sk").alias("others")), ["sig", "block"])
        hits = laid.select("sig", "block", "x", "own", "sk", "others").mapInArrow(_compared, "sig long, block int, x long, own int, nth int")
        met = hits.withColumnRenamed("x", "cx").join(blocks, ["sig", "block"]).select("sig", "cx", "own", "block", F.expr("b[nth]").alias("w")).where("block < own OR w.x < cx").select("sig", "cx", "w.one", "w.other")
        # Of two classes the first windows, or else others, that are of different rows.
        pair = F.when(differ("one", "o_one"), F.struct(F.col("one").alias("a"), F.col("o_one").alias("o"))).when(differ("one", "o_other"), F.struct(F.col("one").alias("a"), F.col("o_other").alias("o"))).when(differ("other", "o_one"), F.struct(F.col("other").alias("a"), F.col("o_one").alias("o")))
        linked = met.join(asking.select("sig", F.col("x").alias("cx"), F.col("one").alias("o_one"), F.col("other").alias("o_other")), ["sig", "cx"]).select(pair.alias("p")).where("p IS NOT NULL")
        found = members.unionByName(linked.select("p.a.*", "p.o", F.lit(False).alias("equal")))
    return found.select("doc_id", "row", "c", "hi", F.col("o.doc_id").alias("other_id"), F.col("o.row").alias("other"), F.col("o.c").alias("oc"), F.col("o.hi").alias("ohi"), "equal")


def _joined(links: DataFrame, by: list[str]) -> DataFrame:
    """Intervals (lo, hi) of one key that overlap or touch, as one."""
    before = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    fresh = links.withColumn("fresh", F.when(F.col("lo") <= F.max("hi").over(before) + 1, 0).otherwise(1))
    return fresh.withColumn("nth", F.sum("fresh").over(upto)).groupBy(*by, "nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("nth")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (wanted, text): the shingles, in 32 bits, of each wanted passage."""
    for batch in sliced(batches):
        s = Shingles(batch.column(1).cast(pa.binary()).to_pylist())
        small = (s.all >> np.uint64(32)).astype(np.uint32).view(np.int32)
        lists = batch.column(0)
        of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        wanted = lists.flatten()
        lo, hi = (wanted.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi"))
        before = (lo < 0).astype(np.int64)  # a word left out before: the diagonal begins one before the text
        n = np.maximum(np.minimum(hi, s.sizes[of] - 1) - np.maximum(lo, 0) + 1, 0) + before
        upto = np.concatenate(([0], np.cumsum(n)))
        place = np.arange(upto[-1]) - np.repeat(upto[:-1] - (s.starts[of] + np.maximum(lo, 0) - before), n)
        values = small[np.maximum(place, 0)] if len(small) else np.zeros(len(place), np.int32)
        values[upto[:-1][(before > 0) & (n > 0)]] = 0
        yield pa.RecordBatch.from_arrays([wanted.field("link"), wanted.field("side"), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values))], ["link", "side", "s"])


def _dense(hit: np.ndarray, span: int, need: int) -> list[tuple[int, int]]:
    """The joined stretches of ``span`` positions that hold ``need`` hits, each cut to its first and last hit."""
    if len(hit) < span:
        return []
    sums = np.concatenate(([0], np.cumsum(hit)))
    good = np.flatnonzero(sums[span:] - sums[:-span] >= need)
    out = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
        inside = np.flatnonzero(hit[run[0] : run[-1] + span]) + run[0]
        out.append((int(inside[0]), int(inside[-1])))
    return out


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    both = len(x & y)
    return both / max(1, len(x) + len(y) - both)


def _in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` are in ``b``; of short arrays, for which np.isin takes long."""
    return np.fromiter(map(set(b.tolist()).__contains__, a.tolist()), bool, len(a))


def _stretches(a: np.ndarray, b: np.ndarray, lo: int, hi: int, similarity: float, span: int) -> Iterator[tuple[int, int, int, int, float]]:
    """Where a[lo : hi + 1] is not similar enough as a whole: from each window of ``span`` that is, on the diagonal or beside it, as far as that holds."""
    x = lo
    while x + span <= hi + 1:
        best = max(((_jaccard(a[x : x + span], b[x + d : x + d + span]), -abs(d), d) for d in (0, -1, 1) if 0 <= x + d <= len(b) - span), default=(0.0, 0, 0))
        if best[0] < similarity:
            x += 1
            continue
        y, d, kept = x + span - 1, best[2], best[0]
        while y < hi and y + 1 + d < len(b) and (now := _jaccard(a[x : y + 2], b[x + d : y + 2 + d])) >= similarity:
            y, kept = y + 1, now
        yield x, y, x + d, y + d, kept
        x = y + 1


def passages(a: np.ndarray, b: np.ndarray, similarity: float, span: int = SPAN) -> list[tuple[int, int, int, int, float]]:
    """The passages (first and last in a, first and last in b, Jaccard) of two aligned stretches that are similar enough."""
    out = []
    need = int(np.ceil(2 * span * similarity / (1 + similarity)))
    for lo, hi in _dense(_in(a, b), span, need):
        there = np.flatnonzero(_in(b, a[lo : hi + 1]))
        options = [(lo, min(hi, len(b) - 1)), (int(there[0]), int(there[-1]))]  # on the diagonal, or wherever its shingles lie
        best = max(((_jaccard(a[lo : hi + 1], b[x : y + 1]), x, y) for x, y in options if y >= x), default=(0.0, 0, 0))
        if best[0] >= similarity:
            out.append((lo, hi, best[1], best[2], best[0]))
        else:
            out += _stretches(a, b, lo, hi, similarity, span)
    return out


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        lists = batch.column(1)
        flat = lists.flatten()
        upto = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sides, inner = flat.field("side").to_numpy(), flat.field("s")
        cut, data = inner.offsets.to_numpy() - inner.offsets[0].as_py(), inner.flatten().to_numpy(zero_copy_only=False)
        for k, link in enumerate(batch.column(0).to_pylist()):
            by = {int(sides[i]): data[cut[i] : cut[i + 1]] for i in range(upto[k], upto[k + 1])}
            if len(by[0]) >= SPAN and np.array_equal(by[0], by[1]):
                rows.append((link, 0, len(by[0]) - 1, 0, len(by[0]) - 1, 1.0))
            else:
                rows += [(link, *x) for x in passages(by[0], by[1], similarity)]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:5]), pa.array(columns[5], pa.float64())], ["link", "a0", "a1", "b0", "b1", "similarity"])


def _found_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of rows (doc_id, row, text): the windows of signatures that are not hot, each signature in one partition and in order, and those of hot ones, if there are any."""
    arrow_sized(docs.sparkSession)
    counted = stored(docs.select("text").mapInArrow(_signed, "sig long").repartition("sig").groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = counted.where(f"n > {HOT}").select("sig")
    many = not hot.isEmpty()
    again, over = bitmap(counted.select("sig")), bitmap(hot) if many else None
    windows = docs.mapInArrow(_windows(again, over), "sig long, x long, doc_id long, row long, c int, hi int, sk binary, hot boolean")
    windows = stored(windows) if many else windows
    dealt = windows.where("NOT hot").drop("hot").repartition("sig").sortWithinPartitions("sig", "x", "doc_id", "row", "c")
    return dealt, windows.where("hot").drop("hot") if many else None


def links(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, row, text): windows (doc_id, row, c, hi) laid on others (other_id, other, oc, ohi) of another row; equal: whether
    they are equal all around, or else have similar sketches. hi: the last shingle around."""
    dealt, hot = _found_windows(docs)
    found = dealt.mapInArrow(_brought_together, _LINK)
    return found.unionByName(_hot_links(hot)) if hot is not None else found


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))


def _intervals(found: DataFrame) -> DataFrame:
    """Links as intervals (lo, hi) of one pair, diagonal (shift) and kind (equal), joined where they touch; link: their key."""
    # A pair is named once, from the side of the larger id.
    turned = F.struct("other_id", "other") > F.struct("doc_id", "row")
    side = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    found = found.select(side("doc_id", "other_id").alias("doc_id"), side("row", "other").alias("row"), side("c", "oc").alias("c"), side("other_id", "doc_id").alias("other_id"), side("other", "row").alias("other"), side("oc", "c").alias("oc"), side("hi", "ohi").alias("hi"), "equal")
    found = found.withColumns({"shift": F.col("c") - F.col("oc"), "lo": F.greatest(F.lit(0), F.col("c") - SPAN, F.col("c") - F.col("oc") - F.when(F.col("equal"), 0).otherwise(1)), "hi": F.col("hi") + F.when(F.col("equal"), 0).otherwise(1)})
    by = ["doc_id", "row", "other_id", "other", "shift", "equal"]
    return stored(_joined(found.select(*by, "lo", "hi").repartition(*by), by).withColumn("link", F.xxhash64("row", "other", "shift", "lo")))


def _close(found: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of stored intervals the passages (link, a0, a1, b0, b1, similarity) that are similar enough, by the shingles of both texts."""
    sides = found.select("link", F.explode(F.array(F.struct(F.col("row").alias("d"), F.lit(0).alias("side"), "lo", "hi"), F.struct(F.col("other").alias("d"), F.lit(1).alias("side"), (F.col("lo") - F.col("shift")).alias("lo"), (F.col("hi") - F.col("shift")).alias("hi")))).alias("x")).select(F.col("x.d").alias("d"), F.struct("link", "x.side", "x.lo", "x.hi").alias("want"))
    # A document's wanted passages are in lists of about 256, so that a document that many are laid against is several rows.
    many = stored(sides.groupBy("d").agg(F.count(F.lit(1)).alias("n")))
    dealt = sides.join(many, "d").withColumn("part", F.expr("pmod(xxhash64(want.link), n div 256 + 1)"))
    wanted = stored(dealt.groupBy("d", "part").agg(F.collect_list("want").alias("wanted")).select("d", "wanted"))
    needed = wanted.select(F.col("d").alias("row")).distinct()
    own = texts.select("row", "text").join(F.broadcast(needed), "row", "left_semi") if small_enough(needed, 40) else texts.select("row", "text")  # fewer texts to shuffle while their keys are few
    parts = wanted.join(own.dropDuplicates(["row"]), F.col("d") == F.col("row")).select("wanted", "text").mapInArrow(_slices, "link long, side int, s array<int>")
    both = parts.groupBy("link").agg(F.collect_list(F.struct("side", "s")).alias("p")).where("size(p) = 2")  # two by construction
    return both.mapInArrow(lambda b: _verified(b, similarity), "link long, a0 int, a1 int, b0 int, b1 int, similarity double")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of passages: doc_id, first_word, last_word, other_id, other_first_word, other_last_word, similarity.

    Of equal passages each is laid on the first one (similarity 1), and first ones on each other where they are similar."""
    texts = _rows(docs, id_col, text_col)
    every = _intervals(links(texts))
    there = F.col("lo") - F.col("shift")
    equal = every.where("equal").select("doc_id", F.col("lo").alias("first_word"), (F.col("hi") + WORDS - 1).alias("last_word"), "other_id", there.alias("other_first_word"), (there + F.col("hi") - F.col("lo") + WORDS - 1).alias("other_last_word"), F.lit(1.0).alias("similarity"))
    found = every.where("NOT equal")
    near = found.join(_close(found, texts, similarity), "link").select("doc_id", (F.col("lo") + F.col("a0")).alias("first_word"), (F.col("lo") + F.col("a1") + WORDS - 1).alias("last_word"), "other_id", (there + F.col("b0")).alias("other_first_word"), (there + F.col("b1") + WORDS - 1).alias("other_last_word"), F.round("similarity", 6).alias("similarity"))
    return equal.where(f"last_word - first_word >= {SPAN + WORDS - 2}").unionByName(near)


def both_sides(found: DataFrame) -> DataFrame:
    """The rows of repeats(), each also as seen from the other document, so that every document with a passage has a row."""
    names = ["doc_id", "first_word", "last_word"]
    others = ["other_id", "other_first_word", "other_last_word"]
    seen = [F.struct(*(F.col(x).alias(n) for x, n in zip(side, names + others, strict=True))) for side in (names + others, others + names)]
    return found.select(F.explode(F.array(*seen)).alias("p"), "similarity").select("p.*", "similarity")


def _hot_trees(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As _trees_of() has them, the equal rows and a forest of the classes of hot signatures; and the classes that may be similar to others, for _across().

    Classes are dealt into blocks of about HOT, and the roots of their trees again, while that leaves half of them or fewer."""
    classes = stored(windows.groupBy("sig", "x").agg(F.min(F.struct("doc_id", "row", "c", "hi")).alias("one"), F.first("sk").alias("sk")).select("sig", "x", "one.*", "sk"))
    equal = windows.select("sig", "x", "row").join(classes.select("sig", "x", F.col("row").alias("other")), ["sig", "x"]).where("row <> other").select("row", "other")
    found = [stored(equal)]
    asking = level = _asking(classes)
    n = level.count()
    while n:
        sizes = F.broadcast(stored(level.groupBy("sig").agg((1 + F.expr(f"count(*) div {HOT}")).alias("blocks"))))  # of hot signatures only
        keyed = level.join(sizes, "sig").select(F.expr("xxhash64(sig, pmod(xxhash64(x), blocks))").alias("sig"), "x", "doc_id", "row", "c", "hi", "sk")
        trees = stored(keyed.repartition("sig").sortWithinPartitions("sig", "x").mapInArrow(lambda b: _brought_together(b, lambda *w: _trees_of(*w, whole=True)), _TREE))
        found.append(trees.where("other IS NOT NULL").drop("sk"))
        keys = sizes.where("blocks > 1").select(F.col("sig").alias("of"), F.explode(F.expr("transform(sequence(0, blocks - 1), k -> xxhash64(sig, k))")).alias("sig"))
        level = trees.where("other IS NULL").join(F.broadcast(keys), "sig").select(F.col("of").alias("sig"), "x", "doc_id", "row", "c", "hi", "sk")
        before, n = n, level.count()
        if 2 * n > before:
            break
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), asking


def _across(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """All similar pairs of classes of one group (g, x, doc_id, row, c, hi, sk) of which the rows are of different labels, as links.

    In a group those of its commonest label aren't laid on each other; the others are laid on all, in blocks."""
    named = stored(classes.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")))
    counts = stored(named.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n")))
    mixed = stored(counts.groupBy("g").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n")).where("labels > 1").select("g", "n", F.col("most.label").alias("most"), F.col("most.n").alias("n_most")))
    if mixed.isEmpty():
        return mixed.sparkSession.createDataFrame([], _LINK)
    held = F.array_sort(F.collect_list(F.struct("x", "doc_id", "row", "c", "hi", "label", "sk")))
    there = stored(named.join(mixed, "g"))
    ours = there.where("label <> most").groupBy("g", F.expr(f"pmod(xxhash64(x), 1 + (n - n_most) div {BLOCK})").alias("block")).agg(held.alias("a"))
    every = there.groupBy("g", F.expr(f"pmod(xxhash64(x, 1), 1 + n div {BLOCK})").alias("block")).agg(held.alias("b"))
    return stored(ours.drop("block").join(every.drop("block"), "g").select("a", "b").mapInArrow(_laid_across, _LINK))


def _laid_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of two lists of classes: the links between similar ones of different labels."""
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = (pa.array(batch.column(i)[k].values) for i in (0, 1))
            (la, sa), (lb, sb) = ((v.field("label").to_numpy(), _sketches(v.field("sk"))) for v in (a, b))
            at = [np.stack((np.full(len(hit), i), hit), 1) for i in range(len(la)) if len(hit := (o := np.flatnonzero(lb != la[i]))[similar(np.broadcast_to(sa[i], (len(o), sa.shape[1])), sb[o])])]
            i, j = np.concatenate([np.zeros((0, 2), np.int64), *at]).T
            yield pa.RecordBatch.from_arrays([*(v.field(name).take(pa.array(p)) for v, p in ((a, i), (b, j)) for name in ("doc_id", "row", "c", "hi")), pa.array(np.zeros(len(i), bool))], ["doc_id", "row", "c", "hi", "other_id", "other", "oc", "ohi", "equal"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, class_id (the smallest id reachable by pairs of similar passages, its own included; null for a null id).

    The classes are those of all pairs, without all pairs being laid out: of each signature a spanning forest of what is similar is verified first,
    and then every similar pair that this leaves in different classes."""
    texts = _rows(docs, id_col, text_col)
    dealt, hot = _found_windows(texts)
    found = stored(dealt.mapInArrow(lambda b: _brought_together(b, _trees_of), _TREE))
    group = found.where("sk IS NOT NULL").select(F.xxhash64("sig", "tree").alias("g"), "x", "doc_id", "row", "c", "hi", "sk")
    if hot is not None:
        more, asking = _hot_trees(hot)
        found = found.drop("sk").unionByName(more, allowMissingColumns=True)
        group = group.unionByName(asking.withColumnRenamed("sig", "g"))

    def labelled(edges: DataFrame) -> DataFrame:
        """(row, label) of edges (row, other): the least row that each reaches."""
        return stored(components(edges.select(F.lit(0).cast("long").alias("g"), F.col("row").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("row"), F.col("component").alias("label")))

    def verified(links: DataFrame) -> DataFrame:
        every = _intervals(links)
        return every.join(_close(every, texts, similarity).select("link").distinct(), "link", "left_semi").select("row", "other")

    tree = found.where("c IS NOT NULL AND other <> row").select("doc_id", "row", "c", "hi", "other_id", "other", "oc", "ohi", F.lit(False).alias("equal"))
    labels = labelled(found.where("c IS NULL").select("row", "other").unionByName(verified(tree)))
    across = _across(group, labels)
    if not across.isEmpty():
        labels = labelled(labels.select("row", F.col("label").alias("other")).unionByName(verified(across)))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"))
    placed = stored(every.join(labels, "row", "left").select("doc_id", F.coalesce("label", "row").alias("label")))
    return placed.join(placed.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("doc_id", "class_id")
