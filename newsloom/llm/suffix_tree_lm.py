"""Language-model scores by a probabilistic suffix tree over bytes, and the word unigram base.

A text is its words, one blank apart, between two borders (a line feed, which no word holds): its symbols are bytes, and the
border at its end is the end that is scored. The tree grows a byte at a time. Training n-grams of every length are counted
over all training documents: each task adds up what it reads and the sums meet in a shuffle. A context of k bytes is a
candidate if its suffix of k - 1 bytes is a state; it stays a state if it was seen LEAST times and its next symbols diverge
enough from what its suffix predicts: the gain in log-likelihood (count * KL divergence) is one nat or more for each next
symbol that the state has to hold. A state's distribution is smoothed with its suffix's, (c + t * p) / (n + t), where t is the
number of next symbols seen (Witten and Bell). A symbol is scored in the state of the longest suffix that stayed.

So the log-probability of a symbol is that of no context, and for each suffix of its context that is a state what the state
gives back, and what it gains if the symbol was seen there. Both are values of an n-gram, and a score is a sum of looked-up
values. Read backwards, the contexts that an n-gram ends are an interval, so the sum is constant between the ends of intervals and is
looked up at once. The table of values is dealt into parts of a bounded number of rows by a hash of the n-gram; each part is broadcast by
itself and summed over all documents, so a tree of any size is scored, a part at a time. Which n-grams a task counts is told by
a bitmap of states of fixed size: a false positive costs a counted row, which the join with the states drops again.

The base sums word unigrams. Word counts are summed by a 64-bit hash. The commonest words, a fixed number, are broadcast
and looked up where the text is; only other words are dealt to the table of counts, so no hot word is dealt.

A null text is empty: one end. Without training rows every word is unknown and every symbol alike. Rows that repeat are scored
each by itself; ties among common words at the cut are broken by hash; other columns are not read. Very long texts are whole:
they are counted and scored in pieces that overlap. An empty table gives an empty one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_sized, bitmap, in_bitmap, row_key, sliced, stored

#: The longest n-gram: a context of six bytes and the next; up to eight, a 64-bit integer holds it exactly. The first pass counts up to FIRST.
LONGEST, FIRST = 7, 5
LEAST = 8
BORDER = 10
COMMON = 100_000  # words that are broadcast: 1.6 MB
PART = 4_000_000  # values that are broadcast at once: 96 MB as ends of intervals
KEPT = 400_000  # words, and
HELD = 1 << 20  # n-grams of each length, that a task holds before it passes their counts on
CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15  # fixed value: an odd multiplier
_hash = xxhash.xxh64_intdigest
END_WORD = b"\x00 end"  # holds a blank, so no word is equal


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _hashes(words: Collection[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, words), np.uint64, len(words)).view(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c): word counts by hash."""
    counts = Counter()

    def words() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_hashes(counts)), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], ["h", "c"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            counts.update(tokens(text))
            counts[END_WORD] += 1
        if len(counts) > KEPT:
            yield words()
            counts.clear()
    yield words()


def _symbols(texts: list[list[bytes]]) -> np.ndarray:
    """The symbols of texts, given their words, with a border before, between and after them."""
    return np.frombuffer(b"\n" + b"".join(b" ".join(t) + b"\n" for t in texts), np.uint8)


def _pieces(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, piece, reach): pieces of symbols with the LONGEST - 1 before each; the place of the first new one; and how long an
    n-gram that ends at each new symbol can be, a border being only its first or its last."""
    for at in range(1, len(symbols), CHUNK):
        low = max(0, at - LONGEST + 1)
        piece = symbols[low : at + CHUNK]
        reach = np.full(len(piece) + LONGEST, LONGEST, np.int8)
        borders = np.flatnonzero(piece == BORDER)
        for n in range(LONGEST - 1, 0, -1):  # of several borders the nearest counts
            reach[borders + n] = n + 1
        yield at, piece, reach[at - low : len(piece)]


def _words(piece: np.ndarray, n: int, kind: str) -> np.ndarray:
    """For each of the last n symbols the eight bytes that end there, or zeros and as many as there are, as one integer of this kind."""
    return np.ndarray(n, kind, np.concatenate((np.zeros(8, np.uint8), piece)), len(piece) - n + 1, (1,)).astype(np.uint64)


def _grams(piece: np.ndarray, n: int, upto: int) -> np.ndarray:
    """For each of the last n symbols the bytes that end there, ``upto`` of them or as many as there are, as one integer."""
    return _words(piece, n, ">u8") & np.uint64(_mask(min(upto, LONGEST)))


def _backwards(piece: np.ndarray, n: int) -> np.ndarray:
    """For each of the last n symbols it and the LONGEST - 1 before it, the last as the highest byte."""
    return _words(piece, n, "<u8") & np.uint64(_mask(8) - _mask(8 - LONGEST))


def _mask(length: int) -> int:
    return (1 << (8 * length)) - 1


class _Tally:
    """Counts of integers, added up in sorted arrays."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, passing: Callable | None = None) -> bool:
        """Counts those of the keys that pass. Whether there are so many now that they should be passed on."""
        keys, counts = np.unique(keys, return_counts=True)
        if passing is not None:
            keep = passing(keys)
            keys, counts = keys[keep], counts[keep]
        self.held.append((keys, counts))
        self.n += len(self.held[-1][0])
        if self.n > HELD // 2:
            self.settle()
        return len(self.keys) > HELD

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.held)])
        counts = np.concatenate([self.counts, *(c for _, c in self.held)])
        order = np.argsort(keys, kind="stable")  # sorted stretches are merged
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts
        self.held, self.n = [], 0

    def out(self, length: int) -> pa.RecordBatch:
        self.settle()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(self.keys), length, np.int32)), pa.array(self.keys.view(np.int64)), pa.array(self.counts)], ["k", "g", "c"])


def _gram_counts(lengths: list[int], gate: Broadcast | None) -> Callable:
    """(k, g, c): counts of n-grams of these lengths; of those only whose context may have a state as its suffix."""

    def passed_on(tallies: dict[int, _Tally]) -> Iterator[pa.RecordBatch]:
        longer = None
        for k in reversed(lengths):
            if longer is not None:  # their suffixes
                tallies[k].held.append((longer.keys & np.uint64(_mask(k)), longer.counts))
            yield tallies[k].out(k)
            longer, tallies[k] = tallies[k], _Tally()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {k: _Tally() for k in lengths}
        states = gate.value if gate else None
        longest = lengths[-1]
        passing = None if states is None else lambda g: in_bitmap(states, (g >> np.uint64(8)) & np.uint64(_mask(longest - 2)))
        for batch in sliced(batches):
            symbols = _symbols([tokens(t) for t in batch.column(0).cast(pa.binary()).to_pylist()])
            for _, piece, reach in _pieces(symbols):
                whole = _grams(piece, len(reach), longest)
                for k in lengths[:-1]:  # only what no longer one ends with
                    tallies[k].add(whole[reach == k] & np.uint64(_mask(k)))
                if tallies[longest].add(whole[reach >= longest], passing):
                    yield from passed_on(tallies)
        yield from passed_on(tallies)

    return run


def _level(counted: DataFrame, lower: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """From the counts (g, c) of n-grams of length k and the log-probabilities (g, lp) of length k - 1: entries (g, lp, gain), and
    the states (ctx, back), contexts of length k - 1. All logarithms are natural."""
    suffix = F.col("g").bitwiseAND(F.lit(_mask(k - 1)))
    rows = counted.withColumn("suf", suffix).join(lower.select(F.col("g").alias("suf"), "lp"), "suf").select("g", F.shiftrightunsigned("g", 8).alias("ctx"), "c", "lp")
    stats = rows.groupBy("ctx").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("t"), F.sum(F.col("c") * (F.log("c") - F.col("lp"))).alias("s"))
    states = stats.where((F.col("n") >= LEAST) & (F.col("s") - F.col("n") * F.log("n") >= F.col("t"))).select("ctx", "n", "t", F.log(F.col("t") / (F.col("n") + F.col("t"))).alias("back"))
    new = F.log((F.col("c") + F.col("t") * F.exp("lp")) / (F.col("n") + F.col("t")))
    entries = stored(rows.join(states, "ctx").select("g", "ctx", new.alias("lp"), (new - F.col("lp") - F.col("back")).alias("gain"), "back"))
    return entries, entries.groupBy("ctx").agg(F.first("back").alias("back"))


def tree(training: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The log-probabilities of symbols without context, and the values (k, g, value) of n-grams of k bytes: what a symbol
    gains in the state before it, and what the n-gram gives back as a state."""
    spark = training.sparkSession
    count = lambda lengths, gate: stored(training.mapInArrow(_gram_counts(lengths, gate), "k int, g long, c long").repartition("k", "g").groupBy("k", "g").agg(F.sum("c").alias("c")))
    counted = count(list(range(1, FIRST + 1)), None)
    plain = np.full(256, 0.5)
    for r in counted.where("k = 1").collect():  # 256 at most
        plain[r["g"]] += r["c"]
    plain = np.log(plain / plain.sum())
    lower = spark.createDataFrame([(g, float(p)) for g, p in enumerate(plain)], "g long, lp double")
    parts: list[DataFrame] = []
    states = None
    for k in range(2, LONGEST + 1):
        if k > FIRST:
            if states.isEmpty():
                break
            counted = count([k], bitmap(states.select("ctx")))
        entries, states = _level(counted.where(f"k = {k}").select("g", "c"), lower, k)
        parts.append(entries.select(F.lit(k).alias("k"), "g", F.col("gain").alias("value")))
        parts.append(states.select(F.lit(k - 1).alias("k"), F.col("ctx").alias("g"), F.col("back").alias("value")))
        lower = entries
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    return plain, stored(values.groupBy("k", "g").agg(F.sum("value").alias("value")))


class Values:
    """Sums of the values of all n-grams that end at a symbol, by what stands there: read backwards, an n-gram is the first bytes of an
    interval of integers, and the sum changes only where an interval begins or ends. (No n-gram goes on over a border, so nothing is
    told by what stands beyond one.)"""

    def __init__(self, plain: np.ndarray, level: Callable):
        """level: gives the n-grams of a length and their values."""
        at, value = [np.arange(256, dtype=np.uint64) << np.uint64(56)], [np.diff(plain, prepend=0.0).astype(np.float32)]
        self.start = 0.0
        for length in range(1, LONGEST + 1):
            g, v = level(length)
            if length == 1:
                self.start = float(v[g == BORDER].sum())  # what the border gives back as the first context
                g, v = g[g != BORDER], v[g != BORDER]
            first = g.view(np.uint64).byteswap()
            with np.errstate(over="ignore"):
                end = first + np.uint64(1 << (8 * (8 - length)))
            at += [first, end[end > first]]
            value += [v.astype(np.float32), -v[end > first].astype(np.float32)]
        at, value = np.concatenate(at), np.concatenate(value)
        order = np.argsort(at)
        at, value = at[order], value[order]
        del order
        last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
        self.at, self.sums = at[last], np.cumsum(value, dtype=np.float64)[last].astype(np.float32)

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """The sum of values of each text, given its words."""
        symbols = _symbols(texts)
        ends = np.flatnonzero(symbols == BORDER)
        total = np.full(len(texts), self.start)
        for first in range(1, len(symbols), CHUNK):
            n = min(CHUNK, len(symbols) - first)
            there = _backwards(symbols[max(0, first - LONGEST + 1) : first + n], n)
            order = np.argsort(there)
            there = there[order]
            fresh = np.flatnonzero(np.append(True, there[1:] != there[:-1]))  # most occur many times
            sums = np.empty(n, np.float32)
            sums[order] = np.repeat(self.sums[np.searchsorted(self.at, there[fresh], "right") - 1], np.diff(fresh, append=n))
            upto = np.concatenate(([0.0], np.cumsum(sums, dtype=np.float64)))
            low, high = np.clip(ends[:-1] + 1 - first, 0, n), np.clip(ends[1:] + 1 - first, 0, n)
            total += upto[high] - upto[low]
        return total


def _looked_up(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in the sorted table, and whether it is."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_known, train_tokens, base_score, score. learn: which rows train."""
    spark = docs.sparkSession
    arrow_sized(spark)
    training = docs.where(learn).select(F.col(text_col).alias("text"))
    counts = stored(training.mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(size["n"]), int(size["v"])
    below = n + 0.1 * (v + 1)
    border = int(_hashes([END_WORD])[0])
    end = ends[0]["c"] if (ends := counts.where(F.col("h") == border).collect()) else 0
    common = counts.where(F.col("h") != border).orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    order = np.argsort(common["h"].to_numpy())
    known = spark.sparkContext.broadcast((common["h"].to_numpy()[order], common["c"].to_numpy()[order]))

    plain, values = tree(training)
    parts = max(1, -(-values.count() // PART))
    part = F.pmod(F.xxhash64("g"), F.lit(parts))

    def shared(p: int) -> Broadcast:
        def level(k: int) -> tuple[np.ndarray, np.ndarray]:
            found = values.where((F.col("k") == k) & (part == p)).select("g", F.col("value").cast("float")).toArrow()  # of all k about PART rows
            return found["g"].to_numpy(), found["value"].to_numpy()

        return spark.sparkContext.broadcast(Values(plain if p == 0 else np.zeros(256), level))

    kind = docs.schema[id_col].dataType.simpleString()
    held = shared(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hs, cs), table = known.value, held.value
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            found = [tokens(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            if not found:
                continue
            texts = len(found)
            words = [w for f in found for w in f]
            h = _hashes(dict.fromkeys(words))
            words = pa.array(words, pa.large_binary()).dictionary_encode()  # numbered as they are first met
            sizes = np.array([len(f) for f in found], np.int64)
            tok, of = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(texts), sizes)
            at, hit = _looked_up(h, hs)
            base_of = np.where(hit, np.log10((np.where(hit, cs[at], 0) + 0.1) / below), 0.0) if len(cs) else np.zeros(len(h))
            base = np.bincount(of, base_of[tok], texts) + np.log10((end + 0.1) / below)
            n_known = np.bincount(of, hit[tok], texts).astype(np.int64) + (end > 0)
            some = ~hit[tok]  # each text's other words, with their numbers
            each, tf = np.unique(of[some] * (len(h) + 1) + tok[some], return_counts=True)
            upto = np.concatenate(([0], np.cumsum(np.bincount(each // (len(h) + 1), minlength=texts)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x)) for x in (h[each % (len(h) + 1)], tf.astype(np.int32))]
            rows = np.arange(row, row + texts)
            row += texts
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), batch.column(1), pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(table.scores(found)), *lists], ["row", "doc_id", "key", "n_tokens", "n_known", "base", "score", "h", "tf"])

    source = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    scored = stored(source.mapInArrow(run, f"row long, doc_id {kind}, key long, n_tokens long, n_known long, base double, score double, h array<long>, tf array<int>"))
    rare = scored.select("row", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("row", "x.h", "x.tf").join(counts, "h", "left")
    sums = rare.groupBy("row").agg(F.sum(F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / below)).alias("part"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"))
    out = scored.drop("h", "tf").join(sums, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("known", F.lit(0)), "base": F.col("base") + F.coalesce("part", F.lit(0.0))})
    for p in range(1, parts):
        out = out.join(_part_scores(source, shared(p)), "key").withColumn("score", F.col("score") + F.col("more")).drop("more")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("score") / float(np.log(10))).alias("score"))


def _part_scores(source: DataFrame, held: Broadcast) -> DataFrame:
    """(key, more): what a further part of the values adds to the score of the rows of each key, which are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [tokens(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(found))], ["key", "more"])

    return source.select("key", "text").mapInArrow(run, "key long, more double").groupBy("key").agg(F.first("more").alias("more"))
