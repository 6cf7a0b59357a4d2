"""Language identification by prediction by partial matching.

Per language a tree of byte contexts of up to three bytes is counted over a bounded sample of labelled rows, of their whole
texts; a byte's probability comes from the longest context seen, an unseen byte escapes (method C: distinct / (total +
distinct)) to the next shorter one, where the bytes already excluded give up their share. Statistics are frozen, so the code
length of a byte depends on its three predecessors only. What a context adds to the code length of every byte after it (the
escape, less the share of the excluded) and what it takes from that of a byte seen there are values of an n-gram, kept for
seen n-grams alone with the languages that saw them: the model is as large as what was seen in the sample, whatever the number
of languages. A code length is a sum of looked-up values. The language of least total code length over the whole text wins.
The score is its share among the languages when code lengths count as evidence of EVIDENCE bytes at most, as the bytes
of a text are not independent.

A null text, or one without a letter, is ``und`` with score 0; so is any text if nothing was learned. Ties go to the
first language by name, and ties of the draw to id and text. Very long texts are coded whole, in pieces. Other columns are neither read
nor returned. Rows that repeat are judged each by itself. An empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import arrow_sized, checkpointed, small_enough

#: The bound of the training sample: documents for each language. The sample is a hash of the id, so it does not change with the partitions.
SAMPLE_DOCS = 300
ORDER, EVIDENCE = 3, 10
CHUNK = 1 << 19
#: Values of distinct n-grams by language that are held at once.
HELD = 1 << 22


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(lang, text) of at most ``per_language`` documents of each language. docs: doc_id, text, lang."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = checkpointed(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("size")))
    sizes = F.broadcast(sizes) if small_enough(sizes, 80) else sizes  # else the texts would be dealt by language, of which there are few
    drawn = labelled.select("doc_id", "text", "lang", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)).alias("draw")).join(sizes, "lang")
    drawn = drawn.where(F.col("draw") * F.col("size").cast("double") <= F.lit(2.0 * per_language * (1 << 30)))
    drawn = drawn.select("lang", "text", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text")).alias("k")).where(F.col("k") <= per_language)
    return [(r["lang"], r["text"]) for r in drawn.select("lang", "text").collect()]


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Every n bytes in a row, as an integer."""
    out = np.zeros(max(0, len(data) - n + 1), np.int64)
    for k in range(n):
        out = (out << 8) | data[k : k + len(out)]
    return out


def _learned(texts: list[bytes]) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Of one language the bits of a byte in no context, and by order the n-grams seen, what each takes off, the contexts, what each adds."""
    data = np.frombuffer(b"".join(b" " * ORDER + t for t in texts), np.uint8)
    own = np.frombuffer(b"".join(b"\0" * ORDER + b"\1" * len(t) for t in texts), bool)  # the blanks before a text are contexts only
    base, levels = 0.0, []
    shorter, p = np.zeros(0, np.int64), np.zeros(0)
    for k in range(ORDER + 1):
        seen, count = np.unique(_grams(data, k + 1)[own[k:]], return_counts=True)
        contexts, of = np.unique(seen >> 8, return_inverse=True)
        total, distinct = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
        under = p[np.searchsorted(shorter, seen & ((1 << 8 * k) - 1))] if k else np.full(len(seen), 1 / 256)
        left = np.maximum(1 - np.bincount(of, under, len(contexts)), 0)  # for bytes not seen in the context
        none = (left < 1e-9) | (distinct == 256)
        p = count / (total + np.where(none, 0, distinct))[of]
        adds = -np.log2(np.where(none, 1e-9, distinct / (total + distinct) / np.maximum(left, 1e-9)))
        if k:
            levels.append((seen, -np.log2(p / under) - adds[of], contexts, adds))
        else:
            base = 8.0 + float(adds[0]) if len(adds) else 8.0
            levels.append((seen, -np.log2(p / under) - adds[of] if len(adds) else p, contexts[:0], adds[:0]))
        shorter = seen
    return base, levels


class Model:
    """base: bits of a byte in no context, by language; levels: by length of n-gram, the n-grams, where each one's values begin,
    and the values: language, bits as what follows a context, bits as a context."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({x for x, _ in rows})
        found = [_learned([folded(t) for y, t in rows if y == x]) for x in self.languages]
        self.base = np.array([b for b, _ in found])
        self.levels = []
        self.before = np.zeros(len(self.languages), np.float32)  # bits that the blanks before a text add as contexts
        for k in range(1, ORDER + 2):
            key, lang, takes, adds = [], [], [], []
            for at, (_, levels) in enumerate(found):
                seen, off, _, _ = levels[k - 1]
                contexts, more = levels[k][2:] if k <= ORDER else (seen[:0], off[:0])
                both = np.union1d(seen, contexts)
                a, b = np.zeros(len(both), np.float32), np.zeros(len(both), np.float32)
                a[np.searchsorted(both, seen)] = off
                b[np.searchsorted(both, contexts)] = more
                self.before[at] += b[both == int.from_bytes(b" " * k, "big")].sum()
                key.append(both)
                lang.append(np.full(len(both), at, np.int32))
                takes.append(a)
                adds.append(b)
            key, lang, takes, adds = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, lang, takes, adds))
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self.levels.append((keys, np.append(first, len(order)), lang[order], takes[order], adds[order]))

    def _values(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits of each n-gram (of ORDER + 1 bytes) in each language, what it adds as a context included; and that alone."""
        total = np.zeros((len(grams), len(self.languages)), np.float32)
        alone = np.zeros_like(total)
        for k, (keys, first, lang, takes, adds) in enumerate(self.levels, 1):
            g = grams & ((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == g) if len(keys) else np.zeros(0, np.int64)
            at = at[hit]
            sizes = first[at + 1] - first[at]
            place = np.repeat(first[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            cell = np.repeat(hit, sizes), lang[place]  # each once: a language saw an n-gram or did not
            total[cell] += takes[place] + adds[place]
            alone[cell] += adds[place]
        return total, alone

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        n = len(self.languages)
        data = np.frombuffer(b"".join(b" " * ORDER + t for t in texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + ORDER)
        out = sizes[:, None] * self.base + np.where(sizes > 0, 1, 0)[:, None] * self.before
        step = max(8, min(CHUNK, HELD // max(1, n)))
        for low in range(ORDER, len(data), step):
            piece = data[low - ORDER : low + step]
            distinct, which = np.unique(_grams(piece, ORDER + 1), return_inverse=True)
            total, alone = self._values(distinct)
            here = len(which)
            first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(ends - sizes, low + here)
            lo, hi = np.maximum(ends[first:last] - sizes[first:last], low) - low, np.minimum(ends[first:last], low + here) - low
            keep = np.flatnonzero(hi > lo)
            if len(keep):
                edges = np.stack((lo[keep], hi[keep]), 1).reshape(-1)
                rows = np.vstack((total[which], np.zeros((1, n), np.float32)))
                out[first + keep] += np.add.reduceat(rows, edges, axis=0, dtype=np.float64)[::2]
                done = keep[ends[first + keep] - low == hi[keep]]  # a text's last bytes are no context
                out[first + done] -= alone[which[hi[done] - 1]]
        return out


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for each row of ``docs``, learned from ``labelled`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    arrow_sized(spark)
    model = spark.sparkContext.broadcast(Model(sample(labelled, **bounds)))
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            best = np.full(len(texts), len(m.languages))
            score, rate = np.zeros(len(texts)), np.zeros(len(texts))
            if m.languages and texts:
                raw = [folded(t) for t in texts]
                bits = m.lengths(raw)
                known = np.array([any(map(str.isalpha, t)) for t in texts])
                best = np.where(known, bits.argmin(1), best)
                least = bits.min(1)
                size = np.maximum(1, [len(r) for r in raw])
                score = np.where(known, 1 / np.exp2(np.maximum((least[:, None] - bits) * np.minimum(1, EVIDENCE / size)[:, None], -1000)).sum(1), 0)
                rate = least / size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")
