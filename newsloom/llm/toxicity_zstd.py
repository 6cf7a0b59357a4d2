"""Toxicity by compression distance.

Three zstandard dictionaries are made from a bounded sample of labelled rows, of their whole texts. The ordinary one is trained
on windows of ordinary documents. The toxic one holds the same content and, nearest to the text, what zstandard trains on the
pieces of toxic documents that no ordinary document of the sample has (no five bytes of them), each once for each document. A
third, the list, has in that place the segments of toxic documents (words and their beginnings) whose share of toxic
documents is many times their share of ordinary ones; it is an extra feature, for the trained dictionary alone separates less
well (README). A text is cut at blanks into windows; each window is compressed under all three, and only what the toxic
dictionaries add can make a difference. Thresholds on the windows' differences, and the logistic curve from a text's windows
to a probability, are calibrated on whole texts of each third of the sample under dictionaries of the other two thirds.
Texts of the sample that are equal count once for the dictionaries. The sample is bounded by rows, whose whole texts the driver holds.

Null and empty texts have no window and get the score of a text without toxic windows. Very long texts are scored whole, window
by window. If nothing is labelled, or all labels are alike, every score is the share of label 1 (0 without labels). Ties of the
draw go by id, then text. Rows that repeat are scored each by itself; an empty table gives an empty one; other columns are not read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_sized

#: The bound of the sample: documents of label 1 and of label 0.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 2_000, 5_000
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, NOVEL = 128, 16 << 10, 1 << 10, 5
LEAST_SHARE, RATIO = 0.03, 40.0
#: Differences in bytes that count as a toxic window; the calibration weighs them.
STEPS = (2, 4, 7)
_WORD = regex.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").split())


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """The text cut at the first blank after every ``size`` bytes; a long run without blanks is cut hard."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + size, at + 4 * size)
        end = (end if end >= 0 else min(len(data), at + 4 * size)) if at + size < len(data) else len(data)
        out.append(data[at:end])
        at = end
    return out


def segments(data: bytes) -> set[bytes]:
    words = set(_WORD.findall(data))
    return words | {w[:k] for w in words for k in (4, 5, 6, 8, 10) if len(w) > k}


def apart(texts: list[bytes]) -> list[bytes]:
    """Each text once, so that one that is copied doesn't pass for a common way to speak."""
    return list(dict.fromkeys(texts))


def _fives(text: bytes) -> np.ndarray:
    """Every NOVEL bytes in a row, each as an integer."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(data) - NOVEL + 1), np.uint64)
    for k in range(NOVEL):
        out = (out << np.uint64(8)) | data[k : k + len(out)]
    return out


def novel(text: bytes, known: np.ndarray) -> bytes:
    """The pieces of a text of which no five bytes are known, each once."""
    fives = _fives(text)
    there = known[np.minimum(np.searchsorted(known, fives), len(known) - 1)] != fives if len(known) else np.ones(len(fives), bool)
    cover = np.convolve(there, np.ones(NOVEL, int)) > 0 if len(there) else there
    turns = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False])).astype(np.int8)))
    return b"".join(dict.fromkeys(b" " + text[x:y].strip() for x, y in zip(turns[::2], turns[1::2], strict=True)))


def trained(size: int, samples: list[bytes], **how: int) -> bytes:
    """What zstandard trains on the samples; their end if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def segment_list(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    of, against = Counter(), Counter()
    for t in toxic:
        of.update(segments(t))
    for t in ordinary:
        against.update(segments(t))
    share = lambda w: of[w] / len(toxic)
    good = [w for w, c in of.items() if len(w) >= 4 and c >= 3 and share(w) >= LEAST_SHARE and share(w) >= RATIO * (against[w] + 0.5) / len(ordinary)]
    # A beginning gives way to the longer one that nearly always follows it; what a kept beginning begins adds nothing.
    longer: dict[bytes, int] = {}
    for w in good:
        for k in range(4, len(w)):
            longer[w[:k]] = max(longer.get(w[:k], 0), of[w])
    kept: set[bytes] = set()
    for w in sorted((w for w in good if longer.get(w, 0) < 0.9 * of[w]), key=len):
        if not any(w[:k] in kept for k in range(4, len(w))):
            kept.add(w)
    return b" ".join(sorted(kept, key=lambda w: (of[w], w)))


def train(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """The contents of the ordinary dictionary, of the toxic one and of the list."""
    base = trained(ORDINARY_BYTES, [w for t in ordinary for w in windows(t)])
    toxic, ordinary = apart(toxic), apart(ordinary)
    known = np.zeros(0, np.uint64)
    for at in range(0, len(ordinary), 256):
        known = np.unique(np.concatenate([known, *map(_fives, ordinary[at : at + 256])]))
    fresh = [n for n in (novel(t, known) for t in toxic) if n]
    return base, base + b" " + trained(TOXIC_BYTES, fresh, d=6, k=32) + b" ", base + b" " + segment_list(toxic, ordinary) + b" "


class Scorer:
    def __init__(self, contents: tuple[bytes, bytes, bytes], weights: np.ndarray | None):
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=4, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compress = []
        for content in contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
        self.weights = weights

    def features(self, data: bytes) -> list[float]:
        own, *others = ([len(f(w)) for w in windows(data)] or [0] for f in self.compress)
        out = [1.0, np.log(len(own))]
        for other in others:
            gain = np.subtract(own, other)
            up = np.maximum(gain, 0)
            out += [up.max(), np.log1p(up.sum()), np.log1p(np.maximum(gain.mean(), 0) * 10), *(np.log1p((gain >= s).sum()) for s in STEPS), *((gain >= s).mean() for s in STEPS)]
        return out

    def score(self, data: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(data)), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic curve, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str | None, int]]) -> tuple[tuple[bytes, bytes, bytes], np.ndarray | None, float]:
    """Dictionaries from all rows; the curve from each third under dictionaries of the other two. And the share of label 1."""
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    data = [(folded(t), y) for t, y in rows]
    by = {y: [t for t, z in data if z == y] for y in (0, 1)}
    if min(map(len, by.values())) < 3:
        return (b"", b"", b""), None, share
    x, y = [], []
    for fold in range(3):
        scorer = Scorer(train(*([t for i, t in enumerate(by[k]) if i % 3 != fold] for k in (1, 0))), None)
        for k, texts in by.items():
            x += [scorer.features(t) for t in texts[fold::3]]
            y += [k] * len(texts[fold::3])
    return train(by[1], by[0]), logistic(np.array(x), np.array(y, float)), share


def sample(labelled: DataFrame, toxic: int = SAMPLE_TOXIC, ordinary: int = SAMPLE_ORDINARY) -> list[tuple[str | None, int, float]]:
    """(text, label, weight of its class) of at most so many rows of each label, drawn by a hash of the id. labelled: doc_id, text, label."""
    sizes = {r["label"]: r["n"] for r in labelled.where("label IN (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    out = []
    for label, most in ((0, ordinary), (1, toxic)):
        share = min(1.0, 1.3 * most / max(1, sizes.get(label, 0)))
        part = labelled.where((F.col("label") == label) & (draw < share * (1 << 20))).select("text", draw.alias("draw"), "doc_id").orderBy("draw", "doc_id", "text").limit(most).collect()
        out += [(r["text"], label, sizes[label] / max(1, len(part))) for r in part]
    return out


def toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(doc_id, score) of each row of ``docs``, learned from ``labelled`` (doc_id, text, label)."""
    spark = docs.sparkSession
    arrow_sized(spark)
    rows = sample(labelled, **bounds)
    contents, weights, share = fit([(t, y) for t, y, _ in rows])
    if weights is not None:  # the sample holds a larger share of label 1 than the rows: moved back by the prior odds
        of = {y: w for _, y, w in rows}
        weights[0] += np.log(of[1] / of[0])
    model = spark.sparkContext.broadcast((contents, weights, share))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, w, flat = model.value
        scorer = Scorer(contents, w) if w is not None else None
        for batch in batches:
            scores = [scorer.score(folded(t)) if scorer else flat for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
