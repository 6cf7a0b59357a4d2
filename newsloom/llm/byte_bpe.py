"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 of a token's bytes, rank) becomes a vocabulary over the byte-to-character mapping of byte-level BPE,
and merges: every way to cut a token into two tokens, by the token's rank. The pattern cuts a text into pieces; a piece is
merged by itself, so each distinct piece of a worker is merged once and kept (the store is emptied when full). A token's
bytes may begin or end inside a character: offsets then name the character that holds the byte, and decoding joins bytes
before it reads characters, so split characters come back whole.

A null text is empty: no tokens; a null id stays null. Very long texts are one row of ids. Rows that repeat are encoded each by itself. Of two merges of
one rank the first in the text goes first, as in the reference tokenizer. An empty table gives an empty one. Columns other than the id and the text are not read."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_sized

#: Pieces that a worker keeps, and the longest piece kept, in characters.
KEPT, LONGEST_KEPT = 240_000, 64


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Codec:
    def __init__(self, path: str, pattern: str):
        from tokenizers.models import BPE

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.chars = byte_characters()
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        named = {token: "".join(map(self.chars.__getitem__, token)) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
            cuts = sorted((c for c in cuts if c[0] in ranks and c[1] in ranks), key=lambda c: (ranks[c[0]], ranks[c[1]]))
            merges += [(named[a], named[b]) for a, b in cuts]
        self.model = BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.find = regex.compile(pattern).findall
        self.kept: dict[str, tuple[int, ...]] = {}
        self.same = list(range(max(ranks.values(), default=0) + 1))  # one object for each id, however many pieces have it

    def merged(self, piece: str) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        ids = tuple([self.same[t.id] for t in self.model.tokenize("".join(map(self.chars.__getitem__, piece.encode())))])
        if len(piece) <= LONGEST_KEPT:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        kept = self.kept.get
        for piece in self.find(text):
            ids += kept(piece) or self.merged(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each token the index of the character that holds its first byte, and one more than that of its last."""
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        leads = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1  # of each byte, its character
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ids)]
        return leads[starts] if len(ids) else starts, leads[ends - 1] + 1 if len(ids) else ends


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): token ids and their character offsets."""
    arrow_sized(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [c.encode(t) for t in texts]
            spans = [c.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, ints), *(pa.array([s[k] for s in spans], ints) for k in (0, 1))], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, bytes, text): what the ids stand for; bytes that are no character become U+FFFD in the text."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            raw = [c.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw])], ["doc_id", "bytes", "text"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of encoding a text and of decoding its ids again."""
    arrow_sized(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "")
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
