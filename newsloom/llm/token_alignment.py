"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes. The transducer's state is which side leads and the bytes that the other side has yet to match, the
dangling suffix of one token; the lagging side gives the next token, which shortens the suffix, closes the group (empty suffix) or
leads in its turn. Each step is one pair of tokens whose byte ranges overlap, so the steps are the links. Transitions are memoised
by suffix and token, and their runs by chunk of text: the suffix is always empty where a text is cut, before a space after a printing
character, since neither side has tokens across such places. For the pieces that is looked up when they are loaded; with pieces that lack it a text is one
chunk. Byte-level BPE runs in tiktoken, on ranks that are the ids of the given file, whose merges have to be in the order of ids.

The texts are encoded once: a map-only pass stores each text's digest and the pairs of its links. The links of each pair are counted from what is
stored, summed in a shuffle of pairs, and looked up in a second reading of it. The table of pairs is broadcast if its counted rows are few enough;
else each text's pairs meet it in a shuffle join, whose common pairs Spark can split. Texts are never shuffled. Stores of chunks are bounded in bytes, whatever the length of a chunk, and emptied when full.

Texts null or empty, or of which a tokenizer keeps other bytes than space + text (piece tokenizers write a space for U+2581), have no tokens: zeros.
A null id stays null; rows that repeat are aligned each by itself and count each. Very long texts are one row. Ties for the
highest count of a B id all count as best. An empty table gives an empty one. Columns other than the id and the text are not read."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.byte_bpe import byte_characters
from newsloom.llm.common import BROADCAST_BYTES, arrow_sized, sliced, small_enough, stored

#: Bytes, about, of the chunks that a task keeps beside those of the slice at hand; what an entry takes, and for each character of its chunk.
KEPT_BYTES, ENTRY_BYTES, CHARACTER_BYTES = 96 << 20, 340, 20
#: Transitions that a worker keeps, and the longest suffix of a kept one, in bytes.
KEPT, LONGEST_KEPT = 100_000, 64
#: Links that a task counts or looks up at once.
LINKS = 1 << 20
#: Bytes of a row of the broadcast table of pairs: pair, count, whether it is the best.
PAIR_BYTES = 17
#: How byte-level BPE cuts a text before it merges (a fixed pattern of that tokenizer).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A piece that goes on over a space after another character; with one, chunks() would cut inside a token.
CROSSES = re.compile("[^▁]▁")
UNCUT = re.compile(r"\s ")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def chunks(text: str) -> list[str]:
    """space + ``text``, cut before each space that follows a printing character; each chunk without its first space. Joined by spaces they are the text."""
    parts = text.split(" ")
    if UNCUT.search(" " + text) is None:
        return parts
    out, now = [], [parts[0]]
    for part in parts[1:]:
        if now[-1] and not now[-1][-1].isspace():
            out.append(" ".join(now))
            now = []
        now.append(part)
    return [*out, " ".join(now)]


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2

        with open(byte_level, encoding="utf-8") as file:
            told = json.load(file)
        of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"] for t in told["added_tokens"]}
        vocabulary = {t: i for t, i in told["model"]["vocab"].items() if t not in special}
        self.bytes_a = {i: bytes(map(of.__getitem__, t)) for t, i in vocabulary.items()}
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the ids of merged tokens have to follow the order of the merges")
        self.encode_a = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks={b: i for i, b in self.bytes_a.items()}, special_tokens={})._core_bpe.encode_ordinary
        model = sentencepiece_model_pb2.ModelProto()
        with open(pieces, "rb") as file:
            model.ParseFromString(file.read())
        model.normalizer_spec.add_dummy_prefix = False  # the space before a text is part of its first chunk
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.bytes_b = [bytes.fromhex(m[1]) if self.pieces.is_byte(i) and (m := BYTE_PIECE.fullmatch(name)) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.cuts = not any(map(CROSSES.search, names))
        self.text_a, self.text_b = {i: str(i) for i in self.bytes_a}, [str(i) for i in range(len(names))]
        self.steps: dict[tuple[bytes, int], tuple[bool, bytes]] = {}

    def step(self, suffix: bytes, token: bytes, key: int) -> tuple[bool, bytes]:
        """The state after a token of the lagging side: whether that side leads now, and the dangling suffix. Raises ValueError if the bytes differ."""
        if suffix.startswith(token):
            new = (False, suffix[len(token) :])
        elif token.startswith(suffix):
            new = (True, token[len(suffix) :])
        else:
            raise ValueError("other bytes")
        if len(suffix) <= LONGEST_KEPT:
            if len(self.steps) >= KEPT:
                self.steps.clear()
            self.steps[suffix, key] = new
        return new

    def run(self, a: list[int], b: list[int], texts: bool = True) -> tuple[int, int, int, str, list[int]] | None:
        """n_a, n_b, how many groups, these as text (if ``texts``), and the links as a << 32 | b; None if the sides' bytes differ."""
        known, bytes_a, bytes_b, text_a, text_b = self.steps, self.bytes_a, self.bytes_b, self.text_a, self.text_b
        groups, links, i, j, n, m = [], [], 0, 0, len(a), len(b)
        try:
            while i < n:
                from_i, from_j, x, y = i, j, a[i], 0
                suffix, a_leads = bytes_a[x], True
                i += 1
                while suffix:  # an index beyond the end: the other side has bytes that this one lacks
                    if a_leads:
                        y = b[j]
                        j += 1
                        turned, suffix = known.get((suffix, ~y)) or self.step(suffix, bytes_b[y], ~y)
                    else:
                        x = a[i]
                        i += 1
                        turned, suffix = known.get((suffix, x)) or self.step(suffix, bytes_a[x], x)
                    links.append(x << 32 | y)
                    if turned:
                        a_leads = not a_leads
                if not texts:
                    continue
                if i - from_i == 1 and j - from_j == 1:
                    groups.append(text_a[x] + "|" + text_b[y])
                else:
                    groups.append(",".join([text_a[t] for t in a[from_i:i]]) + "|" + ",".join([text_b[t] for t in b[from_j:j]]))
        except (IndexError, ValueError):
            return None
        return (n, m, len(groups), ";".join(groups), links) if j == m else None

    def align(self, chunk: list[str], texts: bool = True) -> list[tuple[int, int, int, str, list[int]] | None]:
        """run() of each chunk."""
        whole = [" " + c for c in chunk]
        return [self.run(self.encode_a(c), b, texts) for c, b in zip(whole, self.pieces.encode(whole, num_threads=1), strict=True)]


@lru_cache(maxsize=2)
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One for each worker process."""
    return Aligner(byte_level, pieces)


class Chunks:
    """A store, bounded in bytes, of what ``told`` says of chunks, filled for a slice of texts at a time."""

    def __init__(self, aligner: Aligner, told, texts: bool = True):
        self.aligner, self.told, self.texts, self.kept, self.older, self.bad = aligner, told, texts, {}, {}, set()
        self.size = 0

    def of(self, texts: list[str | None]) -> list[list[str]]:
        """The chunks of each text; none where the text has no tokens. The store holds them all, and what it held before it was last full may come back.

        It is full beyond half of KEPT_BYTES: then it becomes the older half, of which only what is needed comes back."""
        cut = [(chunks(t) if self.aligner.cuts else [t]) if t else [] for t in texts]
        needed = set().union(*cut)
        if self.size > KEPT_BYTES // 2:
            self.older, self.kept, self.size = self.kept, {}, 0
            self.bad &= self.older.keys()
        missing = [c for c in needed if c not in self.kept]
        back = self.older.keys() & missing
        for c in back:
            self.kept[c] = self.older.pop(c)
        missing = [c for c in missing if c not in back]
        found = self.aligner.align(missing, self.texts)
        self.bad.update(c for c, x in zip(missing, found, strict=True) if x is None)
        self.size += sum(ENTRY_BYTES + CHARACTER_BYTES * len(c) for more in (back, missing) for c in more)
        for c, x in zip(missing, self.told([x or (0, 0, 0, "", []) for x in found]), strict=True):
            self.kept[c] = x
        return [[] if not self.bad.isdisjoint(c) else c for c in cut] if self.bad else cut


def _portions(batches: Iterator[pa.RecordBatch], column: str = "pairs") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about LINKS links, or one text."""
    for batch in batches:
        upto = np.cumsum(batch.column(column).value_lengths().to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(upto // LINKS)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def link_counts(rows: DataFrame) -> DataFrame:
    """Of rows with pairs, the links of a text: (pair, n, best): how many links of all texts hold each pair of ids (a << 32 | b), and whether that is the most of its b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            keys, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    summed = stored(rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    most = summed.groupBy((F.col("pair") % (1 << 32)).alias("b")).agg(F.max("n").alias("most"))
    return summed.join(most, F.col("pair") % (1 << 32) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): of each text the groups of token ids that cover the same bytes, as array<struct<a: array<int>, b: array<int>>>."""
    arrow_sized(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Chunks(aligner(byte_level, pieces), lambda found: [[{k: [int(i) for i in side.split(",")] for k, side in zip("ab", g.split("|"), strict=True)} for g in x[3].split(";") if g] for x in found])
        for batch in sliced(batches):
            groups = [[g for x in c for g in store.kept[x]] for c in store.of(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.list_(pa.struct([("a", ints), ("b", ints)])))], ["doc_id", "groups"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, groups array<struct<a: array<int>, b: array<int>>>")


DIGEST = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _row(entries: list[tuple]) -> tuple:
    """What the entries of a text's chunks (four numbers, the groups as text, the links as bytes) sum up to."""
    if not entries:
        return (0, 0, 0, 0, "", b"")
    *numbers, groups, links = zip(*entries, strict=True)
    return (*map(sum, numbers), hashlib.sha256(";".join(groups).encode()).hexdigest(), b"".join(links))


def _lists(links: list[bytes]) -> pa.Array:
    upto = np.cumsum([0, *(len(x) // 8 for x in links)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.frombuffer(b"".join(links), np.int64)))


def linked(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs, its links as a << 32 | b."""
    arrow_sized(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Chunks(aligner(byte_level, pieces), lambda found: [(x[0], x[1], x[2], len(x[4]), x[3], array("q", x[4]).tobytes()) for x in found])
        for batch in sliced(batches):
            columns = list(zip(*(_row([store.kept[x] for x in c]) for c in store.of(batch.column(1).to_pylist())), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), _lists(columns[5])], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>")


def alignment(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each text: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the commonest of its b), count_sum (the counts of
    the links' pairs, summed), groups_sha256."""
    spark = docs.sparkSession
    rows = stored(linked(docs, byte_level, pieces, id_col, text_col))
    counts = stored(link_counts(rows))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in DIGEST.split(", "))]
    if not small_enough(counts, PAIR_BYTES, broadcast_bytes):
        return _by_shuffle(rows, counts, names)
    table = counts.orderBy("pair").toArrow()  # bounded by broadcast_bytes
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in _portions(batches):
            lists = batch.column(6)
            keys, of = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            at = np.searchsorted(pair, keys)
            upto = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [pa.array(np.diff(np.concatenate(([0], np.cumsum(v[at][of], dtype=np.int64)))[upto])) for v in (best, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), *sums, batch.column(5)], names)

    return rows.mapInArrow(run, f"doc_id {kind}, {DIGEST}")


def _by_shuffle(rows: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """alignment() where the table of pairs is too large to broadcast: each text's pairs go to it. Rows are numbered as they are stored."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("pairs").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_links"), F.sum(F.col("n") * F.col("times")).alias("total"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").withColumns({"n_best": F.coalesce("best_links", zero), "count_sum": F.coalesce("total", zero)}).select(*names)
