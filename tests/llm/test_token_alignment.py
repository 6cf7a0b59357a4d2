"""Alignment of two tokenizers against whole-text encodings and byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from newsloom.llm import token_alignment as ta
from newsloom.llm.common import stored
from tests.llm.test_llm import empty, odd  # noqa: F401

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "the", "st", " ", "  ", "\n", "\t", "\r\n", "'s", "'", ".", ",", ");", "\r", "é", "é", "ß", "中文", "🙂", "1", "23", "²", "<|endoftext|>", "</s>", "<0x41>", "\x1c", "\xa0", "　", "_", "-", "ſ", "ª", "\x00"]


def brute(texts):
    """By id: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, from byte offsets of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = {c: i for i, c in enumerate(ta.byte_characters())}
    spans, counts = {}, Counter()
    for key, text in texts:
        spans[key] = None
        if not text:
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bits = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not all(b"".join(x) == (" " + text).encode() for x in bits):
            continue
        cuts = [[sum(map(len, x[:i])) for i in range(len(x) + 1)] for x in bits]
        links = [(i, j) for i in range(len(ids[0])) for j in range(len(ids[1])) if max(cuts[0][i], cuts[1][j]) < min(cuts[0][i + 1], cuts[1][j + 1])]
        counts.update((ids[0][i], ids[1][j]) for i, j in links)
        spans[key] = ids, cuts, links
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = {}
    for key, told in spans.items():
        if told is None:
            out[key] = (0, 0, 0, 0, 0, 0, "")
            continue
        ids, cuts, links = told
        both = sorted(set(cuts[0]) & set(cuts[1]))
        groups = ["|".join(",".join(str(x) for x, at in zip(side, cut, strict=False) if lo <= at < hi) for side, cut in zip(ids, cuts, strict=True)) for lo, hi in zip(both, both[1:], strict=False)]
        pairs = [(ids[0][i], ids[1][j]) for i, j in links]
        out[key] = (len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    made = ["".join(rng.choice(ALPHABET) * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    return list(enumerate([*made, None, "", " ", "   ", "a ▁ b", "▁", "x" * 300, " lead", "trail ", "the end\n the  end", made[3]]))


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_against_offsets(spark, texts, limit):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r[0]: tuple(r[1:]) for r in ta.alignment(docs, A, B, broadcast_bytes=limit).collect()}
    assert found == brute(texts)


def test_small_stores(spark, texts, monkeypatch):
    """Stores that are emptied again and again, and a text that is one unit, change nothing."""
    one = ta.Aligner(A, B)
    whole = ta.Aligner(A, B)
    whole.cuts = False
    for name in ("KEPT", "LONGEST_KEPT"):
        monkeypatch.setattr(ta, name, 3)
    store = ta.Chunks(one, lambda found: [x[3] for x in found])
    for _, text in texts[:200]:
        if text and "▁" not in text:
            parts = one.align(ta.chunks(text))
            assert " ".join(ta.chunks(text)) == text
            (told,) = whole.align([text])
            assert told[3] == ";".join(p[3] for p in parts) and told[4] == [x for p in parts for x in p[4]]
            (kept,) = store.of([text])
            assert ";".join(store.kept[c] for c in kept) == told[3]


@pytest.mark.parametrize("length", [5, 3_000])
def test_stores_are_bounded_in_bytes(monkeypatch, length):
    """What a task keeps has a bound in bytes, however long chunks are, and what comes back from it is right."""
    monkeypatch.setattr(ta, "KEPT_BYTES", 400_000)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghé") for _ in range(length)) for _ in range(3 * 400_000 // (340 + 20 * length))]
    one = ta.Aligner(A, B)
    store = ta.Chunks(one, lambda found: [x[3] for x in found])
    cost = lambda held: sum(340 + 20 * len(c) for c in held)
    for word in [*words, *words[-5:], *words[:5], "▁", *words[-5:], "▁"]:
        (kept,) = store.of([word])
        assert ";".join(store.kept[c] for c in kept) == (r[3] if (r := one.align([word])[0]) else "")
        assert cost(store.kept) + cost(store.older) <= 400_000 + 2 * cost([word])


def test_groups_and_edges(spark, odd, empty):  # noqa: F811
    assert ta.alignment(empty, A, B).count() == 0 and ta.align(empty, A, B).count() == 0
    odd = odd.withColumnsRenamed({"lang": "n_a", "fp": "groups", "keep_id": "pair"})
    found = {r["doc_id"]: r for r in ta.alignment(odd, A, B).collect()}
    assert found[3]["n_a"] == found[4]["n_links"] == 0 and found[4]["groups_sha256"] == "" and found[1]["n_a"] and found[None]["groups_sha256"] == found[1]["groups_sha256"]
    groups = {r["doc_id"]: r["groups"] for r in ta.align(odd, A, B).collect()}
    for key, got in groups.items():
        text = ";".join(f"{','.join(map(str, g['a']))}|{','.join(map(str, g['b']))}" for g in got)
        assert found[key]["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if got else "") and len(got) == found[key]["n_groups"]


def test_query(spark, tmp_path):
    from newsloom.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: tuple(r[1:8]) for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()}
    assert found == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_texts_are_encoded_once(spark, texts, monkeypatch):
    """Counting and looking up read what is stored: they work with stores of links, in small portions, and no tokenizer."""
    monkeypatch.setattr(ta, "LINKS", 50)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = stored(ta.linked(docs, A, B))
    want = Counter(p for r in rows.collect() for p in r["pairs"])
    monkeypatch.setattr(ta, "aligner", None)
    counts = ta.link_counts(rows).collect()
    assert want and {r["pair"]: r["n"] for r in counts} == want
    top = {}
    for p, n in want.items():
        top[p % (1 << 32)] = max(top.get(p % (1 << 32), 0), n)
    assert all(r["best"] == (r["n"] == top[r["pair"] % (1 << 32)]) for r in counts)
