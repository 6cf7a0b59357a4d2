"""op4: no link between different texts is left out."""

import random

import numpy as np
import pytest

from newsloom.llm import queries, substring_dedup
from newsloom.operators.components import components


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


@pytest.mark.parametrize("hot", [1_000, 3])
def test_all_similar_variants_are_linked(spark, monkeypatch, hot):
    """Forty variants of one passage, more than are laid out step by step: each similar pair is a row, not only a path of links."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK", 8)
    rng = random.Random(5)
    base, texts = _words(rng, 100), []
    for _ in range(40):
        at, new = rng.randint(0, 99), _words(rng, 1)
        texts.append(base[:at] + new + base[at + 1 :])
    grams = [{tuple(t[i : i + 5]) for i in range(96)} for t in texts]
    near = {(j, i) for j in range(40) for i in range(j) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8}
    docs = [(k, " ".join(_words(rng, 20) + t + _words(rng, 20))) for k, t in enumerate(texts)]
    found = {(r["doc_id"], r["other_id"]) for r in substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(near) > 700 and near <= found


@pytest.mark.parametrize("hot", [1_000, 1])
def test_each_place_of_a_passage_and_each_document(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(6)
    passage = _words(rng, 100)
    once, twice = _words(rng, 10) + passage + _words(rng, 10), _words(rng, 10) + passage + _words(rng, 10) + passage + _words(rng, 10)
    docs = spark.createDataFrame([(1, " ".join(twice)), (2, " ".join(once)), (3, " ".join(_words(rng, 200)))], "doc_id long, text string")
    found = substring_dedup.both_sides(substring_dedup.repeats(docs)).collect()
    places = {(r["doc_id"], r["first_word"], r["other_id"], r["other_first_word"]) for r in found if r["last_word"] - r["first_word"] == 99}
    assert places == {(2, 10, 1, 10), (2, 10, 1, 120), (1, 10, 2, 10), (1, 120, 2, 10)}


def test_similar_part_of_a_stretch_that_is_not():
    """Two words changed, 46 apart: each window of SPAN is similar enough, the stretch of them all is not."""
    rng = np.random.default_rng(4)
    a = rng.integers(1, 1 << 31, 53).astype(np.int32)
    b = a.copy()
    for at in (1, 47):
        b[at : at + 5] = rng.integers(1, 1 << 31, 5)
    whole = [(x, x + 45) for x in range(8) if substring_dedup._jaccard(a[x : x + 46], b[x : x + 46]) >= 0.8]
    found = substring_dedup.passages(a, b, 0.8)
    assert len(whole) == 8 and all(s >= 0.8 for *_, s in found)
    assert all(any(lo <= y and x <= hi for lo, hi, *_ in found) for x, y in whole)


@pytest.mark.parametrize("hot", [1_000, 5])
def test_classes_are_those_of_all_pairs(spark, tmp_path, monkeypatch, hot):
    """One row for each document, however many pairs: variants by one word, a chain whose ends are not similar, copies, strangers, a null id."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK", 8)
    rng = random.Random(8)
    base, chain, texts = _words(rng, 100), _words(rng, 90), []
    for _ in range(30):
        at = rng.randint(0, 99)
        texts.append(_words(rng, 20) + base[:at] + _words(rng, 1) + base[at + 1 :] + _words(rng, 20))
    for k in (10, 30, 50, 70, 85):
        texts.append(_words(rng, 20) + chain + _words(rng, 20))
        chain = chain[:k] + _words(rng, 1) + chain[k + 1 :]
    texts += [texts[0], texts[31], *(_words(rng, 90) for _ in range(5)), [], _words(rng, 3)]
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(None, " ".join(texts[0])), (0, " ".join(texts[0]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for r in substring_dedup.repeats(table).collect():
        a, b = top(r["doc_id"]), top(r["other_id"])
        root[max(a, b)] = min(a, b)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_substring_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found if r["doc_id"] is not None) == sorted([(k, top(k)) for k in range(len(texts))] + [(0, 0)])
    assert [r["class_id"] for r in found if r["doc_id"] is None] == [None] and {top(k) for k in range(30)} == {0} and {top(k) for k in range(30, 35)} == {30}


def test_components_of_large_names(spark):
    """Names beyond 2^53 are not rounded."""
    edges = spark.createDataFrame([(0, 2**62 + 1, 2**62 + 2), (0, 2**62 + 3, 2**62 + 2), (0, 2**62 + 5, 2**62 + 4)], "g long, a long, b long")
    assert {(r["node"] - 2**62, r["component"] - 2**62) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
