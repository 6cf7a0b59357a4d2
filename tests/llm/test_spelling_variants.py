"""Spelling variants against all pairs of a small vocabulary, and edge rows; the query against its SQL is in test_llm."""

import random
import zlib
from collections import Counter

from newsloom.llm import spelling_variants as sv
from tests.llm.test_llm import empty, odd  # noqa: F401

SCHEMA = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[p:] == b[p + 1 :])


def test_pairs_are_all_pairs_once(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("aab") for _ in range(rng.randint(3, 7))) for _ in range(150)} | {"aaaaaaa", "aaaaaaaa", "é", "éé", "e", "z", "aé", "ab"}
    found = [tuple(sorted((r["word"], r["other"]))) for r in sv.near_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_vocabulary_and_forms(spark):
    rng = random.Random(1)
    texts = []
    for i in range(400):
        base = rng.choice(["Straßenbahn", "éclairage", "Wonderful", "wonderfully", "wonderfu", "aaaaaaaa"])
        texts.append((i % 390 if i % 7 else None, f"{base} {base.upper()}, short {base}1{base[:-1]}x" if i % 3 else None))
    counts, want = Counter(), {}
    for i, text in texts:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        want[w] = (best if best and words[best] >= 10 * n else None, n, len(near))
    found = {r["word"]: r for r in sv.spelling_variants(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert {w: (r["form"], r["n"], r["n_near"]) for w, r in found.items()} == want and any(f for f, *_ in want.values())
    for w, r in found.items():
        while want[w][0]:
            w = want[w][0]
        assert r["root"] == w and r["form_n"] == (words[r["form"]] if r["form"] else None)


def test_forms_of_forms_and_ties(spark):
    words = spark.createDataFrame([("abcdefgh", 5000), ("abcdefgx", 400), ("abcdefyx", 30), ("abcdezyx", 2), ("qqqqqqqq", 20), ("qqqqqqqa", 20), ("qqqqqqqb", 2)], "word string, n long")
    found = {r["word"]: r for r in sv.variants(words).collect()}
    assert {found[w]["root"] for w in ("abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx")} == {"abcdefgh"}
    assert found["qqqqqqqb"]["form"] == "qqqqqqqa" and found["qqqqqqqa"]["form"] is None and found["qqqqqqqa"]["n_near"] == 2


def test_edges(spark, odd, empty):  # noqa: F811
    assert sv.spelling_variants(empty).count() == 0
    found = {r["word"]: r["n"] for r in sv.spelling_variants(odd.withColumnsRenamed({"lang": "word", "keep_id": "n", "fp": "form"}), draw=0).collect()}
    assert found == {"Ünïcode": 3000}
    long = spark.createDataFrame([(1, "Xylophone " * 300_000), (2, "xylophonee " * 4)], SCHEMA)
    assert {r["word"]: r["root"] for r in sv.spelling_variants(long, draw=0).collect()} == {"xylophone": "xylophone", "xylophonee": "xylophone"}
