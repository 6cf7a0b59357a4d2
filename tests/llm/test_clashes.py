"""Filters on tables whose columns have the names that the filters would use, and the toxicity sample and score by plain compressions."""

import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, exact_dedup, simhash, toxicity_zstd

NAMES = ["__row", "__row2", "__gone", "__key", "key", "stays", "__ROW_"]


def test_stages_on_clashing_columns(spark):
    import corpus_pipeline

    text = "a text of some words that is found twice in this table and says no more than this"
    other = "quite another one with nothing in common between the two of them at all in any way"
    rows = [(1, text, "en"), (2, text, "en"), (3, other, "en"), (None, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit(7 + i) for i, n in enumerate(NAMES[:6])})
    items = spark.createDataFrame([("a", other)], "item_id string, text string")
    stages = {"language": (lambda d: corpus_pipeline.language(spark, d, ""), [1, 2, 3]), "exact": (exact_dedup.without_copies, [None, 1, 3]), "near": (simhash.one_of_each, [None, 1, 3]), "leaks": (lambda d: decontaminate.without_leaks(d, items), [None, 1, 2])}
    for name, (stage, want) in stages.items():
        kept = stage(docs)
        assert kept.columns == docs.columns, name
        found = kept.collect()
        assert sorted((r["doc_id"] for r in found), key=lambda i: i or 0) == want, name
        assert {tuple(r)[3:] for r in found} == {(7, 8, 9, 10, 11, 12)}, name


def test_unrelated_texts_all_stay():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(1500)).encode() for _ in range(200)]
    assert toxicity_zstd.apart([*texts, texts[5], texts[0]]) == texts
    piece = b"x" * 10 + bytes(range(97, 123)) * 3
    assert piece in toxicity_zstd.novel(b"known words " + piece + b" known words", np.unique(np.concatenate([toxicity_zstd._fives(b"known words known words "), toxicity_zstd._fives(b"known words x")])))


def test_scores_are_those_of_plain_compressions(spark):
    """Windows, three compressed lengths of each, features and curve, worked out again for a small table with a very long text, ties and repeats."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)]
    bad = ["zorkvile", "quagmuck", "drubbish"]
    say = lambda toxic, n=60: " ".join(rng.choice(bad) if toxic and rng.random() < 0.3 else rng.choice(words) for _ in range(n))
    rows = [(i, say(i % 3 == 0), int(i % 3 == 0)) for i in range(90)] + [(5, say(False), 0), (5, say(False), 0), (None, say(True), 1), (200, None, 0), (201, "", 0)]
    docs = [(i, t) for i, t, _ in rows] + [(300, say(True, 30_000)), (301, "x" * 5000), (300, "Plain words")]
    found = {}
    for r in toxicity_zstd.toxicity(spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("s")), spark.createDataFrame(rows, "doc_id long, text string, label int")).collect():
        found.setdefault(r["doc_id"], []).append(r["score"])
    drawn = [(t, y) for t, y, _ in toxicity_zstd.sample(spark.createDataFrame(rows, "doc_id long, text string, label int"))]
    contents, weights, _ = toxicity_zstd.fit(drawn)  # all rows are drawn, so the prior doesn't move
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=4, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    want = {}
    for i, text in docs:
        data, cut, at = " ".join((text or "").lower().split()).encode(), [], 0
        while at < len(data):
            blank = data.find(b" ", at + 128, at + 512)
            end = len(data) if at + 128 >= len(data) else blank if blank >= 0 else min(len(data), at + 512)
            cut.append(data[at:end])
            at = end
        size = [[len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(w)) for w in cut] or [0] for c in contents]
        x = [1.0, np.log(len(size[0]))]
        for other in size[1:]:
            gain = [a - b for a, b in zip(size[0], other, strict=True)]
            up = [max(g, 0) for g in gain]
            x += [max(up), np.log1p(sum(up)), np.log1p(max(sum(gain) / len(gain), 0) * 10), *(np.log1p(sum(g >= s for g in gain)) for s in (2, 4, 7)), *(sum(g >= s for g in gain) / len(gain) for s in (2, 4, 7))]
        want.setdefault(i, []).append(1 / (1 + np.exp(-np.clip(np.dot(weights, x), -30, 30))))
    assert found.keys() == want.keys()
    for i, scores in want.items():
        assert np.allclose(sorted(found[i]), sorted(scores), atol=1e-9), i
    auc = np.mean([a > b for i, _, y in rows[:90] for j, _, z in rows[:90] if y > z for a in found[i][:1] for b in found[j][:1]])
    assert auc > 0.9
