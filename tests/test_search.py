"""Text search: what is asked for, the index against the texts, stems, cover density, the whole search against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions.stems import romanian
from newsloom.operators import search as S

SCHEMA = "id int, title string, content_text string, is_templated boolean, is_excluded boolean, embedding array<double>"


def article(i, text, title="", flags=(False, False), vec=None):
    return (i, title, text, *flags, vec)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    words = ["Guvern", "guvernul", "guvernului", "alegeri", "alegerile", "alegerilor", "și", "la", "pentru", "x1", "Două", "cuvinte"]
    rows = [article(i, " ".join(rng.choice(words) + rng.choice(["", ",", ".", " -"]) for _ in range(rng.randint(0, 30))), rng.choice(["", "Titlu", "La alegeri"]), rng.choice([(False, False)] * 6 + [(True, False), (None, False)]), [rng.gauss(0, 1) for _ in range(3)] if i % 5 else None) for i in range(300)]
    rows.append(article(300, None, None))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_what_is_asked(spark):
    assert S.asked('the "two words" -no or other') == [[(["the"], True), (["two", "words"], True), (["no"], False)], [(["other"], True)]]
    df = spark.createDataFrame([article(1, "the two words"), article(2, "the words two"), article(3, "no the two words"), article(4, "Other"), article(5, "theory of two words")], SCHEMA)
    assert {r["id"] for r in S.by_text(df, S.asked('the "two words" -no or other')).collect()} == {1, 4}
    assert S.by_text(df, S.asked('" - ')).count() == 0
    assert {r["id"] for r in S.by_text(df, S.asked("-two")).collect()} == {4}


def test_cover_density(spark):
    """By hand: shortest stretches with all terms, each 0.1 over one more than the words between, by the harmonic mean of distances."""
    rows = [(1, "a x b y y a b".split()), (2, ["a", "b"]), (3, ["a", "a"])]
    places = [(i, [[n for n, x in enumerate(words) if x == w] or None for w in "ab"]) for i, words in rows]
    df = spark.createDataFrame([*places, (4, None), (5, [])], "id int, p array<array<int>>")
    found = {r["id"]: r["density"] for r in df.select("id", S.cover_density("p").alias("density")).collect() if r["density"] is not None}
    # 1: a x b (0.05, middle 1), b y y a (0.1 / 3, middle 3.5), a b (0.1, middle 5.5).
    assert set(found) == {1, 2} and abs(found[1] - (0.05 + 0.1 / 3 + 0.1) / (3 / (1 / 2.5 + 1 / 2))) < 1e-8 and abs(found[2] - 0.1) < 1e-9


@pytest.mark.parametrize("groups", [{"abrupt", "abruptă"}, {"absent", "absentă"}, {"absolvenţi", "absolvenții"}, {"absolvit", "absolvite"}, {"guvern", "guvernul", "guvernului"}, {"alegerile", "alegerilor", "alegeri"}, {"partid", "partide", "partidele", "partidelor"}, {"școală", "şcoala"}])
def test_forms_have_one_stem(groups):
    assert len(set(map(romanian, groups))) == 1


def test_stems_by_hand():
    """Steps worked by the published rules: a combined suffix, a standard one, a verb's, a final vowel, a vowel between vowels, short words."""
    told = {"absenţa": "absenţ", "activitate": "activ", "modernizare": "moderniz", "iubire": "iubir", "naţiune": "naţiun", "capitalism": "capitalist", "lucrând": "lucr", "a": "a", "": "", "de": "de", "x1": "x1", "ploua": "plou"}
    assert {w: romanian(w) for w in told} == told



@pytest.mark.parametrize("stem", [None, romanian])
@pytest.mark.parametrize("query", ["guvern alegeri", '"la alegeri" -pentru or două cuvinte', "-guvernul", "guvernului", "nimic or x1 la", ""])
def test_postings_say_what_texts_say(spark, texts, tmp_path, stem, query):
    rows, df = texts
    path = f"{tmp_path}/postings"
    S.write_postings(df, path, stem=stem)
    groups = S.stemmed(S.asked(query), stem)
    found = {r["id"]: r["at"] or {} for r in S.by_postings(df, path, groups).collect()}
    import regex

    want, own = {}, stem or (lambda w: w)
    for r in rows:
        words = [own(w) for w in regex.findall(S.WORD, " ".join(x for x in r[1:3] if x is not None).lower())]
        line = f" {' '.join(words)} "
        if any(all((f" {' '.join(part)} " in line) == there for part, there in g) for g in groups):
            want[r[0]] = {w: [n for n, x in enumerate(words) if x == w] for w in {w for g in groups for part, _ in g for w in part} & set(words)}
    assert found == want
    if stem is None:
        assert {r["id"]: {w: at for w, at in r["at"].items() if at} for r in S.by_text(df, groups).collect()} == want


def test_search_reads_its_terms_only(spark, texts, tmp_path):
    path = f"{tmp_path}/postings"
    S.write_postings(texts[1], path, stem=romanian)
    plan = S.by_postings(texts[1], path, S.stemmed(S.asked("guvern"), romanian))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,guvern)" in plan


def test_search_by_stems(spark, texts, tmp_path):
    """Against a plain version: both legs, fusion, forms that meet."""
    rows, df = texts
    path = f"{tmp_path}/postings"
    S.write_postings(df, path, stem=romanian)
    q = [1.0, 0.5, -1.0]
    found = {r["id"]: (r["dense_rank"], r["sparse_rank"], r["rrf"]) for r in S.hybrid_search(df, q, "guvernul", postings=path, stem=romanian, floor=0.1, candidates=30, retain=0.0, top_k=40).collect()}
    import regex

    dense, sparse = [], []
    for i, title, text, templated, excluded, vec in rows:
        at = [n for n, w in enumerate(regex.findall(S.WORD, f"{title} {text}".lower())) if romanian(w) == romanian("guvern")]
        if templated is False and excluded is False and at:
            cos = vec and sum(a * b for a, b in zip(q, vec)) / math.sqrt(sum(a * a for a in q)) / math.sqrt(sum(a * a for a in vec))
            if vec and cos >= 0.1:
                dense.append((-round(cos, 9), i))
            near = sum(1 / (b - a) for a, b in zip(at, at[1:]))
            sparse.append((-round(0.1 * len(at) / (len(at) / near) if near else 0.1 * len(at), 9), i))
    ranks = [{i: n + 1 for n, (_, i) in enumerate(sorted(leg)[:30])} for leg in (dense, sparse)]
    want = {i: (ranks[0].get(i), ranks[1].get(i), round(sum(1 / (60 + r[i]) for r in ranks if i in r), 9)) for i in ranks[0].keys() | ranks[1].keys()}
    best = sorted(want, key=lambda i: (-want[i][2], i))[:40]
    assert found == {i: want[i] for i in best} and len(best) == 40
    with pytest.raises(ValueError):
        S.hybrid_search(df, q, "x", stem=romanian)


def test_no_articles(spark, texts, tmp_path):
    none = texts[1].where(F.lit(False))
    S.write_postings(none, f"{tmp_path}/p")
    assert S.hybrid_search(none, [1.0], "guvern", postings=f"{tmp_path}/p").count() == 0 == S.hybrid_search(none, [1.0], "").count()
