"""Unit vectors of functions without SQL, streaming and schedules."""

import math
from datetime import datetime

import duckdb
import pytest

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import clustering as C
from newsloom.operators import entities as N
from newsloom.operators import graph as G
from newsloom.operators import sinks
from newsloom.plans import queries as plans
from newsloom.plans import schedule
from newsloom.streaming import ingest
from tests.conftest import DATA

SINGLE, DOUBLE, TRAILING = ["premierul", "președintele", "ministrul"], ["fostul premier"], ["președinte"]


def test_titles(spark):
    given = {"Premierul Marcel Ciolacu": "Marcel Ciolacu", "Fostul premier Marcel Ciolacu": "Marcel Ciolacu", "Președintele interimar Ilie Bolojan": "Ilie Bolojan", "Ministrul Energiei, Sebastian Burduja": "Sebastian Burduja", "Iohannis, președinte": "Iohannis"}
    df = spark.createDataFrame([(k,) for k in given], "n string").select("n", T.strip_titles(F.col("n"), SINGLE, DOUBLE, TRAILING).alias("o"))
    assert {r["n"]: r["o"] for r in df.collect()} == given


def test_artifacts(spark):
    given = {"PSD+AUR": True, "PNL PSD": True, "PNL Bogdan": True, "congres": True, "Ilie Bolojan": False, "apa": True}
    df = spark.createDataFrame([(k,) for k in given], "n string").select("n", T.artifact(F.col("n"), ["PSD", "PNL", "AUR"], ["congres"]).alias("o"))
    assert {r["n"]: r["o"] for r in df.collect()} == given


def test_scores_of_empty_texts(spark):
    df = spark.createDataFrame([("", ""), (None, None)], "t string, c string").select(T.sensationalism(F.col("t")).alias("s"), T.citation_quality(F.col("c"), F.lit(0)).alias("q"))
    assert [tuple(r) for r in df.collect()] == [(0.0, 0.5), (0.0, 0.5)]


def test_label_text():
    assert C.label_text(["A", "B", "C", "D"], ["a", "x", "y", "z"]) == "A, B, C, x, y"
    assert C.label_text([], []) == "fără etichetă"


def test_schedule():
    order = schedule.order()
    assert order.index("topics") < order.index("topic_labels") < order.index("events") < order.index("coverage")
    now = datetime(2024, 5, 1, 23)
    assert schedule.due(now, None, "cluster") and not schedule.due(now, now, "cluster") and not schedule.due(now.replace(hour=5), None, "cluster")
    assert schedule.due(now, datetime(2024, 5, 1, 19), "fast") and not schedule.due(now, datetime(2024, 4, 29), "graph")


def test_sinks_run_twice_alike(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = sinks.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sinks.upsert(once, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(20).selectExpr("id % 7 AS id", "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS ts", "concat('text ', id % 7) AS text")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(spark, str(tmp_path / "in"), rows.schema, "id", "ts")
    encode = lambda df: df.select("id", "text").mapInPandas(C.embed_hashed, "id long, embedding array<float>")
    q = ingest.embed_stream(stream, encode, str(tmp_path / "out"), str(tmp_path / "cp"), backfill=True)
    assert q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(7))


def test_span_rules_of_the_parser(spark):
    given = {("Tik Tok", "LOC"): False, ("a b", "PERSON"): False, ("Ana/Ion", "PERSON"): False, ("Mediafax SRL", "ORGANIZATION"): False, ("Mediafax", "PERSON"): True, ("X" * 41, "PERSON"): False, ("A b c d e f", "LOC"): False, ("A b c d e", "LOC"): True, ("FOTO", "EVENT"): False, (None, "GPE"): False}
    df = spark.createDataFrame([(*k,) for k in given], "t string, l string").select("t", "l", N.plausible(F.col("t"), F.col("l"), "parser").alias("o"))
    assert {(r["t"], r["l"]): r["o"] for r in df.collect()} == given


def test_spans_have_one_capital_for_each_letter(spark, duck):
    given = ["".join(T.SINGLE), "straße", "ß", "ßa", "aﬁ ŉb", "", None, "ǆ čă 𐐨"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    want = {i: duck.execute("SELECT upper(?)", [t]).fetchall()[0][0] for i, t in enumerate(given)}
    assert {r["i"]: r["o"] for r in df.select("i", T.capitals(F.col("t")).alias("o")).collect()} == want and want[1] == "STRAẞE"
    blocked = spark.createDataFrame([("DİGİ 24",), ("Dacia",)], "t string").select("t", N.plausible(F.col("t"), F.lit("ORGANIZATION")).alias("o"))
    assert {r["t"]: r["o"] for r in blocked.collect()} == {"DİGİ 24": False, "Dacia": True}


def test_plausible_spans_of_sharp_letters(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x ßer ench", "src1", "de", 10), (2, "ßabcdef ßtttttt a", "src1", "de", 17), (3, "a b Großer x", "src1", "de", 12)], "doc_id long, text string, source string, lang string, n_chars long")
    con = duckdb.connect()
    for t, df in {"documents": docs, **{t: spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("embeddings", "labels")}}.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = {tuple(r) for r in plans.QUERIES["plausible_spans"](spark, str(tmp_path)).collect()}
    assert found == set(con.execute(plans.SQL["plausible_spans"]).fetchall()) and any("ẞ" in r[2] for r in found)


def test_spans_end_where_the_label_changes(spark):
    tags = ["O", "I-PERSON", "B-PERSON", "I-PERSON", "I-ORG", "I-PERSON", "B-ORG", "B-FACILITY", "I-FACILITY", "B-DATE", "O"]
    words = spark.createDataFrame([(1, i, f"w{i}", t) for i, t in enumerate(tags)], "article_id int, pos int, text string, tag string")
    found = {(r["start"], r["entity_text"], r["entity_label"]) for r in N.spans(words).collect()}
    assert found == {(2, "w2 w3", "PERSON"), (6, "w6", "ORGANIZATION"), (7, "w7 w8", "LOC")}
    assert N.spans(words.limit(0)).count() == 0


def test_paths_between_names(spark):
    graph = spark.createDataFrame([("Ana", "Ion", 20, 1.0), ("Ion", "Vlad", 20, 2.0), ("Ana", "Dan", 20, 1.0), ("Dan", "Vlad", 20, 1.0)], "source string, target string, weight_raw long, weight_pmi double")
    assert [(r["path"], r["cost"]) for r in G.paths(graph, " ana", "VLAD").orderBy("path_id").collect()] == [("Ana > Ion > Vlad", 1.5), ("Ana > Dan > Vlad", 2.0)]
    assert G.paths(graph, "ana", "vlad", max_hops=1).count() == 0
    with pytest.raises(LookupError, match="Nobody"):
        G.paths(graph, "Ana", "Nobody")
    with pytest.raises(ValueError):
        G.paths(graph, "Ana", "ANA ")


def test_paths_through_hubs_and_artefacts(spark):
    """Hubs, listed names and artefacts carry no path while others do; if none is left the cheapest stand; a name below the floors opens the whole graph."""
    edge = "source string, target string, weight_raw int, weight_pmi double"
    pairs = [("Ana", "Hub", 50, 3.0), ("Hub", "Vlad", 50, 3.0), ("Ana", "Dan", 20, 1.0), ("Dan", "Vlad", 80, 1.0), ("Ana", "PSD+AUR", 50, 4.0), ("PSD+AUR", "Vlad", 50, 4.0), ("Ana", "Europa", 50, 4.0), ("Europa", "Vlad", 50, 4.0), ("Ana", "Ion", 20, 2.0), ("Ion", "Vlad", 20, 2.0)]
    graph = spark.createDataFrame(pairs + [("Hub", f"N{k}", 20, 1.0) for k in range(9)] + [("Low", "Vlad", 3, 0.1)], edge)
    found = G.scored_paths(graph, G.path_candidates(graph, "Ana", "Vlad")).collect()
    by = {r["path"]: r["score"] for r in found}
    assert {p for p in by if p.count(">") == 2} == {"Ana > Dan > Vlad", "Ana > Ion > Vlad"}
    assert abs(by["Ana > Dan > Vlad"] - math.log(1 + math.sqrt(20 * 80)) / math.log(3)) < 1e-5
    assert abs(by["Ana > Ion > Vlad"] - 2 * math.log(21) / math.log(3)) < 1e-5
    best = G.paths(graph, "Ana", "Vlad").orderBy("path_id").collect()
    assert [r["path"] for r in best] == ["Ana > Ion > Vlad", "Ana > Dan > Vlad"]
    only = spark.createDataFrame(pairs[:2] + [("Hub", f"N{k}", 20, 1.0) for k in range(9)], edge)
    assert [r["path"] for r in G.paths(only, "Ana", "Vlad").collect()] == ["Ana > Hub > Vlad"]
    assert [r["path"] for r in G.paths(graph, "Low", "Vlad", max_hops=1).collect()] == ["Low > Vlad"]


def test_false_names(spark):
    given = {"Acesta": True, " editor ": True, "Site.RO": True, "Ilie Bolojan": False}
    df = spark.createDataFrame([(k,) for k in given], "n string").select("n", T.ner_stop(F.col("n")).alias("o"))
    assert {r["n"]: r["o"] for r in df.collect()} == given


def test_labels_pairs(spark):
    """The texts of a cluster are one, in order: the last word of a text pairs with the first of the next that has any."""
    df = spark.createDataFrame([(1, 1, "Știri despre Guvern și Parlament"), (1, 3, "Guvern x1y"), (1, 2, "x1"), (2, 4, "Guvern"), (2, 5, None)], "k int, id int, t string")
    found = {(r["k"], r["term"], r["tf"]) for r in C.label_terms(df, "k", "t", "id").collect()}
    assert found == {(1, "știri", 1), (1, "guvern", 2), (1, "parlament", 1), (1, "știri guvern", 1), (1, "guvern parlament", 1), (1, "parlament guvern", 1), (2, "guvern", 1)}


def test_names(spark):
    rows = [("Premierul Marcel Ciolacu", "", "Marcel Ciolacu"), ("Uniunii Europene", "uniune", "Uniunea Europeană"), ("Iranului", None, "Iran"), ("României", "România", "România"), ("Zelenski", None, "Volodimir Zelenski"), ("ONU", "onu_", "onu_"), ("Parti\u0163a_Mare", None, "Partița Mare"), ("Pala\u0163ul S\u0326tefan", None, "Palațul Ștefan"), ("Statelor Unite", "stat unit", "Statele Unite"), ("Comisie", "comisie european", "Comisia Europeană"), ("Iohannis, președinte", None, "Iohannis"), ("", "x", ""), (None, None, "")]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, surface string, lemma string").withColumn("name", N.normalise(F.col("surface"), F.col("lemma")))
    assert {r["i"]: r["name"] for r in df.collect()} == {i: r[2] for i, r in enumerate(rows)}


def test_votes(spark):
    """By hand: (value, confidence) of the labeler, the expander and the register."""
    none, low = (None, None), ("informativ", "low")
    told = [(["a", "a"], ("a", "high"), ("a", "high"), ("a", "high")), (["a", "b", "a"], ("a", "low"), ("a", "low"), low), (["a", "b", "c"], none, none, low), (["a", None, "a"], ("a", "low"), ("a", "high"), low), ([None, "a", "a"], ("a", "low"), none, low), (["a", "b", "b"], ("b", "low"), ("b", "low"), low), ([None, None, "a"], none, none, low)]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(told)], "i int, v array<string>").select("i", *(T.vote(F.col("v"), r).alias(r) for r in ("labeler", "expander", "register")))
    assert {r["i"]: tuple(map(tuple, r[1:])) for r in df.collect()} == {i: t[1:] for i, t in enumerate(told)}


def test_fact_check_titles(spark):
    from newsloom.operators import factchecks as K

    given = {"FALS: Apa este uscată": True, "FALS incendiu": False, "Parțial fals | Un clip": False, "Parțial adevărat | Un clip": True, "SCAM I oferta": False, "Deep fake: președintele": False, "știri obișnuite": False, "FAKE NEWS – harta": False}
    df = spark.createDataFrame([(k,) for k in given], "t string").select("t", K.is_fact_check(F.col("t")).alias("o"))
    found = {r["t"]: r["o"] for r in df.collect()}
    assert found == given


def test_credits_before_persons(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("(Foto: de la Ana și Ion spune Sursa Inquam lui Dan".split())] + [(2, 0, "Ana")], "article_id int, pos int, text string")
    rows = [(1, 3, "Ana", "PERSON"), (1, 5, "Ion", "PERSON"), (1, 8, "Inquam", "ORGANIZATION"), (1, 10, "Dan", "PERSON"), (2, 0, "Ana", "PERSON")]
    df = spark.createDataFrame(rows, "article_id int, start int, entity_text string, entity_label string")
    assert {(r["article_id"], r["start"]) for r in N.uncredited(df, words).collect()} == {(1, 5), (1, 8), (2, 0)}
