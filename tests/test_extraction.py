"""Paths into pages, dates and links by the rules of outlets; functions of sinks and summaries that no query calls."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import sinks
from newsloom.sources import extraction as X

PAGE = """<html><head><meta property="article:published_time" content="2024-05-01T10:00:00"><script type="application/ld+json">{"@graph": [{"datePublished" : "2024-03-02T01:02:03"}]}</script></head>
<body><h1 class="a entry-title"> Big <i>news</i></h1><div class="card border-0"><h5 class="card-title"><a href="/x">x</a></h5></div>
<div class="td-post-content main"><p>One <b>two</b><p>three &amp; four<ul><li>no</ul></div><div class="tdb-block-inner"><p> five </p></div><time class="entry-date" datetime="2024-01-01">1 ianuarie</time></body></html>"""


@pytest.mark.parametrize(
    "path, want",
    [
        ("//h1//text()", [" Big ", "news"]), ("//h1/text()", [" Big "]), ('//h1[contains(@class, "nothing")]/text()', []), ('//div[contains(@class, "td-post-content") and contains(@class, "main")]//p//text()', ["One ", "two", "three & four"]),
        (X.RULES[6][3], ["One ", "two", "three & four", " five "]), ('//meta[@property="article:published_time"]/@content | //time/@datetime', ["2024-05-01T10:00:00", "2024-01-01"]),
        ('.//*[contains(@class, "card-title")]/a/@href', ["/x"]), ('//div[contains(@class, "zzz") or contains(@class, "border-0")]//a/text()', ["x"]), ('.//div[descendant::h5]//@href', ["/x"]), ("//li/text()", ["no"]), (None, []),
    ],
)
def test_paths(path, want):
    assert X.select(X.tree(PAGE), path) == want


def test_a_reference_ends_in_a_semicolon():
    page = '<h1>a &amp;&amp b&amp</h1><a href="/x?a=1&copy=2&amp;b=&quot;">&ampx; &quot;c&#38;d &lt; R&D &</a><script>x&amp;y&amp z</script>'
    assert X.select(X.tree(page), "//h1//text()") == ["a &&amp b&amp"]
    assert X.select(X.tree(page), "//a/text()") == ['&ampx; "c&d < R&D &'] and X.select(X.tree(page), "//a/@href") == ['/x?a=1&copy=2&b="']
    assert X.select(X.tree(page), "//script/text()") == ["x&amp;y&amp z"]


def test_every_outlet(spark):
    pages = spark.createDataFrame([(i, i, f"u{i}", PAGE) for i in range(1, 14)] + [(20, 7, None, None), (21, 4, "u", '<p class="date-container">Publicat <b>5.6.2024</b></p><div class="author-sm"> Ana </div>'), (22, 5, "u", '<h2>T</h2><li class="article-date">Data: 03-04-2024 05:06</li>'), (23, 1, "u", '<div class="news__publish">Luni, 7 mai 2024 ora 08:09</div>')], "page_id long, outlet_id int, url string, html string")
    found = {r["page_id"]: r for r in X.extract(pages, X.rules(spark)).collect()}
    assert set(found) == {*range(1, 13), 20, 21, 22, 23}
    assert found[7]["title"] == "Big" and found[7]["content_text"] == "One two three & four five" and found[7]["author"] == "Gazeta de Sud" and found[7]["published_at"] == datetime(2024, 5, 1, 10)
    assert found[3]["published_at"] == datetime(2024, 3, 2, 1, 2, 3) and found[3]["title"] == "Unknown Title" and found[2]["published_at"] == datetime(2024, 1, 1)
    assert (found[20]["title"], found[20]["content_text"], found[20]["published_at"], found[20]["url_hash"]) == ("Unknown Title", "", None, None)
    assert (found[21]["published_at"], found[21]["author"]) == (datetime(2024, 6, 5), "Ana") and found[22]["published_at"] == datetime(2024, 4, 3, 5, 6) and found[23]["published_at"] == datetime(2024, 5, 7, 8, 9)


def test_links(spark):
    given = [(2, "https://www.desteptarea.ro/o-stire/", True), (2, "https://www.desteptarea.ro/123-4", False), (2, "https://www.desteptarea.ro/a/b", False), (2, "https://other.ro/x", False), (1, "https://ziare.com/Horoscop/x", False), (1, "https://ziare.com/politica", True), (7, "https://www.gds.ro/Local/x", True), (7, "http://www.gds.ro/x", False), (5, "anything", True), (13, "x", False)]
    df = spark.createDataFrame([g[:2] for g in given], "outlet_id int, link string")
    assert {tuple(r) for r in X.valid_links(df, X.rules(spark)).collect()} == {g[:2] for g in given if g[2]}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "cluster_run_id int, id int, v string")
    sinks.replace_partition(rows, f"{tmp_path}/t")
    sinks.replace_partition(rows.where("id = 2").withColumn("v", F.lit("new")), f"{tmp_path}/t")
    assert {(r["cluster_run_id"], r["id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, 2, "new"), (2, 3, "c")}
    for _ in range(2):
        sinks.rejected(rows.select("id", "v").where("id < 3"), f"{tmp_path}/log")
    assert sorted(x["value"] for x in spark.read.text(f"{tmp_path}/log").collect()) == ["1\ta", "1\ta", "2\tb", "2\tb"]


def test_replies(spark):
    fenced = "```json\n{\"a\": {\"b\": 1}}\n```"
    df = spark.createDataFrame([(1, fenced), (2, 'Sure: {"x": 2} so'), (3, "none"), (4, None)], "i int, reply string")
    assert {r["i"]: r["o"] for r in df.select("i", T.json_object(F.col("reply")).alias("o")).collect()} == {1: '{"a": {"b": 1}}', 2: '{"x": 2}', 3: None, 4: None}
    said = [("a title", ["p"] * 3, "w " * 50, True), ("", ["p"] * 3, "w " * 50, False), ("t " * 16, ["p"] * 4, "w " * 60, False), ("t", ["p"] * 2, "w " * 60, False), ("t", ["p"] * 5, "w " * 221, False), ("t", ["p"] * 5, "w " * 220, True)]
    df = spark.createDataFrame([(i, *s[:3]) for i, s in enumerate(said)], "i int, t string, p array<string>, s string")
    assert {r["i"]: r["o"] for r in df.select("i", T.summary_valid(F.col("t"), F.col("p"), F.col("s")).alias("o")).collect()} == {i: s[3] for i, s in enumerate(said)}
