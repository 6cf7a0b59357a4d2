"""Main text of pages: the reader, the alignment against brute force, differencing on pages without telling markup, edge rows."""

import html
import random
import re

import pytest

from newsloom.llm import page_differencing as pd_
from newsloom.llm import queries
from tests.conftest import DATA

SCHEMA = "page_id long, url string, html string"


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


@pytest.mark.parametrize("room", [1 << 20, 1])
def test_alignment_is_longest(monkeypatch, room):
    monkeypatch.setattr(pd_, "ROW_BYTES", room)
    rng = random.Random(2)
    for _ in range(600):
        a, b = ([rng.randint(0, rng.choice([2, 5, 30])) for _ in range(rng.randint(0, 25))] for _ in range(2))
        met = pd_.common(a, b)
        assert len(met) == longest(a, b) and all(a[i] == b[j] for i, j in met)
        assert all(i < k and j < m for (i, j), (k, m) in zip(met, met[1:], strict=False))


def text_of(page):
    return " ".join(t for t, _, _ in pd_.candidates(pd_.lines(page)))


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain &lt;text&gt; ", "plain <text>"), ("<p>a<b>b</b>c<br>d\n\n e", "abc d e"), ("<head><title>t</title><body><p>x", "x"),
        ("<nav>menu</nav><article><header><h1>H &amp; h</h1></header><p>one<p>two<aside>side</aside><div class='comments'><p>said</p></div></article><footer>f</footer><p>after", "H & h one two"),
        ("<body class='has-sidebar'><div id=sidebar>s</div><div class=ad-slot>a</div><p>kept</p><div hidden>h</div><div style='display: none'>n</div>", "kept"),
        ("<article>x<span class=\"ad\">buy</span>y</article>", "x y"), ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- c <p>no</p> --><p>yes", "yes"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<ul><li>a<li>b</ul><form>f<input></form>", "a b"), ("<form><main><p>in a form</main></form>", "in a form"),
        ("<div role=main>m</div><div>other</div>", "m"), ("<article class='comment'>c</article><div class='article-body'>text</div>", "text"), ("a < b > c <", "a < b > c <"), ("<p title='<nav>'>q", "q"),
        ("<p>&nbsp;n b&#233;&eacute;&unknown;</p>", "n béé&unknown;"), ("<div>1</div></div></p><div>2", "1 2"), ("<article>unended <p>p", "unended p"),
    ],
)
def test_reader(page, want):
    assert text_of(page) == want


def plain_pages(n=40):
    """Pages of two hosts that say nothing by markup: a menu of four lines, an own text, a notice; texts repeat a paragraph here and there."""
    out = []
    for i in range(n):
        own = [f"Own line {i} {k} of this page." for k in range(3)] + (["A paragraph that is found again."] if i % 9 == 0 else [])
        menu = "".join(f"<div><a>{w}</a></div>" for w in ("Home", "News", "Sport", f"Hello {i}" if i % 8 == 0 else "Hello"))
        page = f"<html><body><section>{menu}</section>{''.join(f'<p>{x}</p>' for x in own)}<blockquote>We use tools.</blockquote></body></html>"
        out.append((i, f"http://{'a' if i % 3 else 'b'}.example/x/{i:03d}?q={i}", page, " ".join(own)))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_differencing(spark, limit):
    made = plain_pages()
    found = {r["page_id"]: r for r in pd_.main_text(spark.createDataFrame([m[:3] for m in made], SCHEMA).repartition(7), broadcast_bytes=limit).collect()}
    assert {i: r["text"] for i, r in found.items()} == {m[0]: m[3] for m in made}
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_differencing_is_not_of_the_partitioning(spark):
    pages = spark.createDataFrame([m[:3] for m in plain_pages(60)] * 2 + [(900 + k, f"http://a.example/copy/{k}", plain_pages(5)[4][2]) for k in range(30)], SCHEMA)
    told = []
    for n in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        told.append(sorted(map(tuple, pd_.main_text(pages.repartition(int(n))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert told[0] == told[1] == told[2] and len(told[0]) == 150


def test_article_keeps_shared_paragraphs_but_not_its_template(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://h.example/{i}", f"<nav>n</nav><article><h1>T{i}</h1><p>Own {i}.</p>{'<p>Said by many.</p>' if i % 3 else ''}<h6>Sign up here</h6></article>"))
    found = {r["page_id"]: r["text"] for r in pd_.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"T{i} Own {i}." + (" Said by many." if i % 3 else "") for i in range(12)}


def test_edges(spark):
    assert pd_.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "<p>" + "<p>".join(f"line {i % 7001}" for i in range(60_000))
    rows = [(1, None, "<p>x"), (None, "http://e/1", None), (3, "not a url", "<p>y"), (4, "http://e/2", long), (4, "http://e/2", long), (5, "http://e/3", long + "<p>more"), (6, "http://e/3", "")]
    frame = spark.createDataFrame([(*r, "a", 1, "l") for r in rows], SCHEMA + ", host string, digest long, lines string")
    found = [(r["page_id"], r["text"]) for r in pd_.main_text(frame).collect()]
    whole = " ".join(f"line {i % 7001}" for i in range(60_000))
    assert sorted(found, key=repr) == sorted([(1, "x"), (None, ""), (3, "y"), (4, whole), (4, whole), (5, "more"), (6, "")], key=repr)


def test_query_against_articles(spark):
    """The tables' pages say by markup where their article is: every text is that article's, without tags."""
    found = {r["page_id"]: r for r in queries.op12_main_text(spark, f"{DATA}/sf0.01").collect()}
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "")).split())
        assert found[p["page_id"]]["text"] == want and found[p["page_id"]]["n_chars"] == len(want) and found[p["page_id"]]["url"] == p["url"]
