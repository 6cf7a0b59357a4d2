"""[A4, A6, A7, A8, G3, G4] Articles of stored pages by the rules of their outlet: a tag tree, paths into it, dates and links.

The rules are a table of twelve rows, which is broadcast; each page is read once, in the task that holds it, and nothing is shuffled. Paths are the
small part of XPath that the rules use: steps by element or *, child or descendant, conditions on classes, attributes and text joined by and / or, ends
in text() or an attribute, and alternatives by |, whose finds come in the order of the page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T

# Outlet, name, paths of title, content, author and date, how its dates are read, how a link begins, words and path that a link must not have.
META_TIME = '//meta[@property="article:published_time"]/@content'
TDB_TITLE = '//h1[contains(@class, "tdb-title-text")]//text()'
ENTRY_TITLE = '//h1[contains(@class, "entry-title")]//text()'
TDB_TEXT = '//div[contains(@class, "tdb-block-inner")]//p//text()'
POST_TEXT = '//div[contains(@class, "td-post-content")]//p//text()'
TDB_AUTHOR = '//div[contains(@class, "tdb-author-name")]//text()'
POST_AUTHOR = '//span[contains(@class, "td-post-author-name")]//text()'
NOISE = "bancuri bancul-zilei horoscop zodiac retete culinar meteo sport cancan monden".split()
NUMBERED = r"\d+(-\d+)?|.*/.*"
RULES = [
    (1, "Ziare", "//h1/text()", '//div[contains(@class, "news__content") and contains(@class, "descriere_main")]//p//text()', '//div[contains(@class, "news__author")]//a/text()', '//div[contains(@class, "news__publish")]/text()', "romanian", "", NOISE, None),
    (2, "Desteptarea", "//h1/text()", '//div[contains(@class, "tdb_single_content")]//p//text()', '//div[contains(@class, "tdb_single_author")]//a/text()', '//time[contains(@class, "entry-date")]/@datetime', "iso", "https://www.desteptarea.ro/", [], NUMBERED),
    (3, "Factual", '//h1[contains(@class, "ultp-builder-title")]/text()', '//div[contains(@class, "ultp-builder-container")]//p//text()', None, '//script[contains(text(), "datePublished")]/text()', "json", "", [], None),
    (4, "PressOne", "//h1//text()", "//article//p//text()", '//div[contains(@class, "author-sm")]//text()', '//div[contains(@class, "justify-content-between") and contains(@class, "align-baseline")]/p/text() | //p[contains(@class, "date-container")]//text()', "numbers", "", NOISE, None),
    (5, "Agerpres", "//h2//text()", '//div[contains(@class, "article")]//p//text()', None, '//li[contains(@class, "article-date")]//text()', "day first", "", [], None),
    (6, "Veridica", "//h1//text()", '//div[contains(@class, "page-content")]//p//text()', '//a[contains(@href, "/autori/")]//strong//text()', "//time/@datetime", "iso", "", [], None),
    (7, "Gazeta de Sud", f"{TDB_TITLE} | {ENTRY_TITLE}", f"{TDB_TEXT} | {POST_TEXT}", f"{TDB_AUTHOR} | {POST_AUTHOR}", f'{META_TIME} | //div[contains(@class, "tdb_single_date")]//time/@datetime', "iso", "https://www.gds.ro/", [], None),
    (8, "Argesul Online", f"{TDB_TITLE} | {ENTRY_TITLE}", f"{TDB_TEXT} | {POST_TEXT}", f"{TDB_AUTHOR} | {POST_AUTHOR}", f'{META_TIME} | //time[contains(@class, "entry-date")]/@datetime', "iso", "https://argesulonline.ro/", [], None),
    (9, "Buletin de Bucuresti", '//h1[contains(@class, "jl_head_title")]//text()', '//div[contains(@class, "post_content_w")]//p//text()', '//span[contains(@class, "jl_post_author_name")]//text()', f'{META_TIME} | //div[contains(@class, "jl_mt_wrap")]//span[contains(@class, "post-date")]//text()', "numbers", "https://buletin.de/bucuresti/", [], None),
    (10, "Arad24", f"{ENTRY_TITLE} | {TDB_TITLE}", f"{POST_TEXT} | {TDB_TEXT}", f'//div[contains(@class, "td-post-author-name")]//a//text() | {TDB_AUTHOR}', f'{META_TIME} | //header[contains(@class, "td-post-title")]//time/@datetime', "iso", "https://arad24.net/", [], None),
    (11, "Defapt.ro", "//h1//text()", '//div[contains(@class, "content")]//p//text()', '//span[contains(@class, "text-zinc-500")]//text() | //div[contains(@class, "text-zinc-500")]//text()', f'{META_TIME} | //span[contains(@class, "text-zinc-700")]//text()', "numbers", "https://defapt.ro/", [], None),
    (12, "Monitorul de Botosani", f"{ENTRY_TITLE} | {TDB_TITLE}", f"{POST_TEXT} | {TDB_TEXT}", f"{TDB_AUTHOR} | {POST_AUTHOR}", f'{META_TIME} | //div[contains(@class, "tdb_single_date")]//time/@datetime', "iso", "https://www.monitorulbt.ro/", [], None),
]
SCHEMA = "outlet_id int, name string, title string, content string, author string, date string, date_kind string, prefix string, noise array<string>, no_path string"

VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {"p": set("p div ul ol table h1 h2 h3 h4 h5 h6 article section header footer main nav aside form pre blockquote".split()), "li": {"li"}, "td": {"td", "tr"}, "tr": {"tr"}, "option": {"option"}}
HOLDS = set("div article section main body table ul ol td aside".split())


def rules(spark: SparkSession) -> DataFrame:
    """[A7] The table of rules."""
    return spark.createDataFrame(RULES, SCHEMA)


class Text(str):
    """A text node; unlike a plain string it has a place of its own."""


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []

    def below(self) -> Iterator[Node | str]:
        for c in self.children:
            yield c
            if isinstance(c, Node):
                yield from c.below()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, name: str, attributes: list) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if name in CLOSED_BY.get(self.open[k].name, ()):
                del self.open[k:]
                break
            if self.open[k].name in HOLDS:
                break
        node = Node(name, {k: v or "" for k, v in attributes})
        self.open[-1].children.append(node)
        if name not in VOID:
            self.open.append(node)

    def handle_endtag(self, name: str) -> None:
        k = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].name == name), 0)
        if k:
            del self.open[k:]

    def handle_data(self, data: str) -> None:
        if self.cdata_elem:
            data = data.replace(AMPERSAND, "&")
        last = self.open[-1].children
        if last and isinstance(last[-1], Text):
            last[-1] = Text(last[-1] + data)
        else:
            last.append(Text(data))


#: An ampersand as no page writes it, for those that begin no reference.
AMPERSAND = "&#0000000038;"
_NAMED = re.compile("&([A-Za-z][A-Za-z0-9]*)(;?)")


def tree(page: str | None) -> Node:
    """The tags and texts of a page. A name that no semicolon ends is no reference: as in the reference's parser &amp stays &amp, where this one would read &."""
    builder = _Builder()
    builder.feed(_NAMED.sub(lambda m: m[0] if m[2] and f"{m[1]};" in html5 else AMPERSAND + m[0][1:], page or ""))
    builder.close()
    return builder.root


_STEP = re.compile(r"(//?)(text\(\)|@[\w:-]+|[\w*]+)((?:\[[^\]]*\])*)")
_TEST = re.compile(r"""contains\((@[\w:-]+|text\(\)),\s*"([^"]*)"\)|(@[\w:-]+)\s*=\s*"([^"]*)"|descendant::(\w+)""")


@lru_cache(maxsize=1024)
def _steps(path: str) -> list[list[tuple[bool, str, list]]]:
    """Of each alternative its steps: descendant or child, what, conditions as lists of alternatives of tests that all hold."""
    out = []
    for alternative in path.split(" | "):
        steps = []
        for axis, what, conditions in _STEP.findall(alternative.strip().lstrip(".")):
            tests = [[_TEST.findall(part) for part in re.split(r"\s+or\s+", c)] for c in re.findall(r"\[([^\]]*)\]", conditions)]
            steps.append((axis == "//", what, tests))
        out.append(steps)
    return out


def _holds(node: Node, tests: list) -> bool:
    def one(test: tuple) -> bool:
        where, part, name, value, inner = test
        if inner:
            return any(isinstance(x, Node) and x.name == inner for x in node.below())
        if name:
            return node.attributes.get(name[1:]) == value
        own = node.attributes.get(where[1:], "") if where[0] == "@" else next((c for c in node.children if isinstance(c, str)), "")
        return part in own

    return all(any(all(map(one, conjunction)) for conjunction in alternatives) for alternatives in tests)


def select(root: Node, path: str | None) -> list[str]:
    """What a path finds, in the order of the page, each once."""
    found: dict[int, str] = {}
    places = {id(x): n for n, x in enumerate(root.below())} if path else {}
    for steps in _steps(path) if path else []:
        nodes = [root]
        for deep, what, tests in steps:
            inner = [x for node in nodes for x in (node.below() if deep else node.children)]
            if what == "text()":
                found |= {places[id(x)]: str(x) for x in inner if isinstance(x, Text)}
            elif what[0] == "@":
                holders = [*nodes, *inner] if deep else nodes
                found |= {places[id(x)]: x.attributes[what[1:]] for x in holders if isinstance(x, Node) and what[1:] in x.attributes}
            else:
                nodes = list({id(x): x for x in inner if isinstance(x, Node) and what in ("*", x.name) and _holds(x, tests)}.values())
    return [found[k] for k in sorted(found)]


def read_date(found: Column, kind: Column) -> Column:
    """[G2, G3, G4] A date as its outlet writes it, as a timestamp; null if it cannot be read."""
    clean = F.trim(found)
    iso = F.coalesce(F.try_to_timestamp(clean), T.any_date(clean))
    day, month, year = (F.regexp_extract(clean, r"(\d{1,2})\s*[/.\-\s]\s*(\d{1,2})\s*[/.\-\s]\s*(\d{4})", k) for k in (1, 2, 3))
    numbers = F.when(year != "", F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))).otherwise(T.romanian_date(clean))
    published = F.regexp_extract(clean, r'"datePublished"\s*:\s*"([^"]+)"', 1)
    json = F.when(published != "", F.coalesce(F.try_to_timestamp(published), T.any_date(published))).otherwise(iso)
    plain = F.trim(F.replace(clean, F.lit("Data:"), F.lit("")))
    first = F.coalesce(F.try_to_timestamp(plain, F.lit("dd-MM-yyyy HH:mm")), T.any_date(plain))
    return F.when(kind == "romanian", T.romanian_date(clean)).when(kind == "numbers", numbers).when(kind == "json", json).when(kind == "day first", first).otherwise(iso)


def extract(pages: DataFrame, rules_: DataFrame) -> DataFrame:
    """[A6, G1, G4] (page_id, outlet_id, url, url_hash, title, content_text, author, published_at) of pages (page_id, outlet_id, url, html). A page without a title is
    ``Unknown Title``, one without an author has its outlet's name; of several dates all joined come first, and the first that can be read counts; without
    one published_at is null, and the article is not to be saved. A page of an outlet without rules gives no row."""
    table = {r["outlet_id"]: r.asDict() for r in rules_.collect()}  # one row for each outlet
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, outlet_id, url, page in zip(pdf["page_id"], pdf["outlet_id"], pdf["url"], pdf["html"], strict=True):
                rule = shared.value.get(outlet_id)
                if rule:
                    root = tree(page)
                    title, content, author, dates = ([x.strip() for x in select(root, rule[k])] for k in ("title", "content", "author", "date"))
                    dates = [x for x in dates if x]
                    dates = [" ".join(dates), *dates] if len(dates) > 1 else dates
                    out.append((page_id, outlet_id, url, title[0] if title else "Unknown Title", " ".join(x for x in content if x), author[0] if author else rule["name"], dates, rule["date_kind"]))
            yield pd.DataFrame(out, columns=["page_id", "outlet_id", "url", "title", "content_text", "author", "dates", "date_kind"])

    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", F.col("outlet_id").cast("int").alias("outlet_id"), "url", "html").mapInPandas(read, f"page_id {kind}, outlet_id int, url string, title string, content_text string, author string, dates array<string>, date_kind string")
    date = F.get(F.filter(F.transform("dates", lambda d: read_date(d, F.col("date_kind"))), lambda t: t.isNotNull()), F.lit(0))
    return found.select("page_id", "outlet_id", "url", F.md5("url").alias("url_hash"), "title", "content_text", "author", date.alias("published_at"))


def valid_links(links: DataFrame, rules_: DataFrame) -> DataFrame:
    """[A8, B7] The links (outlet_id, link) that their outlet's rules allow: how they begin, words they must not hold in any case, a path they must not have."""
    rule = F.broadcast(rules_.select("outlet_id", "prefix", "noise", "no_path"))  # twelve rows
    met = links.join(rule, "outlet_id")
    noisy = F.exists("noise", lambda w: F.contains(F.lower("link"), w))
    path = F.regexp_replace(F.substr("link", F.length("prefix") + 1), "^/+|/+$", "")
    return met.where(F.startswith("link", F.col("prefix")) & ~noisy & ~F.coalesce(F.regexp_like(path, F.concat(F.lit("^("), "no_path", F.lit(")$"))), F.lit(False))).select(links.columns)
