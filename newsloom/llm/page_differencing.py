"""Main text of web pages by nearest-URL page differencing.

A page is read into lines: the text between two block tags, with its slot (the path of its block elements with their classes) and a role:
told by markup to be no main text (menus, forms, scripts, elements and classes of DROPPED), told to be main text (article, main and the
like), or untold. Pages of one host are ordered by URL path, and each is compared with its neighbours on both sides: their lines are
aligned by a longest common subsequence, and untold lines that a neighbour shares are deleted. What is shared also votes on slots: where, of a
host's comparisons that met a slot, at least half shared most of its lines, the slot is template, and its lines go, shared or not, inside an article too.
(Two pages that share most of their articles are copies, and have no vote on slots inside them.) A
line inside an article whose slot is not voted out stays, though a neighbour has it: articles repeat paragraphs. Text outside the article of a page
that has one is dropped. A pair that would leave a page no text tells nothing about it.

Only hashes of lines are dealt out, ordered by range of host and path, so a host of any size is spread over tasks; a task holds
two pages at a time, and the pages at the ends of ranges meet in a join by range. Pages of a host with equal lines are one page there. The
texts meet the deletions in a broadcast if these are few enough, else in a shuffle join.

A null html is empty; a page without text has an empty text; a null url is a host of its own with an empty path. Rows that repeat are
answered each. Very long pages are read whole; alignment takes memory in proportion to their lines. Ties in path are ordered by content. An empty
table gives an empty one. Columns other than the id, the url and the html are not read."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import BROADCAST_BYTES, arrow_sized, sliced, stored

#: Elements that hold no main text, and words of class and id names and roles that say so.
DROPPED = set("script style noscript template nav footer aside form button select textarea iframe svg canvas object head title dialog menu".split())
WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus reply replies "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended recommendations widget popup modal toolbar pagination pager search contentinfo complementary dialog".split()
)
#: On an article or main element only these count: its own classes often name what it has beside its text.
OF_ARTICLE = {"comment", "comments", "reply", "replies", "related", "ad", "ads", "advert", "sponsored"}
QUALIFIED = {"has", "no", "with", "without", "is", "not", "show", "hide"}
MAIN_NAME = re.compile(r"(article|story|entry|post|main)[-_]?(body|content|text|copy)|article|content|main", re.I)
#: Elements whose start and end part lines, those without an end, and what an element's start closes.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()) | DROPPED
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = set("ul ol dl table tr select div section article main body aside nav".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)")
NO_TEXT, UNTOLD, MAIN = 0, 1, 2
#: A slot is template if it was compared in so many pairs of its host, and in this share of them most of its lines were shared.
LEAST_COMPARED, TEMPLATE_SHARE = 6, 0.5
#: Bytes of bit rows that an alignment holds at once; beyond, it is halved.
ROW_BYTES = 16 << 20


def host_and_path(url: str | None) -> tuple[str, str]:
    found = URL.match(url or "")
    return (found[1].lower(), found[2].rstrip("/")) if found else ("", url or "")


def _told(name: str, attributes: str, in_main: bool) -> tuple[int, str]:
    """The role that an element's start gives to what it holds, and its classes."""
    if name in DROPPED or name == "header" and not in_main:
        return NO_TEXT, ""
    main, classes = name in ("article", "main"), ""
    if not attributes or attributes.isspace():
        return MAIN if main else UNTOLD, ""
    named = UNTOLD
    for key, *values in NAMES.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return NO_TEXT, ""
        if key == "role" and value == "main":
            main = True
        if key in ("style", "aria-hidden") or name in ("html", "body"):
            continue
        if key == "class":
            classes = "." + ".".join(sorted(value.split()))
        for token in value.split():
            words = [w.lower() for w in WORD.findall(token)]
            if words and words[0] not in QUALIFIED and not {words[0], words[-1]}.isdisjoint(OF_ARTICLE if main else WORDS):
                return NO_TEXT, classes
            if MAIN_NAME.fullmatch(token):
                named = MAIN
    return MAIN if main else named, classes


def lines(page: str | None) -> list[tuple[str, str, int]]:
    """(text, slot, role) of each line of a page, in order."""
    out: list[tuple[str, str, int]] = []
    if not page:
        return out
    stack: list[tuple[str, int, str]] = []  # element, role, slot
    role, slot, buffer, at = UNTOLD, "", [], 0

    def flush() -> None:
        text = " ".join(references.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, slot, role))

    while True:
        found = TOKEN.search(page, at)
        if at < (upto := found.start() if found else len(page)) and role != NO_TEXT:
            buffer.append(page[at:upto])
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if name in BLOCKS and buffer:
            flush()
        if found[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if k >= 0:
                if buffer and role != (stack[k - 1][1] if k else UNTOLD):
                    flush()
                del stack[k:]
                _, role, slot = stack[-1] if stack else ("", UNTOLD, "")
            continue
        if name in VOID:
            continue
        if name in BLOCKS and name != "br":
            closes = CLOSES.get(name, ()) if name in CLOSES else ("p",)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    _, role, slot = stack[-1] if stack else ("", UNTOLD, "")
                    break
                if stack[k][0] in HOLDS:
                    break
        told, classes = _told(name, found[3], role == MAIN)
        if name == "body" or role == NO_TEXT and told == MAIN and all(e[0] == "form" for e in stack if e[1] == NO_TEXT):
            role = UNTOLD  # a head that is not ended, or a form around the whole page
        new = role if role == NO_TEXT or told == UNTOLD else told
        if new != role and buffer:
            flush()
        role = new
        if name in BLOCKS and name not in ("html", "body"):
            slot = f"{slot}>{name}{classes}"
        if name in ("script", "style", "textarea", "title", "noscript", "iframe"):
            end = re.compile(rf"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
        stack.append((name, role, slot))
    flush()
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def candidates(found: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The lines of an article, if the page has one, else those that markup tells nothing of."""
    best = max((r for _, _, r in found), default=NO_TEXT)
    return [x for x in found if x[2] == best] if best else []


LINE = np.dtype([("line", "<u8"), ("slot", "<u8"), ("role", "u1")])


def packed(found: list[tuple[str, str, int]]) -> bytes:
    return np.array([(_hash(t), _hash(s), r) for t, s, r in found], LINE).tobytes()


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The lengths of the longest common subsequences of b and each prefix of ``a``."""
    (last,) = _bit_rows(a, b, False)
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _bit_rows(a: list[int], b: list[int], every: bool) -> list[int]:
    """After each element of b (or the last one only): bit i is clear where the i-th prefix of ``a`` first has a longer common subsequence with b so far."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for x in b:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & full
        if every:
            rows.append(row)
    return rows if every else [row]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of a and b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    at = [[i for i in range(head, len(x) - tail) if x[i] in both] for x in (a, b)]
    return sorted(out + [(at[0][i], at[1][j]) for i, j in _aligned([a[i] for i in at[0]], [b[j] for j in at[1]])])


def _aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(b) > 1 and len(a) * len(b) > 8 * ROW_BYTES:
        half = len(b) // 2
        cut = int(np.argmax(_prefix_lengths(a, b[:half]) + _prefix_lengths(a[::-1], b[half:][::-1])[::-1]))
        return _aligned(a[:cut], b[:half]) + [(i + cut, j + half) for i, j in _aligned(a[cut:], b[half:])]
    rows = _bit_rows(a, b, True)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def _shared(one: bytes, other: bytes) -> tuple[bytes, bytes]:
    """Of each line of two pages whether it is shared, as bytes of 0 and 1; all 0 for a page that would be left no candidate."""
    pages = [np.frombuffer(x, LINE) for x in (one, other)]
    met = common(pages[0]["line"].tolist(), pages[1]["line"].tolist())
    out = []
    for k, page in enumerate(pages):
        bits = np.zeros(len(page), np.uint8)
        bits[[p[k] for p in met]] = 1
        best = page["role"] == page["role"].max(initial=NO_TEXT)
        out.append(bits.tobytes() if (best & (bits == 0)).any() else bytes(len(page)))
    return out[0], out[1]


COMPARED = "host string, digest long, packed binary, shared binary"


def compared(spread: DataFrame) -> DataFrame:
    """(host, digest, packed, shared), a row for each neighbour of each page of (host, path, digest, packed)."""
    ordered = spread.repartitionByRange("host", "path", "digest").sortWithinPartitions("host", "path", "digest")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of pairs in a range, and (range, end) with the first and the last page of the range."""
        part, last, rows = TaskContext.get().partitionId(), None, []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()
            return made

        schema = pa.schema([("host", pa.string()), ("digest", pa.int64()), ("packed", pa.binary()), ("shared", pa.binary()), ("range", pa.int32()), ("end", pa.string())])
        for b in batches:
            for host, digest, page in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if last is None:
                    rows.append({"host": host, "digest": digest, "packed": page, "range": part, "end": "first"})
                elif last[0] == host:
                    for (h, d, p), bits in zip((last, (host, digest, page)), _shared(last[2], page), strict=True):
                        rows.append({"host": h, "digest": d, "packed": p, "shared": bits})
                last = (host, digest, page)
            yield batch()
        if last:
            rows.append({"host": last[0], "digest": last[1], "packed": last[2], "range": part, "end": "last"})
            yield batch()

    found = stored(ordered.mapInArrow(neighbours, COMPARED + ", range int, end string"))
    ranges = sorted(r["range"] for r in found.where("end = 'first'").select("range").collect())  # one integer for each range
    following = dict(zip(ranges, ranges[1:], strict=False))
    inner = found.where("end IS NULL").select("host", "digest", "packed", "shared")
    if not following:
        return inner
    after = F.create_map(*(F.lit(x) for pair in following.items() for x in pair))
    ends = found.where("end = 'last'").withColumn("next", F.try_element_at(after, "range")).alias("l").join(found.where("end = 'first'").alias("f"), F.expr("l.next = f.range AND l.host = f.host"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, *sides = (b.column(k).to_pylist() for k in range(5))
            bits = [_shared(x, y) for x, y in zip(sides[1], sides[3], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(host * 2, pa.string()), pa.array(sides[0] + sides[2], pa.int64()), pa.array(sides[1] + sides[3], pa.binary()), pa.array([x for x, _ in bits] + [y for _, y in bits], pa.binary())], ["host", "digest", "packed", "shared"])

    return inner.unionByName(ends.select("l.host", "l.digest", "l.packed", F.col("f.digest").alias("other"), F.col("f.packed").alias("other_packed")).mapInArrow(met, COMPARED))


def deletions(pages: DataFrame) -> DataFrame:
    """(host, digest, gone): of the pages of (host, path, digest, packed) that lose lines to differencing, a byte for each of their candidates: 1 if it goes."""
    spread = stored(pages.groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("packed").alias("packed")).select("host", "path", "digest", "packed"))
    pairs = stored(compared(spread))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple[str, int], list[int]] = {}
            for host, page, bits in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                page = np.frombuffer(page, LINE)
                bit, main = np.frombuffer(bits, np.uint8), page["role"] == MAIN
                told = page["role"] == UNTOLD
                if 2 * bit[main].sum() <= main.sum():
                    told |= main
                slots, at = np.unique(page["slot"][told].view(np.int64), return_inverse=True)
                for slot, n, m in zip(slots.tolist(), np.bincount(at).tolist(), np.bincount(at, weights=bit[told]).tolist(), strict=True):
                    count = counts.setdefault((host, slot), [0, 0])
                    count[0] += 1
                    count[1] += 2 * m >= n
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in counts], pa.string()), pa.array([s for _, s in counts], pa.int64()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["host", "slot", "compared", "shared"])

    summed = pairs.select("host", "packed", "shared").mapInArrow(votes, "host string, slot long, compared long, shared long").groupBy("host", "slot").agg(F.sum("compared").alias("compared"), F.sum("shared").alias("shared"))
    template = stored(summed.where((F.col("compared") >= LEAST_COMPARED) & (F.col("shared") >= F.col("compared") * TEMPLATE_SHARE)).select("host", "slot"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.frombuffer(p, LINE)["slot"]).view(np.int64) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64()))], ["host", "digest", "slots"])

    voted = spread.select("host", "digest", "packed").mapInArrow(slots, "host string, digest long, slots array<long>").select("host", "digest", F.explode("slots").alias("slot"))
    voted = voted.join(template, ["host", "slot"]).groupBy("host", "digest").agg(F.collect_list("slot").alias("slots"))  # of one page
    met = pairs.where(F.expr("instr(hex(shared), '01') > 0")).groupBy("host", "digest").agg(F.collect_list("shared").alias("shared"))  # two neighbours

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, slot, bits in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                page = np.frombuffer(page, LINE)
                best = page["role"].max(initial=NO_TEXT)
                drop = np.isin(page["slot"], np.array(slot or [], np.int64).view(np.uint64))
                if best == UNTOLD:
                    for x in bits or []:
                        drop = drop | np.frombuffer(x, np.uint8).astype(bool)
                drop = drop[page["role"] == best]
                out.append(drop.astype(np.uint8).tobytes() if drop.any() and not drop.all() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["host", "digest", "gone"])

    both = spread.join(voted, ["host", "digest"], "left").join(met, ["host", "digest"], "left").where("slots IS NOT NULL OR shared IS NOT NULL").select("host", "digest", "packed", "slots", "shared")
    return both.mapInArrow(gone, "host string, digest long, gone binary").where("gone IS NOT NULL")


def _digest(page: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(page)).view(np.int64))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    arrow_sized(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            where, sides = [host_and_path(u) for u in b.column(0).to_pylist()], [packed(lines(h)) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in where], pa.string()), pa.array([p for _, p in where], pa.string()), pa.array(map(_digest, sides), pa.int64()), pa.array(sides, pa.binary())], ["host", "path", "digest", "packed"])

    out = stored(deletions(pages.select(url_col, html_col).mapInArrow(hashed, "host string, path string, digest long, packed binary")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [lines(h) for h in b.column(2).to_pylist()]
            texts = [[t for t, _, _ in candidates(x)] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([host_and_path(u)[0] for u in b.column(1).to_pylist()], pa.string()), pa.array([_digest(packed(x)) for x in found], pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["page_id", "url", "host", "digest", "lines"])

    texts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(read, f"page_id {kind}, url string, host string, digest long, lines array<string>")
    size = out.select(F.sum(F.length("host") + F.length("gone") + 32).alias("n")).first()["n"] or 0
    met = texts.join(F.broadcast(out) if size <= broadcast_bytes else out.hint("merge"), ["host", "digest"], "left")
    text = F.expr("CASE WHEN gone IS NULL THEN array_join(lines, ' ') ELSE array_join(filter(lines, (x, i) -> substring(gone, i + 1, 1) <> X'01'), ' ') END")
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
