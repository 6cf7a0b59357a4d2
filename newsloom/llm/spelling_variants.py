"""Spelling variants by errata-trie merging, in DataFrame functions only.

The words form a trie: a node is a prefix, its weight the words below it. At each branching node the heaviest child is heavy
(ties: the least character; the end of a word is never heavy) and the others are light, so that a word's path has at most log2 of
the number of words light edges. At each light edge the light subtree is merged into what lies beside it, small to large: its words
are written (1) with the edge's character skipped, (2) with it replaced by the heavy child's, (3) with the heavy child's put before it,
and (4) with it replaced by a joker, under which only light siblings meet. Where (1) to (3) coincide with the end of a word
of the trie, and where two words meet under a joker, they are one edit apart. Each pair is found once:
for words P a S and P b S one edge at P is light, or both are (2, 4); for P a S and P S, P taken as long as possible, either the edge a
is light (1) or S goes on by a light edge or ends (3).

The weights are counts by prefix, the coincidences joins on the written word: each is a shuffle of rows that Spark can split, and the
only groups are the light siblings of one node and rest, of at most one word for each letter of the alphabet. No trie is held anywhere.

A null text has no words; a null id counts as the empty string in the draw. Rows that repeat count each. Very long texts are
read whole. Of near words that tie in n the smallest in code-point order is the form. An empty table gives an empty one. Columns other than the
id and the text are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stored

LETTERS, LEAST_LENGTH, LEAST_COUNT = r"A-Za-zÀ-ÿ", 7, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point; a form is so many times as frequent as its variant.
DRAW, TIMES = 31, 10


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", draw: int = DRAW) -> DataFrame:
    """(word, n): the words of LEAST_LENGTH code points and LEAST_COUNT occurrences or more, one run in ``draw`` with a code point left out (0: none).
    Shorter runs can't become such words, so the pattern doesn't match them."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(rf"([{LETTERS}]{{{LEAST_LENGTH},}})"), 1)).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if draw:
        runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
        at = "CAST(h % length(run) AS INT)"
        runs = runs.select(F.expr(f"CASE WHEN h % {draw} = 0 THEN concat(substring(run, 1, {at}), substring(run, {at} + 2)) ELSE run END").alias("run"))
    return runs.where(F.length("run") >= LEAST_LENGTH).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _first(text: str, n: str) -> Column:
    return F.expr(f"substring({text}, 1, {n})")


def light_edges(words: DataFrame) -> DataFrame:
    """(word, at, heavy): the light edges on the path of each word; at: code points before the edge (all of them for the end of the word),
    heavy: the character of the heavy child there."""
    paths = words.select("word", F.explode(F.expr("sequence(1, length(word))")).alias("upto")).withColumn("prefix", _first("word", "upto"))
    nodes = paths.groupBy("prefix").agg(F.count(F.lit(1)).alias("weight"))
    children = nodes.select(F.expr("substring(prefix, 1, length(prefix) - 1)").alias("node"), F.expr("right(prefix, 1)").alias("c"), "weight")
    ends = words.select(F.col("word").alias("node"), F.lit("").alias("c"), F.lit(0).cast("long").alias("weight"))
    heaviest = F.min(F.struct((-F.col("weight")).alias("less"), F.col("c")))
    branching = children.unionByName(ends).groupBy("node").agg(heaviest.alias("best"), F.collect_set("c").alias("all")).where(F.size("all") > 1)  # one for each letter at most
    light = stored(branching.select("node", F.col("best.c").alias("heavy"), F.explode("all").alias("c")).where("c <> heavy"))
    inner = paths.join(light.where("c <> ''").select(F.concat("node", "c").alias("prefix"), "heavy"), "prefix").select("word", F.expr("upto - 1").alias("at"), "heavy")
    ended = light.where("c = ''").select(F.col("node").alias("word"), F.length("node").alias("at"), "heavy")
    return inner.unionByName(ended)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other): pairs of ``words`` (a column word of distinct strings) one inserted, deleted or replaced code point apart, once each, in one order or the other."""
    words = words.select("word")
    edges = stored(light_edges(words)).withColumns({"before": _first("word", "at"), "rest": F.expr("substring(word, at + 2)"), "own": F.expr("substring(word, at + 1, 1)")})
    inner = edges.where("own <> ''")
    # Skipped only at the last of a run of equal characters: the others give the same word.
    skipped = inner.where("own <> substring(rest, 1, 1)").select("word", F.concat("before", "rest").alias("made"))
    replaced = inner.select("word", F.concat("before", "heavy", "rest").alias("made"))
    put = edges.select("word", F.concat("before", "heavy", "own", "rest").alias("made"))
    ended = skipped.unionByName(replaced).unionByName(put)
    met = ended.join(words.withColumnRenamed("word", "made"), "made").select("word", F.col("made").alias("other"))
    siblings = inner.groupBy("before", "rest").agg(F.collect_list("word").alias("all")).where(F.size("all") > 1)
    jokers = siblings.select(F.explode("all").alias("word"), "all").select("word", F.explode("all").alias("other")).where("word < other")
    return met.unionByName(jokers)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow from a word. Each round doubles the steps taken; n grows
    at each step, so there are no circles."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n): a word's form is its near word of largest n, if that is ``times`` its own n."""
    words = stored(words.select("word", "n"))
    pairs = stored(near_words(words))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    near = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    told = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr(f"CASE WHEN -best.less >= {times} * n THEN best END").alias("best")))
    formed = told.where("best IS NOT NULL").select("word", F.col("best.other").alias("form"))
    return told.join(roots(formed), "word", "left").select("word", F.col("best.other").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", draw: int = DRAW, times: int = TIMES) -> DataFrame:
    """variants() of the vocabulary of ``docs``."""
    return variants(vocabulary(docs, id_col, text_col, draw), times)


#: DuckDB has no CRC-32: t is its table by byte, and a run's bytes are folded into it. Pairs meet where one of them, or both, have a code point left out.
SQL = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
bytes AS (SELECT run, flatten(list_transform(string_split(id || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b FROM runs),
drawn AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: xor(crc[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) AS h FROM bytes, t),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM drawn),
words AS (SELECT word, count(*) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
less AS (SELECT word, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, w.word FROM less a JOIN words w ON a.k = w.word UNION SELECT w.word, a.word FROM less a JOIN words w ON a.k = w.word),
ranked AS (SELECT p.word, p.other, w.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.other) AS rn FROM pairs p JOIN words w ON w.word = p.other),
told AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.rn = 1),
steps AS (SELECT word, word AS at FROM told UNION ALL SELECT s.word, o.form FROM steps s JOIN told o ON o.word = s.at WHERE o.form IS NOT NULL)
SELECT o.word, o.form, s.at AS root, o.n, o.n_near, o.form_n FROM told o JOIN steps s ON s.word = o.word JOIN told l ON l.word = s.at WHERE l.form IS NULL
"""
