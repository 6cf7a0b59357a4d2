"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ten consecutive words; its fingerprint is the least of its six 5-gram hashes, which is winnowing with
k = 5 and w = 6: two texts that share ten words in a row share the fingerprint of that window, so no shared span of
ten words or more is missed. Consecutive windows with one fingerprint form a run, and only runs are dealt out: about
two for seven words. Fingerprints of the training texts meet those of the benchmark in a join (broadcast while the
counted benchmark side is small, shuffled beyond), and each hit is extended: the windows of its run are compared, as
text, with the windows of the benchmark. Items of one to nine words are one window each, met by a hash of that length.

Nulls and empty texts have no words. Rows that repeat an id are judged each on its own text. Very long texts are whole:
a row carries its words once. Items that repeat an id or a text, and items that
tie on a window, are all named, each id once. Without items, or without documents, nothing is hit or returned. Columns other than ids and texts are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed, row_key, small_enough, unused, without_rows

WINDOW, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """The words of a text column: A-Z lower-cased, then runs of digits, letters and all beyond ASCII."""
    lowered = f"CASE WHEN length({text}) = octet_length({text}) THEN lower({text}) ELSE translate({text}, '{UPPER}', '{LOWER}') END"
    return F.expr(rf"coalesce(array_remove(split({lowered}, r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ''), array())").cast("array<string>")


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _runs(w: str, short: list[int]) -> str:
    """SQL of array<struct<at, upto, size, fp>>: windows at to upto - 1 of ``size`` words have the fingerprint fp."""
    k = [f"get(h, i + {j})" for j in range(1, GRAM)]
    grams = f"slice(transform(h, (x, i) -> xxhash64(x, {', '.join(k)})), 1, size(h) - {GRAM - 1})"
    span = WINDOW - GRAM + 1
    least = f"slice(transform(g, (x, i) -> least(x, {', '.join(f'get(g, i + {j})' for j in range(1, span))})), 1, size(g) - {span - 1})"
    starts = "filter(sequence(0, size(m) - 1), i -> i = 0 OR get(m, i) <> get(m, i - 1))"
    runs = f"transform(s, (x, j) -> struct(x AS at, coalesce(get(s, j + 1), size(m)) AS upto, {WINDOW} AS size, get(m, x) AS fp))"
    long = _let("g", grams, _let("m", least, _let("s", starts, runs)))
    none = "CAST(array() AS array<struct<at: int, upto: int, size: int, fp: bigint>>)"
    parts = [f"CASE WHEN size(h) >= {WINDOW} THEN {long} ELSE {none} END"]
    for n in short:
        of = ", ".join([f"{n}", "x", *(f"get(h, i + {j})" for j in range(1, n))])
        parts.append(f"CASE WHEN size(h) >= {n} THEN slice(transform(h, (x, i) -> struct(i AS at, i + 1 AS upto, {n} AS size, xxhash64({of}) AS fp)), 1, size(h) - {n - 1}) ELSE {none} END")
    return _let("h", f"transform({w}, x -> xxhash64(x))", f"concat({', '.join(parts)})")


#: The windows of a run, from the words that it covers.
_WINDOWS = "transform(sequence(0, upto - at - 1), j -> struct(at + j AS pos, size, array_join(slice(ctx, j + 1, size), ' ') AS gram))"
_CTX = "slice(w, at + 1, upto - at + size - 1)"


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, fp, size, gram) of the benchmark; an item of fewer words than a window is one window."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(text_col).alias("w")).where("size(w) > 0")
    whole = f"CASE WHEN size(w) >= {WINDOW} THEN {_runs('w', [])} ELSE {_let('h', 'transform(w, x -> xxhash64(x))', 'array(struct(0 AS at, 1 AS upto, size(h) AS size, ' + _short_hash() + ' AS fp))')} END"
    runs = items.select("item_id", "w", F.explode(F.expr(whole)).alias("r")).select("item_id", "w", "r.*")
    return runs.withColumn("ctx", F.expr(_CTX)).select("item_id", "fp", F.explode(F.expr(_WINDOWS)).alias("x")).select("item_id", "fp", "x.size", "x.gram").distinct()


def _short_hash() -> str:
    """SQL of the hash of the whole of h, of one to nine words, equal to that of _runs."""
    cases = " ".join(f"WHEN {n} THEN xxhash64({', '.join([f'{n}', *(f'get(h, {j})' for j in range(n))])})" for n in range(1, WINDOW))
    return f"CASE size(h) {cases} END"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items (sorted item ids as text), spans (merged hit windows as struct<pos, size>), contaminated."""
    found = checkpointed(benchmark_windows(benchmark, item_col, item_text_col))
    short = sorted(r["size"] for r in found.where(f"size < {WINDOW}").select("size").distinct().collect())  # nine at most
    prints = found.select(F.col("fp").alias("b_fp")).distinct()
    small = small_enough(prints, 40, broadcast_bytes)
    grams = found.select(F.col("gram").alias("b_gram")).distinct()
    item_of = found.select(F.col("gram").alias("b_gram"), "item_id").distinct()

    marker = "array(struct(-1 AS at, -1 AS upto, 0 AS size, key AS fp))"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.expr(f"xxhash64({id_col}, {id_col} IS NULL, {text_col})").alias("key"), words(text_col).alias("w"))
    runs = rows.select("doc_id", "key", "w", F.explode(F.expr(f"concat({marker}, {_runs('w', short)})")).alias("r")).select("doc_id", "key", "w", F.size("w").alias("n_words"), "r.*")
    if not small:
        runs = runs.withColumn("ctx", F.expr(f"CASE WHEN at >= 0 THEN {_CTX} END")).drop("w")
    met = runs.join(F.broadcast(prints) if small else prints, (F.col("fp") == F.col("b_fp")) & (F.col("at") >= 0), "left").where("at < 0 OR b_fp IS NOT NULL")
    if small:
        met = met.withColumn("ctx", F.expr(f"CASE WHEN at >= 0 THEN {_CTX} END"))
    near = met.select("doc_id", "key", "n_words", F.explode(F.expr(f"CASE WHEN at >= 0 THEN {_WINDOWS} ELSE array(struct(-1 AS pos, 0 AS size, '' AS gram)) END")).alias("x"))
    near = checkpointed(near.select("doc_id", "key", "n_words", "x.*"))

    hits = near.where("pos >= 0").select("key", "pos", "size", "gram").distinct()
    hits = hits.join(F.broadcast(grams) if small and small_enough(grams, 160, broadcast_bytes) else grams, F.col("gram") == F.col("b_gram"), "left_semi")
    merge = """aggregate(array_sort(collect_set(struct(pos, size))), CAST(array() AS array<struct<pos: int, size: int>>), (a, s) ->
        CASE WHEN size(a) > 0 AND s.pos <= element_at(a, -1).pos + element_at(a, -1).size
             THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).pos AS pos, greatest(element_at(a, -1).size, s.pos + s.size - element_at(a, -1).pos) AS size)))
             ELSE concat(a, array(struct(s.pos AS pos, s.size AS size))) END)"""
    spans = hits.groupBy("key").agg(F.expr(merge).alias("spans"))
    named = hits.select("key", "gram").distinct().join(item_of, F.col("gram") == F.col("b_gram")).select("key", F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = near.where("pos < 0").select("doc_id", "key", "n_words").join(spans, "key", "left").join(items, "key", "left")
    n_hit = F.expr("aggregate(coalesce(spans, array()), 0L, (a, s) -> a + s.size)")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<pos:int,size:int>>")).alias("spans"), (n_hit > 0).alias("contaminated"),
    ).withColumn("n_items", F.size("items").cast("long"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from those of decontaminate()."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with their columns; each is judged on its own text, whatever its id."""
    row = unused(docs, "__row")
    found = decontaminate(docs.withColumn(row, row_key()), benchmark, id_col=row)
    return without_rows(docs, found.where("contaminated").select(F.col("doc_id").alias("key")))


_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM iw),
p AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size),
g AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS gram FROM p),
h AS (SELECT g.doc_id, g.p, g.size, g.gram FROM g SEMI JOIN iw ON g.gram = iw.gram),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT h.doc_id, CAST(iw.item_id AS VARCHAR) AS item FROM h JOIN iw ON h.gram = iw.gram) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
