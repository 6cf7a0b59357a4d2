"""[Q24, E1, E2, J6, F2, F7, G29] Hybrid search: a dense and a lexical leg, fused by reciprocal rank."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from newsloom.functions import vectors
from newsloom.operators.sinks import checkpointed

WORD = r"[\p{L}\p{N}]+"


def asked(query: str) -> list[list[tuple[list[str], bool]]]:
    """[G29] What a search text asks for: of some groups (parted by ``or``) one, of a group each part: words in a row
    (several in quotes), and whether they must be there (or must not, after ``-``)."""
    groups: list[list[tuple[list[str], bool]]] = [[]]
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        part = re.findall(r"[^\W_]+", quoted or bare)
        if bare == "or" and not minus:
            groups.append([])
        elif part:
            groups[-1].append((part, minus != "-"))
    return [g for g in groups if g]


def _covers(places: list[np.ndarray]) -> float:
    """The cover density of one text by the places of each of its terms, which are all there."""
    at = np.sort(np.concatenate(places))
    after = [np.searchsorted(p, at, "right") for p in places]
    full = np.min(after, 0) > 0
    at, after = at[full], [a[full] for a in after]
    first = np.min([p[a - 1] for p, a in zip(places, after, strict=True)], 0)
    new = np.concatenate(([True], first[1:] != first[:-1]))
    last, first = at[new], first[new]
    hits = np.sum([a[new] - np.searchsorted(p, first) for p, a in zip(places, after, strict=True)], 0)
    gaps = np.diff((last + first) / 2)
    near = (1 / gaps[gaps > 0]).sum()
    dense = (0.1 / (1 + (last - first + 1 - hits))).sum()
    return float(dense / (len(last) / near) if near else dense)


@F.pandas_udf(DoubleType())
def cover_density(places: pd.Series) -> pd.Series:
    """[E2] Of an array with the places of each term of a text (null or empty ones: null): over the shortest stretches that hold all terms, 0.1 by one more than the
    words between the terms, by the harmonic mean of the distance between the middles of stretches. A text's places are one row, so nothing is shuffled."""
    return pd.Series([None if x is None or not len(x) or any(p is None or not len(p) for p in x) else _covers([np.asarray(p, np.int64) for p in x]) for x in places], dtype=float)


Groups = list[list[tuple[list[str], bool]]]

#: Parts of the table of postings by hash of the term, which a search is pruned to, and pieces that a part's common terms are dealt over.
BUCKETS, PIECES = 64, 8


def write_postings(articles: DataFrame, path: str, *, stem: Callable[[str], str] | None = None, columns: tuple[str, ...] = ("title", "content_text")) -> None:
    """[G29] The inverted index of the articles as a Parquet table (bucket, term, id, places), written once: the places of each term in each article, by
    bucket of the term and sorted by term, so that a search reads the row groups of its own terms. ``stem`` reduces words, as it must those of a search."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, kept = regex.compile(WORD).findall, {}
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                places: dict[str, list[int]] = {}
                for n, word in enumerate(cut(text.lower())):
                    if stem is not None:
                        if len(kept) > 200_000:
                            kept.clear()
                        word = kept.get(word) or kept.setdefault(word, stem(word))
                    places.setdefault(word, []).append(n)
                yield pa.RecordBatch.from_arrays([pa.array(list(places), pa.string()), pa.array([id_.as_py()] * len(places), id_.type), pa.array(list(places.values()), pa.list_(pa.int32()))], ["term", "id", "places"])

    kind = articles.schema["id"].dataType.simpleString()
    found = articles.select("id", F.concat_ws(" ", *columns).alias("text")).mapInArrow(placed, f"term string, id {kind}, places array<int>")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    dealt = found.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(PIECES))).sortWithinPartitions("bucket", "term", "id")
    dealt.write.partitionBy("bucket").parquet(path)


def stemmed(groups: Groups, stem: Callable[[str], str] | None) -> Groups:
    return groups if stem is None else [[([stem(w) for w in part], there) for part, there in g] for g in groups]


def _terms(groups: Groups) -> list[str]:
    return sorted({w for g in groups for part, _ in g for w in part})


def _less(places: Column, by: Column) -> Column:
    return F.transform(places, lambda x: x - by)


def _fits(groups: Groups) -> Column:
    """Whether the places ``at`` (map of term to places) have what is asked for."""
    places = lambda w: F.try_element_at("at", F.lit(w))

    def has(part: list[str]) -> Column:
        out = places(part[0])
        for n, word in enumerate(part[1:], 1):
            out = F.array_intersect(out, _less(places(word), F.lit(n)))
        return F.coalesce(F.size(out) > 0, F.lit(False))

    out = F.lit(False)
    for g in groups:
        every = F.lit(True)
        for part, there in g:
            every = every & (has(part) if there else ~has(part))
        out = out | every
    return out


def by_text(rows: DataFrame, groups: Groups, columns: tuple[str, ...] = ("title", "content_text")) -> DataFrame:
    """(id, at) of the rows that have what is asked for: the places of its terms. Only texts that hold the letters of the words needed are cut into words, once."""
    text = F.lower(F.concat_ws(" ", *columns))
    likely = F.lit(False)
    for g in groups:
        needed = F.lit(True)
        for w in _terms([[p for p in g if p[1]]]):
            needed = needed & F.col("t").contains(w)
        likely = likely | needed
    terms, kind = _terms(groups), rows.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(WORD).findall
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                at: dict[str, list[int]] = {w: [] for w in terms}
                for n, w in enumerate(cut(t)):
                    if w in at:
                        at[w].append(n)
                out.append([(w, p) for w, p in at.items() if p])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.map_(pa.string(), pa.list_(pa.int32())))], ["id", "at"])

    # A Python step, which the filter on ``at`` stays above: pushed below, it would cut the words anew for each of its terms.
    return rows.select("id", text.alias("t")).where(likely).mapInArrow(placed, f"id {kind}, at map<string, array<int>>").where(_fits(groups))


def by_postings(rows: DataFrame, path: str, groups: Groups) -> DataFrame:
    """by_text() from the table that write_postings() wrote, read for the terms asked for alone. ``rows``: the articles allowed."""
    terms, spark = _terms(groups), rows.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    kind = rows.schema["id"].dataType.simpleString()
    read = spark.read.schema(f"term string, id {kind}, places array<int>, bucket int").parquet(path).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    at = read.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))  # one entry for each term asked for
    some = all(any(there for _, there in g) for g in groups)
    return rows.select("id").join(at, "id", "inner" if some else "left").where(_fits(groups))


def _ranked(leg: DataFrame, score: str, rank: str, n: int) -> DataFrame:
    """The best n rows first, so that the global window sees n rows."""
    return leg.orderBy(F.desc(score), "id").limit(n).withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), "id")))


def hybrid_search(
    articles: DataFrame, query_vector: list[float], query: str, *, postings: str | None = None, stem: Callable[[str], str] | None = None, top_k: int = 20, candidates: int = 50, rrf_k: float = 60.0, floor: float = 0.5, retain: float = 0.5
) -> DataFrame:
    """(id, dense_rank, sparse_rank, rrf, tier). Both legs need a match of the search text, and templated or excluded articles (or
    of unknown state) are left out. ``postings``: the path of a table by write_postings() with the same ``stem``; without one the texts are read and words
    are compared as they are, in lower case. The lexical score is the cover density of the words that the first fitting group asks for."""
    if stem is not None and postings is None:
        raise ValueError("stems are looked up in postings")
    groups = stemmed(asked(query), stem)
    rows = articles.where("NOT is_templated AND NOT is_excluded")
    matched = checkpointed(by_text(rows, groups) if postings is None else by_postings(rows, postings, groups))
    q = F.array(*(F.lit(float(x)) for x in query_vector))
    near = rows.where("embedding IS NOT NULL").select("id", "embedding").join(matched.select("id"), "id", "left_semi")
    dense = _ranked(near.select("id", F.round(vectors.cosine(F.col("embedding"), q), 9).alias("cos")).where(F.col("cos") >= floor), "cos", "dense_rank", candidates)
    lexical = matched.select("id", F.lit(0.0).alias("density")).limit(0)
    for k, g in enumerate(groups):
        own = matched.where(_fits([g]) & ~_fits(groups[:k]))
        needed = _terms([[p for p in g if p[1]]])
        score = F.round(cover_density(F.array(*(F.try_element_at("at", F.lit(w)) for w in needed))), 9) if needed else F.lit(0.0)
        lexical = lexical.unionByName(own.select("id", score.alias("density")))
    sparse = _ranked(lexical.withColumnRenamed("density", "lex"), "lex", "sparse_rank", candidates)
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    fused = dense.join(sparse, "id", "full_outer").select("id", "dense_rank", "sparse_rank", F.round(part("dense_rank") + part("sparse_rank"), 9).alias("rrf"))
    best = _ranked(fused, "rrf", "rn", 2 * candidates)
    third = best.where("rn = 3").agg(F.max("rrf").alias("third"))
    kept = best.crossJoin(third).where((F.col("rn") <= 3) | (F.col("rrf") >= retain * F.col("third"))).where(F.col("rn") <= top_k)  # one row on the right
    whole = Window.partitionBy()
    agree = F.count(F.when(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull(), 1)).over(whole)
    top = F.max("rrf").over(whole)
    tier = F.when((top >= 0.025) & (agree >= 3), "HIGH").when((top >= 0.020) | (agree >= 1), "MEDIUM").otherwise("LOW")
    return kept.withColumn("tier", tier).select("id", "dense_rank", "sparse_rank", "rrf", "tier")


def query_text(text: Column, most: int = 512) -> Column:
    """[Q26] A search text as it is embedded: without white space around it, at most ``most`` characters, prefixed; null if nothing is left."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare != "", F.concat(F.lit("query: "), F.substring(bare, 1, most)))
