"""Fact-checks: listings, the two tiers of matches, coarse matching with centroids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import vectors
from newsloom.functions.text import shares_keywords
from newsloom.operators import neighbours


def fact_check_list(checks: DataFrame, *, verdict: str | None = None, verdict_type: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """[Q8, Q9, B8] A page of fact-checks, newest first."""
    for column, value in (("verdict", verdict), ("verdict_type", verdict_type)):
        if value is not None:
            checks = checks.where(F.col(column) == value)
    return checks.select("id", "outlet_id", "verdict", "verdict_type", "published_on").orderBy(F.desc("published_on"), "id").offset((page - 1) * page_size).limit(page_size)


def by_cluster(checks: DataFrame, run: int, cluster: int, match_on: str = "cluster") -> DataFrame:
    """[Q10, J1] Tier one: fact-checks mapped to a cluster, most similar first."""
    key = "sub_cluster_id" if match_on == "sub_cluster" else "cluster_id"
    return checks.where((F.col("cluster_run_id") == run) & (F.col(key) == cluster)).select("id", "verdict", "similarity").orderBy(F.desc("similarity"), "id")


def proximity(checks: DataFrame, article: DataFrame, threshold: float, limit: int = 10) -> DataFrame:
    """[Q11, J12, F2] Tier two: the fact-checks nearest to one article within a cosine distance. article: one row (id, embedding)."""
    one = article.select(F.col("id").alias("a_id"), F.col("embedding").alias("q")).limit(1)
    far = (1 - vectors.cosine(F.col("embedding"), F.col("q"))).alias("distance")
    near = checks.where("embedding IS NOT NULL").crossJoin(one).where("id <> a_id").select("id", "verdict", far).where(F.col("distance") < threshold)  # one row on the right
    return near.orderBy("distance", "id").limit(limit).select("id", "verdict", F.round("distance", 6).alias("distance"))


def by_article(checks: DataFrame, article: DataFrame, threshold: float, limit: int = 10) -> DataFrame:
    """[Q12, J8] Tier one by the article's topic, then tier two without those."""
    one = checks.join(article.select("cluster_run_id", "cluster_id"), ["cluster_run_id", "cluster_id"], "left_semi").select("id", "verdict", F.lit(1).alias("tier"))
    two = proximity(checks, article, threshold, limit).select("id", "verdict", F.lit(2).alias("tier")).join(one, "id", "left_anti")
    return one.unionByName(two)


def badge(checks: DataFrame, severe: int = 3) -> DataFrame:
    """[Q13, J3] Per cluster of a run: matches in all and their greatest severity."""
    return checks.where("cluster_run_id IS NOT NULL").groupBy("cluster_run_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("factcheck_count"), F.max("severity_score").alias("max_severity"), (F.max("severity_score") >= severe).alias("severe"), F.max("similarity").alias("similarity"),
    )


#: Centroids that are broadcast as one matrix, at most (64 MB at 1,024 dimensions); more go into an index.
CENTROIDS = 8_192


def coarse_matches(checks: DataFrame, centroids: DataFrame, least: float, top: int = 3, most: int = CENTROIDS) -> DataFrame:
    """[J13, E4] The ``top`` nearest centroids of each fact-check at or above a cosine, ties by cluster. centroids: cluster, centroid.

    The matrix of centroids is broadcast if they are ``most`` or fewer, and each batch of fact-checks is one product with it; else they
    are searched by cells, exactly. No pairs are made but the best."""
    asked, kinds = checks.where("embedding IS NOT NULL"), {"id": checks.schema["id"].dataType, "cluster": centroids.schema["cluster"].dataType}
    units_ = centroids.where(vectors.norm(F.col("centroid")) > 0).select(F.col("cluster").cast("long").alias("cluster"), vectors.l2_normalize(F.col("centroid")).alias("unit"))
    rows = sorted(units_.limit(most + 1).collect(), key=lambda r: r["cluster"])
    if len(rows) > most:
        index = neighbours.build(neighbours.prepared(units_, "cluster", F.col("unit")))
        found = neighbours.nearest(index, neighbours.prepared(asked, "id", neighbours.unit("embedding")), top, exact=True, within=math.sqrt(max(0.0, 2 - 2 * least)))
        return found.select(F.col("query").cast(kinds["id"]).alias("id"), F.col("id").cast(kinds["cluster"]).alias("cluster"), F.col("rank").alias("rn"), F.round(1 - F.col("distance") * F.col("distance") / 2, 6).alias("cos"))
    shared = checks.sparkSession.sparkContext.broadcast((np.array([r["cluster"] for r in rows], np.int64), np.array([r["unit"] for r in rows], float)))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        for pdf in batches:
            out: list[tuple] = []
            if len(names) and len(pdf):
                cos = np.stack(pdf["unit"].to_numpy()) @ matrix.T
                order = np.argsort(-cos, 1, kind="stable")[:, :top]
                out = [(i, names[j], n + 1, cos[k, j]) for k, i in enumerate(pdf["id"]) for n, j in enumerate(order[k]) if cos[k, j] >= least]
            yield pd.DataFrame(out, columns=["id", "cluster", "rn", "cos"])

    units = asked.select(F.col("id").cast("long").alias("id"), neighbours.unit("embedding").alias("unit")).where("unit IS NOT NULL")
    return units.mapInPandas(met, "id long, cluster long, rn int, cos double").withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()} | {"cos": F.round("cos", 6)})


def nearest_checks(index: neighbours.Index, article: DataFrame, threshold: float, limit: int = 10, exact: bool = True) -> DataFrame:
    """[Q11, F2] (article, id, distance): proximity() of any number of articles (id, embedding) by an index of the fact-checks' unit vectors, which reads the cells near the articles only."""
    queries = neighbours.prepared(article.where("embedding IS NOT NULL"), "id", neighbours.unit("embedding"))
    found = neighbours.nearest(index, queries, limit, exact=exact, same=True, within=math.sqrt(2 * threshold))
    cosine = F.round(F.col("distance") * F.col("distance") / 2, 6)
    return found.where(F.col("distance") * F.col("distance") / 2 < threshold).select(F.col("query").alias("article"), "id", cosine.alias("distance"))


def keyword_guard(checks: DataFrame, articles: DataFrame, titles: int = 10) -> DataFrame:
    """[G21, E4, H17] Whether a claim shares a root with any of the first titles of its topic."""
    first = articles.where("cluster_id IS NOT NULL").select("cluster_id", "id", "title").withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))).where(F.col("rn") <= titles)
    pairs = checks.where("cluster_id IS NOT NULL").select(F.col("id").alias("check_id"), "cluster_id", "claim_text").join(first, "cluster_id")
    return pairs.groupBy("check_id").agg(F.max(shares_keywords(F.col("claim_text"), F.col("title")).cast("int")).alias("shares"))


def earliest_titles(articles: DataFrame, n: int = 8) -> DataFrame:
    """[D5, H18] The ``n`` earliest titles of each event, in order. The window limits a group before its titles are gathered."""
    by = Window.partitionBy("sub_cluster_id").orderBy("published_on", "id")
    first = articles.where("sub_cluster_id IS NOT NULL").select("sub_cluster_id", "published_on", "id", "title").withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n)
    return first.groupBy("sub_cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"]), " | ").alias("titles"))


def assign(scored: DataFrame, least: float) -> DataFrame:
    """[H17] For each fact-check the best cluster if its reranker logit, as a probability, is enough; a row in any case. scored: id, cluster, logit."""
    p = (1 / (1 + F.exp(-F.col("logit")))).alias("p")
    best = scored.select("id", "cluster", p).groupBy("id").agg(F.max(F.struct("p", (-F.col("cluster")).alias("less"))).alias("b"))
    taken: Column = F.when(F.col("b.p") >= least, -F.col("b.less"))
    return best.select("id", taken.alias("cluster"), F.round("b.p", 6).alias("similarity"))


def refined_to_events(checks: DataFrame, articles: DataFrame, logit: Callable[[Column, Column], Column], least: float = 0.6, titles: int = 8) -> DataFrame:
    """[H18] For each fact-check with a topic the event of that topic whose titles fit best: (id, sub_cluster_id, sub_similarity), null if none is enough.

    An event stands for its ``titles`` earliest titles, of which those that share a root with the claim are scored by ``logit(claim, title)``;
    ties go to the smaller event. Titles are cut by a window before they are joined."""
    by = Window.partitionBy("sub_cluster_id").orderBy("published_on", "id")
    first = articles.where("sub_cluster_id IS NOT NULL AND cluster_id IS NOT NULL").withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= titles).select("cluster_id", F.col("sub_cluster_id").alias("event"), "title")
    claims = checks.where("cluster_id IS NOT NULL").select("id", "cluster_id", "claim_text")
    pairs = claims.join(first, "cluster_id").where(shares_keywords(F.col("claim_text"), F.col("title")))
    best = pairs.groupBy("id").agg(F.max(F.struct((1 / (1 + F.exp(-logit(F.col("claim_text"), F.col("title"))))).alias("p"), (-F.col("event")).alias("less"))).alias("b"))
    enough = F.col("b.p") >= least
    return claims.select("id").join(best, "id", "left").select("id", F.when(enough, -F.col("b.less")).alias("sub_cluster_id"), F.when(enough, F.round("b.p", 4)).alias("sub_similarity"))


# Fixed values.
TITLE_STARTS = ["fals |", "adevărat |", "parțial adevărat |", "context lipsă |", "fals:", "adevărat:", "parțial adevărat:", "context lipsă:"]
CHIPS = {"true": "green", "partially_true": "green", "satire": "green", "unverifiable": "amber", "missing_context": "amber", "truncated": "amber", "ai_edited": "amber", "partially_false": "orange", "conspiracy_theory": "orange", "ai_generated": "orange", "doctored_photo": "orange", "false": "red", "disinformation": "red", "fake_news": "red", "war_propaganda": "red", "deepfake": "red", "scam": "red"}


def is_fact_check(title: Column) -> Column:
    """[G20] Whether a title begins with a verdict; a null title doesn't."""
    low = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    out = F.lit(False)
    for start in TITLE_STARTS:
        out = out | low.startswith(start)
    return out


def chip(verdict: Column) -> Column:
    """[G32] The colour of a verdict; amber for those without one."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in CHIPS.items() for x in pair)), verdict), F.lit("amber"))


def pill(score: Column, good_when_high: bool) -> Column:
    """[G32] good, bad or neutral by the thresholds 0.7 and 0.3; empty without a score."""
    high, low = ("good", "bad") if good_when_high else ("bad", "good")
    return F.when(score.isNull(), "").when(score >= 0.7, high).when(score < 0.3, low).otherwise("neutral")
