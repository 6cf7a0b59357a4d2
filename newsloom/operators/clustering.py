"""Windows, centroids, cohesion, TF-IDF labels, event clusters and samples of their members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.wordlists import STOPWORDS
from newsloom.functions import vectors
from newsloom.operators import neighbours
from newsloom.operators.components import components, numbered
from newsloom.operators.sinks import checkpointed


def assign_windows(df: DataFrame, day: str, *, length: int, stride: int, closed: bool) -> DataFrame:
    """[H1, H7, J14, S5] One row for each window that a day lies in: window k covers days k*stride to k*stride+length, the end included if closed."""
    lowest = f"greatest(0, cast(ceil(({day} - {length if closed else length - 1}) / {stride}.0) as int))"
    return df.withColumn("window_idx", F.explode(F.expr(f"sequence({lowest}, cast(floor({day} / {stride}.0) as int))")))


def earliest_window(assigned: DataFrame, key: str = "id") -> DataFrame:
    """[H5, H9, X9] The first window of each row wins."""
    return assigned.groupBy(key).agg(F.min("window_idx").alias("window_idx"))


def temporal_feature(articles: DataFrame, weight: float = 0.20) -> DataFrame:
    """[H2] The normalised vector with weight * (day - first) / (last - first) of its topic put after it."""
    by = Window.partitionBy("cluster_id")
    rows = articles.where("embedding IS NOT NULL AND cluster_id IS NOT NULL").withColumns({"lo": F.min("day").over(by), "hi": F.max("day").over(by)})
    t = weight * F.coalesce((F.col("day") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)), F.lit(0.0))
    return rows.select("id", "cluster_id", F.concat(vectors.l2_normalize(F.col("embedding")), F.array(t)).alias("feature"))


def centroids(articles: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """[D8, H16, G28] The normalised mean vector of each cluster, without templated articles; sums are combined on the map side."""
    rows = articles.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & ~F.coalesce("is_templated", F.lit(False)))
    parts = rows.select(F.col(key).alias("cluster"), F.posexplode(vec).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    mean = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("n"))
    return mean.select("cluster", vectors.l2_normalize(F.col("mean")).alias("centroid"), "n")


def cohesion(articles: DataFrame, key: str, vec: str = "embedding", least_members: int = 4, floor: float = 0.65) -> DataFrame:
    """[D19, H20] Mean pairwise cosine of unit vectors by (|sum|^2 - n) / (n (n - 1)): one aggregate, no self-join."""
    rows = articles.where(F.col(key).isNotNull() & F.col(vec).isNotNull())
    parts = rows.select(F.col(key).alias("cluster"), F.posexplode(vectors.l2_normalize(F.col(vec))).alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = parts.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n")).where(F.col("n") >= least_members)
    mean = (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return out.select("cluster", "n", F.round(mean, 6).alias("mean_pairwise_cosine"), (mean >= floor).alias("cohesive"))


def stratified_sample(members: DataFrame, key: str, *, k: int, priority: list[str]) -> DataFrame:
    """[H21] Up to k members: the best of each outlet type in order of priority, then by similarity. members: key, id, outlet_type, sim."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("outlet_type")), F.lit(0))
    rows = members.withColumn("in_type", F.row_number().over(Window.partitionBy(key, "outlet_type").orderBy(F.desc("sim"), "id")))
    order = [F.when(F.col("in_type") == 1, 0).otherwise(1), F.when(F.col("in_type") == 1, F.when(place == 0, 99).otherwise(place)).otherwise(0), F.desc("sim"), F.col("id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k).select(key, "id", "rank")


def summary_candidates(clusters: DataFrame, done: DataFrame, days: int = 7) -> DataFrame:
    """[H19, B10, B4] Events of three outlets, 4 to 60 articles and at most ``days`` that have no summary."""
    return clusters.where(f"outlet_count >= 3 AND article_count BETWEEN 4 AND 60 AND datediff(date_to, date_from) <= {days}").join(done, "cluster", "left_anti").select("cluster", "article_count", "outlet_count")


def terms(texts: DataFrame, key: str, text: str, pattern: str = "[a-z]{3,}") -> DataFrame:
    """(key, term, tf) of the words of a text column."""
    found = texts.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), 1)).alias("term"))
    return found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def label_terms(texts: DataFrame, key: str, text: str, order: str, stops: list[str] = STOPWORDS) -> DataFrame:
    """(key, term, tf): the one- and two-grams of words of three letters and more, stop words left out before they are paired.
    A cluster's texts are one, joined in ``order``, so the last word of a text and the first of the next that has words are a pair too."""
    word = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[a-zà-ÿăîâșț]{3,}$") & ~w.isin(stops))
    of = texts.select(key, order, word.alias("w")).where(F.size("w") > 0)
    of = of.withColumn("before", F.lag(F.element_at("w", -1)).over(Window.partitionBy(key).orderBy(order)))
    of = of.withColumn("all", F.when(F.col("before").isNull(), F.col("w")).otherwise(F.concat(F.array("before"), "w")))
    pairs = F.when(F.size("all") > 1, F.zip_with(F.slice("all", 1, F.size("all") - 1), F.slice("all", 2, F.size("all") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return of.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_labels(texts: DataFrame, key: str, text: str, *, order: str = "id", top: int = 5, min_df: int = 3, max_df: float = 0.65, most: int = 40_000, stops: list[str] = STOPWORDS) -> DataFrame:
    """[H14, D6] The top terms of each cluster by (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) among the ``most`` commonest terms;
    df: clusters that have the term. A cluster's length norm changes no order within it, so it is left out. Ties by term."""
    tf = label_terms(texts, key, text, order, stops)
    n = texts.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("all")).crossJoin(n).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))  # one row on the right
    df = df.orderBy(F.desc("all"), "term").limit(most)
    weight = F.round((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1), 9)
    scored = tf.join(df, "term").select(key, "term", weight.alias("w"))
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), "term"))).where(F.col("rn") <= top)
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda s: s["term"]), ",").alias("terms"))


def top_entities(articles: DataFrame, entities: DataFrame, key: str, n: int = 5) -> DataFrame:
    """[H15] The most frequent persons, organisations and places of each cluster; ties by name."""
    rows = entities.where("entity_label IN ('PERSON', 'ORGANIZATION', 'GPE') AND length(entity_text) >= 3")
    counted = rows.join(articles.where(F.col(key).isNotNull()).select(F.col("id").alias("article_id"), F.col(key).alias("cluster")), "article_id").groupBy("cluster", "entity_text").agg(F.count(F.lit(1)).alias("n"))
    best = counted.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "entity_text"))).where(F.col("rn") <= n)
    return best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "entity_text"))), lambda s: s["entity_text"]), ",").alias("entities"))


def label_text(entities: list[str], terms_: list[str], most: int = 5, empty: str = "fără etichetă") -> str:
    """[G35] Three entities, then terms up to five, repeats in any case left out."""
    out: list[str] = []
    for word in [*entities[:3], *terms_]:
        if len(out) < most and word.lower() not in {x.lower() for x in out}:
            out.append(word)
    return ", ".join(out) or empty


def title_vectors(articles: DataFrame, key: str) -> DataFrame:
    """(g, id, v) of each title that has terms: its TF-IDF weights within its group at length one, as structs (df, term, w), the rarest terms first."""
    rows = articles.where(F.col(key).isNotNull()).select(F.col(key).alias("g"), "id", "title")
    tf = terms(rows.select(F.struct("g", "id").alias("k"), "title"), "k", "title").select("k.g", "k.id", "term", "tf")
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("g", "term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, ["g", "term"]).join(n, "g").select("g", "id", "df", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    v = w.groupBy("g", "id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return v.withColumn("norm", norm).select("g", "id", F.expr("transform(v, x -> struct(x.df AS df, x.term AS term, x.w / norm AS w))").alias("v"))


def title_candidates(vectors_: DataFrame, floor: float) -> DataFrame:
    """(g, id, id2): pairs of a group that share a term of both their prefixes. A prefix ends where the terms after it weigh less than ``floor``
    together: if two titles shared none of their prefixes, their first shared term would lie behind one of them, and their cosine below ``floor``. So the terms that
    most titles have make no pairs, unless a title has little else."""
    tail = f"aggregate(slice(v, i + 1, size(v)), 0D, (s, y) -> s + y.w * y.w) >= {floor * floor - 1e-12!r}"
    ahead = vectors_.select("g", "id", F.expr(f"filter(v, (x, i) -> {tail})").alias("p")).select("g", "id", F.explode("p.term").alias("term"))
    other = ahead.withColumnRenamed("id", "id2")
    return ahead.join(other, ["g", "term"]).where("id < id2").select("g", "id", "id2").distinct()


def title_filter(articles: DataFrame, key: str, floor: float = 0.15) -> DataFrame:
    """[H11] Rows whose title has a TF-IDF cosine of ``floor`` or more with another title of its group; a group left with fewer than two keeps all.
    Titles of the same weights are one among the pairs, and close to each other if they are several."""
    whole = checkpointed(title_vectors(articles, key))
    same = checkpointed(whole.groupBy("g", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    pairs = title_candidates(same, floor)
    met = pairs.join(same.select("g", "id", "v"), ["g", "id"]).join(same.select("g", F.col("id").alias("id2"), F.col("v").alias("v2")), ["g", "id2"])
    by_term = met.withColumn("m", F.map_from_entries(F.transform("v2", lambda x: F.struct(x["term"], x["w"]))))
    cosine = F.expr("aggregate(v, 0D, (s, x) -> s + x.w * coalesce(try_element_at(m, x.term), 0D))")
    near = by_term.where(cosine >= floor).select("g", F.explode(F.array("id", "id2")).alias("id"))
    close = near.unionByName(same.where("n > 1").select("g", "id")).distinct()
    kept = whole.join(same.join(close, ["g", "id"], "left_semi").select("g", "v"), ["g", "v"], "left_semi").select("g", "id", F.lit(1).alias("close"))
    rows = articles.where(F.col(key).isNotNull()).select(F.col(key).alias("g"), "id").join(kept, ["g", "id"], "left")
    counted = rows.join(rows.groupBy("g").agg(F.count("close").alias("kept")), "g")
    return counted.where("close = 1 OR kept < 2").select("g", "id")


def average_linkage(unit: np.ndarray, cut: float) -> np.ndarray:
    """Labels of agglomerative clustering of unit vectors under cosine distance, merging while the least average distance is at most ``cut``.

    Chains of nearest neighbours: a chain goes on to the nearest group until two are each other's nearest, which merge. Average linkage is reducible,
    so this gives the groups of the greedy order. The average distance of two groups is 1 - (sum of one * sum of the other) / (sizes), so a group is
    its sum and its size: memory grows with the vectors, not with their pairs, and time with the square."""
    n = len(unit)
    sums, sizes, alive = unit.copy(), np.ones(n), np.ones(n, bool)
    group, chain = np.arange(n), []
    while alive.any() or chain:
        if not chain:
            chain = [int(np.argmax(alive))]
        i = chain[-1]
        far = 1 - (sums @ sums[i]) / (sizes * sizes[i])
        far[~alive] = np.inf
        far[i] = np.inf
        j = int(far.argmin())
        if not far[j] <= cut:  # nothing ever comes nearer to a group than its nearest
            alive[i] = False
            chain.pop()
            continue
        if len(chain) > 1 and far[chain[-2]] <= far[j]:
            j = chain[-2]
            chain = chain[:-2]
            sums[j] += sums[i]
            sizes[j] += sizes[i]
            alive[i] = False
            group[group == i] = j
        else:
            chain.append(j)
    _, first, label = np.unique(group, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def linkage_parts(rows: DataFrame, cut: float, cells: int | None = None) -> DataFrame:
    """[H8] (g, id, part) of rows (g, id, vec of length one): average_linkage() in each group, a part named by its least id.

    Two groups that merge hold two rows at most ``cut`` apart, so rows that no such steps connect never meet: a group is cut into the connected
    parts of its near rows, found by cells, and each is a task of its own."""
    rows = checkpointed(neighbours.prepared(rows, "id", F.col("vec"), F.col("g")))
    edges = neighbours.linked(neighbours.build(rows, cells), (2 * cut) ** 0.5 + 1e-9)
    found = components(edges).withColumnsRenamed({"node": "id"})
    tied = rows.join(found, ["g", "id"])

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        label = average_linkage(np.stack(pdf["vec"].to_numpy()).astype(float), cut)
        least = pd.Series(ids).groupby(label).min()
        return pd.DataFrame({"g": key[0], "id": ids, "part": least[label].to_numpy()})

    parts = tied.groupBy("g", "component").applyInPandas(one, "g long, id long, part long")
    return parts.unionByName(rows.join(found, ["g", "id"], "left_anti").select("g", "id", F.col("id").alias("part")))


#: Windows of one topic at most, to name a window of a topic by one number.
WINDOWS = 1 << 20


def event_clusters(articles: DataFrame, *, cut: float, merge: float, least_topic: int = 10, least_outlets: int = 2, cells: int | None = None) -> DataFrame:
    """[H6, H8, H10, H12, D2, J15] (id, cluster_id, event, outlets): events of each topic. Average-linkage clusters in windows of 7 days and stride 3, the
    earliest window of an article wins, neighbours in adjacent windows merge by centroid, one-outlet events go. Events are numbered from 1 without gaps in
    order of topic, first window and least article."""
    rows = articles.where("embedding IS NOT NULL AND cluster_id IS NOT NULL")
    big = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_topic).select("cluster_id")
    rows = rows.join(big, "cluster_id").select("id", "outlet_id", "cluster_id", "day", neighbours.unit("embedding").alias("vec")).where("vec IS NOT NULL")
    placed = checkpointed(assign_windows(rows, "day", length=7, stride=3, closed=True).withColumn("g", F.col("cluster_id").cast("long") * WINDOWS + F.col("window_idx")))
    parts = placed.join(linkage_parts(placed, cut, cells), ["g", "id"])
    first = checkpointed(parts.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("window_idx"))).where("rn = 1").drop("rn", "g"))
    node = ["cluster_id", "window_idx", "part"]
    mean = first.select(*node, F.posexplode("vec").alias("pos", "x")).groupBy(*node, "pos").agg(F.avg("x").alias("x"))
    centre = mean.groupBy(*node).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))
    centre = numbered(centre, node, "node")
    after = centre.select("cluster_id", (F.col("window_idx") - 1).alias("window_idx"), F.col("node").alias("b"), F.col("c").alias("c2"))
    edges = centre.join(after, ["cluster_id", "window_idx"]).where(1 - vectors.cosine(F.col("c"), F.col("c2")) < merge).select(F.lit(0).cast("long").alias("g"), F.col("node").alias("a"), "b")
    top = components(edges).select("node", "component")
    named = centre.join(top, "node", "left").select(*node, F.coalesce("component", "node").alias("top"))
    whole = checkpointed(first.select("id", "outlet_id", *node).join(named, node))
    wide = whole.groupBy("top").agg(F.countDistinct("outlet_id").alias("outlets")).where(F.col("outlets") >= least_outlets)
    return whole.join(numbered(wide, ["top"], "event"), "top").select("id", "cluster_id", "event", "outlets")


def embed_hashed(batches: Iterator[pd.DataFrame], dim: int = 64) -> Iterator[pd.DataFrame]:
    """[C3] The default sentence encoder for mapInPandas: hashed words, normalised. In: id, text; out: id, embedding."""
    import zlib

    for pdf in batches:
        out = []
        for text in pdf["text"].fillna(""):
            v = np.zeros(dim, np.float32)
            for w in text.lower().split():
                v[zlib.crc32(w.encode()) % dim] += 1
            out.append((v / max(1e-12, float(np.linalg.norm(v)))).tolist())
        yield pd.DataFrame({"id": pdf["id"], "embedding": out})
