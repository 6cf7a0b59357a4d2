"""[H3, H4, H5] Topics of a window: a hierarchy of densities over nearest neighbours.

Distance: of unit vectors with the time feature after them, two articles of one outlet 1 + penalty * (the outlet's share of the window) times as far apart. The
core distance of an article is that of its ``samples``-th neighbour; two neighbours reach each other at the greatest of their core distances and their own
distance. The least spanning forest of these edges, by Borůvka rounds, is all that the hierarchy needs: its edges, shortest first, merge groups; a
group of ``least`` articles is a cluster, which lives on while smaller ones fall to it and ends where it meets another cluster. A cluster is chosen if its
stability, the sum over its articles of 1 / (distance at which they join) - 1 / (distance at which it ends), is not below that of the clusters within it;
what no chosen cluster holds is noise. With as many neighbours as there are articles this is the hierarchy over all distances; with fewer, parts
that no neighbour ties together meet at infinity. The whole of a window (or its only part of ``least`` articles) is no cluster.

Neighbours, edges and forest are spread over tasks. One task holds the forest of one connected part, some 60 bytes an article."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.operators import neighbours
from newsloom.operators.clustering import temporal_feature
from newsloom.operators.components import REST, Roots, numbered, spanning_forest
from newsloom.operators.sinks import checkpointed

#: Distances below count as this, so that equal articles have a finite density.
CLOSEST = 1e-9


def reach_edges(near: DataFrame, samples: int) -> DataFrame:
    """(g, a, b, w) of (g, query, id, distance, rank): neighbours by the distance at which they reach each other."""
    core = checkpointed(near.where(F.col("rank") <= samples).groupBy("g", "query").agg(F.max("distance").alias("core")))
    other = core.select("g", F.col("query").alias("id"), F.col("core").alias("core2"))
    met = near.join(core, ["g", "query"]).join(other, ["g", "id"])
    return met.select("g", F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), F.greatest("distance", "core", "core2").alias("w")).groupBy("g", "a", "b").agg(F.min("w").alias("w"))


def chosen(forest: list[tuple[int, int, float]], least: int, top: bool) -> dict[int, int]:
    """The least article of its chosen cluster for each article of one connected part that has one. forest: (a, b, w), shortest first; top: whether the whole part may be chosen."""
    roots = Roots()
    cluster: dict[int, int] = {}  # of a root, if it is one
    loose: dict[int, list[int]] = {}  # of any other root: its articles
    weight: list[float] = []  # of a cluster: the sum of 1 / distance at which its articles join
    count: list[int] = []
    within: list[float] = []  # the worth of the clusters within it
    parent: list[int] = []
    wins: list[bool] = []
    joined: list[tuple[int, int]] = []  # an article and the least cluster that it is in

    def worth(c: int, at: float) -> float:
        """The cluster ends at this density: the greater of its own stability and what is within it."""
        own = weight[c] - at * count[c]
        wins[c] = own >= within[c]
        return max(own, within[c])

    for a, b, w in forest:
        at = 1 / max(w, CLOSEST)
        met, free = [], []
        for r in (roots.of(a), roots.of(b)):
            if r in cluster:
                met.append(cluster.pop(r))
            else:
                free += loose.pop(r, [r])
        roots.join(a, b)
        r = roots.of(a)
        if len(met) == 1 or len(met) == 0 and len(free) < least:
            if not met:
                loose[r] = free
                continue
            (c,) = met
            weight[c] += at * len(free)
            count[c] += len(free)
        else:  # a cluster begins: of loose articles, or of two that meet
            c = len(weight)
            n = len(free) + sum(count[m] for m in met)
            weight.append(at * n)
            count.append(n)
            within.append(sum(worth(m, at) for m in met))
            parent.append(-1)
            wins.append(False)
            for m in met:
                parent[m] = c
        joined += [(m, c) for m in free]
        cluster[r] = c
    for c in cluster.values():  # the whole part ends at infinite distance
        worth(c, 0.0)
        wins[c] = wins[c] and top
    best = [-1] * len(weight)  # the outermost chosen cluster; parents come after their children
    for c in reversed(range(len(weight))):
        best[c] = best[parent[c]] if parent[c] >= 0 and best[parent[c]] >= 0 else c if wins[c] else -1
    name: dict[int, int] = {}
    for m, c in joined:
        if best[c] >= 0:
            name[best[c]] = min(m, name.get(best[c], m))
    return {m: name[best[c]] for m, c in joined if best[c] >= 0}


def clusters(near: DataFrame, samples: int, least: int, rest: int = REST) -> DataFrame:
    """(g, id, cluster): each article of ``near`` (as neighbours.nearest() gives them) that a chosen cluster holds, which is named by its least article."""
    forest, parts = spanning_forest(reach_edges(near, samples), rest)
    parts = checkpointed(parts)
    sizes = parts.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    tops = sizes.join(sizes.groupBy("g").agg((F.count(F.lit(1)) > 1).alias("top")), "g").select("g", "component", "top")
    edges = forest.join(parts.withColumnRenamed("node", "a"), ["g", "a"]).join(tops, ["g", "component"])

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = chosen(list(pdf.sort_values(["w", "a", "b"])[["a", "b", "w"]].itertuples(index=False, name=None)), least, bool(pdf["top"].iloc[0]))
        return pd.DataFrame({"g": key[0], "id": list(found), "cluster": list(found.values())})

    return edges.groupBy("g", "component").applyInPandas(one, "g long, id long, cluster long")


def topics(rows: DataFrame, *, samples: int = 5, least: int = 10, k: int = 15, penalty: float = 1.20, weight: float = 0.20, cells: int | None = None, exact: bool = True, rest: int = REST) -> DataFrame:
    """(g, id, label) of rows (g, id, outlet_id, day, embedding): the number of the article's cluster, from 1 over all windows, in order of window and least article; -1 is noise."""
    rows = checkpointed(rows.where("embedding IS NOT NULL").select(F.col("g").cast("long").alias("g"), F.col("id").cast("long").alias("id"), "outlet_id", "day", "embedding"))
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    share = rows.groupBy("g", "outlet_id").agg(F.count(F.lit(1)).alias("of")).join(n, "g").select("g", "outlet_id", (1 + penalty * F.col("of") / F.col("n")).alias("factor"))
    feature = temporal_feature(rows.withColumnRenamed("g", "cluster_id"), weight).select(F.col("cluster_id").alias("g"), "id", "feature")
    whole = rows.join(feature, ["g", "id"]).join(share, ["g", "outlet_id"])
    index = neighbours.build(checkpointed(neighbours.prepared(whole, "id", F.col("feature"), F.col("g"), F.col("outlet_id"), F.col("factor"))), cells)
    near = checkpointed(neighbours.nearest(index, index.rows.drop("cell"), max(k, samples), exact=exact, same=True))
    found = checkpointed(clusters(near, samples, least, rest))
    names = numbered(found.select("g", "cluster").distinct(), ["g", "cluster"], "label")
    labels = found.join(names, ["g", "cluster"]).select("g", "id", "label")
    return rows.select("g", "id").join(labels, ["g", "id"], "left").select("g", "id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def first_topics(labelled: DataFrame) -> DataFrame:
    """[H5] (id, label) of topics() over windows that overlap: the first window with a cluster for the article wins."""
    by = Window.partitionBy("id").orderBy("g")
    return labelled.where("label >= 0").withColumn("rn", F.row_number().over(by)).where("rn = 1").select("id", "label")
