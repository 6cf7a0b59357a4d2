"""Spanning forests and components of weighted graphs by Borůvka rounds, and row numbers without a single-task window."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.sinks import checkpointed

#: Edges of a group's contracted graph that one task takes to their end; more go through further rounds.
REST = 200_000


class Roots:
    """Union-find with path halving; the least name of a set is its root."""

    def __init__(self):
        self.parent: dict = {}

    def of(self, x):
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.of(a), self.of(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def spanning_forest(edges: DataFrame, rest: int = REST) -> tuple[DataFrame, DataFrame]:
    """The least spanning forest (g, a, b, w) of edges (g, a, b, w) and (g, node, component) of their nodes, the component by its least node.

    Each round every component takes its least edge outwards (of equal weights the one of least ends, so that there are no circles), hooked components are
    contracted by pointer jumping, and edges within one go: at most half of the components are left. The rows of a large group are never gathered, and its edges
    combine on the map side. Once no group has more than ``rest`` edges left, they are ended by tasks of whole groups, about ``rest`` edges each. Nodes without an
    edge to another don't occur."""
    ordered = edges.where("a <> b").select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("g", "a", "b").agg(F.min("w").alias("w"))
    now = checkpointed(ordered.select("g", F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "w"))
    nodes = now.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    maps, forest = [], []

    def left(edges: DataFrame) -> tuple[int, int]:
        """The edges of all groups and of the largest."""
        found = edges.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        return found["n"] or 0, found["most"] or 0

    while (n := left(now))[1] > rest:
        ends = now.unionByName(now.select("g", F.col("y").alias("x"), F.col("x").alias("y"), "a", "b", "w"))
        best = checkpointed(ends.groupBy("g", "x").agg(F.min(F.struct("w", "a", "b", "y")).alias("e")).select("g", "x", F.col("e.y").alias("to"), "e.a", "e.b", "e.w"))
        forest.append(best.select("g", "a", "b", "w").distinct())
        back = best.select("g", F.col("x").alias("to"), F.col("to").alias("again"))
        parent = checkpointed(best.join(back, ["g", "to"]).select("g", "x", F.when((F.col("again") == F.col("x")) & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("to")))
        while True:  # the paths halve each time
            up = parent.select("g", F.col("x").alias("to"), F.col("to").alias("top"))
            jumped = checkpointed(parent.join(up, ["g", "to"]).select("g", "x", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")))
            parent = jumped.drop("moved")
            if not jumped.where("moved").limit(1).count():
                break
        maps.append(parent)
        y = parent.select("g", F.col("x").alias("y"), F.col("to").alias("y2"))
        now = checkpointed(now.join(parent, ["g", "x"]).join(y, ["g", "y"]).where("to <> y2").select("g", F.col("to").alias("x"), F.col("y2").alias("y"), "a", "b", "w"))
    if n[0]:
        tasks = 1 if n[0] <= rest else -(-4 * n[0] // rest)  # small groups share one
        ended = checkpointed(now.withColumn("task", F.pmod(F.xxhash64("g"), F.lit(tasks))).groupBy("task").applyInPandas(_ended, "g long, a long, b long, w double, x long, top long"))
        forest.append(ended.where("top IS NULL").select("g", "a", "b", "w"))
        maps.append(ended.where("top IS NOT NULL").select("g", "x", F.col("top").alias("to")))
    place = nodes.withColumn("component", F.col("node"))
    for m in maps:
        place = place.join(m.select("g", F.col("x").alias("component"), "to"), ["g", "component"], "left").select("g", "node", F.coalesce("to", "component").alias("component"))
    least = place.groupBy("g", "component").agg(F.min("node").alias("least"))
    named = place.join(least, ["g", "component"]).select("g", "node", F.col("least").alias("component"))
    return (reduce(DataFrame.unionByName, forest).distinct() if forest else ordered), named


def _ended(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of the forest (top null), and each component with what it becomes part of."""
    roots, rows = Roots(), []
    for g, x, y, a, b, w in pdf.sort_values(["w", "a", "b"])[["g", "x", "y", "a", "b", "w"]].itertuples(index=False):
        if roots.join((g, x), (g, y)):
            rows.append((g, a, b, w, None, None))
    rows += [(x[0], None, None, None, x[1], roots.of(x)[1]) for x in list(roots.parent)]
    found = pd.DataFrame(rows, columns=["g", "a", "b", "w", "x", "top"], dtype=object)  # nulls must not make longs into doubles
    return found.astype({"g": "int64", "a": "Int64", "b": "Int64", "w": "float64", "x": "Int64", "top": "Int64"})


def components(edges: DataFrame, rest: int = REST) -> DataFrame:
    """(g, node, component) of edges (g, a, b): the least node that each reaches."""
    return spanning_forest(edges.withColumn("w", F.lit(0.0)), rest)[1]


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """[H12] ``rows`` with numbers from 1 without gaps in an order that is total: partitions by range are counted, and each begins where those before it end.
    The driver sees one count for each partition; no task sees all rows."""
    parts = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part__": F.spark_partition_id(), "place__": F.monotonically_increasing_id()}))
    start, at = {}, 0
    for r in parts.groupBy("part__").agg(F.count(F.lit(1)).alias("n")).orderBy("part__").collect():
        start[r["part__"]], at = at, at + r["n"]
    first = F.create_map(*(F.lit(x).cast("long") for pair in start.items() for x in pair)) if start else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    within = F.col("place__").bitwiseAND((1 << 33) - 1)
    return parts.withColumn(name, F.element_at(first, F.col("part__").cast("long")) + within + 1).drop("part__", "place__")


def numbered_within(rows: DataFrame, group: str, order: list, name: str = "number") -> DataFrame:
    """``rows`` numbered from 1 in each group, by numbered() less the group's least number."""
    whole = checkpointed(numbered(rows, [group, *order], "number__"))
    least = whole.groupBy(group).agg(F.min("number__").alias("least__"))
    return whole.join(least, group).withColumn(name, F.col("number__") - F.col("least__") + 1).drop("number__", "least__")


