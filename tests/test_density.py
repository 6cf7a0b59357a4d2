"""Neighbour searches, spanning forests and the topic hierarchy against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import components as K
from newsloom.operators import density as D
from newsloom.operators import neighbours as N


def vectors_(n, dim=8, centres=12, spread=0.35, seed=3):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(centres, dim))
    v = heart[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def points(spark):
    v = vectors_(1500)
    v[20:60] = v[20]  # equal vectors: ties by id
    frame = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5), x.tolist()) for i, x in enumerate(v)] + [(9999, 0, 1, None)], "id long, g long, kin long, vec array<double>")
    return v, N.prepared(frame, "id", F.col("vec"), F.col("g"), F.col("kin"), 1 + F.col("kin") / 5)


def plain_neighbours(v, k, group=lambda i: i % 3 == 0, kin=lambda i: i % 5):
    out = {}
    for i in range(len(v)):
        far = [(float(np.linalg.norm(v[i] - v[j])) * (1 + kin(i) / 5 if kin(i) == kin(j) else 1), j) for j in range(len(v)) if j != i and group(i) == group(j)]
        out[i] = sorted(far)[:k]
    return out


def test_exact_search(points):
    v, rows = points
    index = N.build(rows)
    truth = plain_neighbours(v, 7)
    queries = rows.where("id % 10 = 0 OR id BETWEEN 20 AND 60")
    found = defaultdict(list)
    for r in N.nearest(index, queries, 7, probes=1, exact=True, same=True, block=64).orderBy("rank").collect():
        found[r["query"]].append((round(r["distance"], 9), r["id"]))
    asked = [i for i in range(1500) if i % 10 == 0 or 20 <= i <= 60]
    assert dict(found) == {i: [(round(d, 9), j) for d, j in truth[i]] for i in asked}


def test_recall_and_cells(spark, points):
    """A few cells give nearly all neighbours; every row is in one cell; a search within a distance gives what a scan gives."""
    v, rows = points
    index = N.build(rows)
    assert index.rows.count() == 1500 and len(index.centres) == round(1501**0.5)
    truth = spark.createDataFrame([(int(i % 3 == 0), i, j) for i, near in plain_neighbours(v, 10).items() if i % 4 == 0 for _, j in near], "g long, query long, id long")
    found = N.nearest(index, rows.where("id % 4 = 0"), 10, same=True)
    assert N.recall(found, truth) >= 0.95
    near = {(r["query"], r["id"]) for r in N.nearest(index, rows.where("id = 7"), 1500, probes=2, exact=True, within=0.5).collect()}
    assert near == {(7, j) for j in range(1500) if (j % 3 == 0) == (7 % 3 == 0) and (np.linalg.norm(v[7] - v[j]) * (1.4 if j % 5 == 2 else 1)) <= 0.5}


def test_empty_index(spark, points):
    _, rows = points
    empty = N.build(rows.where("id < 0"))
    assert N.nearest(empty, rows.limit(3), 2, exact=True).count() == 0


def test_a_vector_goes_once_to_each_run(points, monkeypatch):
    """However many cells are near: before, it went to each of the 39 cells."""
    _, rows = points
    index, blocks, sent = N.build(rows), N._blocks, []

    def counted(asked, held, block):
        sent.append(asked.count())
        return blocks(asked, held, block)

    monkeypatch.setattr(N, "_blocks", counted)
    N.linked(index, 3.0).count()
    N.nearest(index, rows, 7, exact=True, same=True).count()
    assert sent == [1500, 1500, 0]
    del sent[:]
    N.nearest(index, rows, 7, exact=True, same=True, block=300).count()  # the groups have 500 and 1,000 rows
    assert sent[0] == 1500 and sum(sent) <= 500 * 2 + 1000 * 4


def test_forest_of_a_block():
    near = np.random.default_rng(1).random((60, 50)) < 0.03

    def parts(pairs):
        roots = K.Roots()
        new = [roots.join(int(i), 100 + int(j)) for i, j in pairs]
        return {x: roots.of(x) for x in list(roots.parent)}, new

    every, _ = parts(np.argwhere(near))
    found, new = parts(N._tied(near))
    assert found == every and all(new) and len(new) < near.sum()
    assert N._tied(np.zeros((2, 3), bool)) == []


def test_linked_components(points):
    v, rows = points
    index = N.build(rows.withColumns({"g": F.lit(0).cast("long")}), cells=9)
    found = {r["node"]: r["component"] for r in K.components(N.linked(index, 0.25, block=100), rest=0).collect()}
    label = list(range(len(v)))
    near = np.linalg.norm(v[:, None] - v[None], axis=2) <= 0.25
    for _ in range(60):
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(v))]
    assert {i: c for i, c in found.items()} == {i: c for i, c in enumerate(label) if near[i].sum() > 1}


@pytest.mark.parametrize("rest", [0, 30, 10**6])
def test_spanning_forest(spark, rest):
    rng = random.Random(4)
    edges = [(rng.randint(0, 1), rng.randint(0, 60), rng.randint(0, 60), float(rng.randint(0, 9))) for _ in range(110)]
    forest, place = K.spanning_forest(spark.createDataFrame(edges, "g long, a long, b long, w double"), rest)
    best = {}
    for g, a, b, w in edges:
        if a != b:
            key = (g, min(a, b), max(a, b))
            best[key] = min(w, best.get(key, w))
    parent, want = {}, set()

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, g, a, b in sorted((w, *k) for k, w in best.items()):
        if root((g, a)) != root((g, b)):
            parent[max(root((g, a)), root((g, b)))] = min(root((g, a)), root((g, b)))
            want.add((g, a, b, w))
    assert {tuple(r) for r in forest.collect()} == want
    assert {(r["g"], r["node"]): (r["g"], r["component"]) for r in place.collect()} == {x: root(x) for x in list(parent)}


def test_groups_are_ended_by_tasks_of_their_own(spark, monkeypatch):
    """Groups of at most ``rest`` edges need no rounds, however many groups there are: before, all groups together had to have so few."""
    written, checkpointed = [], K.checkpointed
    monkeypatch.setattr(K, "checkpointed", lambda df: written.append(1) or checkpointed(df))
    edges = spark.range(400).select((F.col("id") % 20).alias("g"), F.col("id").alias("a"), (F.col("id") + 20 * (F.col("id") % 3)).alias("b"), (F.col("id") % 7).cast("double").alias("w"))
    found = {rest: [{tuple(r) for r in x.collect()} for x in K.spanning_forest(edges, rest)] + [len(written)] for rest in (10**6, 20)}
    assert found[20][:2] == found[10**6][:2] and found[10**6][2] == 2 and found[20][2] == 4


def plain_hierarchy(far, samples, least):
    """Clusters of the condensed tree by the definition, from the top: cut the longest edge, keep what has ``least`` members, choose by stability. far: all distances."""
    n = len(far)
    core = np.sort(far + np.where(np.eye(n, dtype=bool), np.inf, 0), axis=1)[:, samples - 1]
    reach = np.maximum(far, np.maximum(core[:, None], core[None, :]))
    edges, parent = [], list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for w, a, b in sorted((reach[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            edges.append((w, a, b))

    def parts(members, tree):
        """The two sides when the last edge goes."""
        (w, a, b), rest = tree[-1], tree[:-1]
        side, grew = {a}, True
        while grew:
            grew = False
            for _, x, y in rest:
                if (x in side) != (y in side):
                    side |= {x, y}
                    grew = True
        return w, [(s, [e for e in rest if e[1] in s]) for s in (side, members - side)]

    def visit(members, tree, birth):
        """(own stability and what is within, chosen sets) of a cluster born at a density."""
        own = 0.0
        start = set(members)
        while True:
            w, (x, y) = parts(members, tree)
            at = 1 / max(w, D.CLOSEST)
            big = [p for p in (x, y) if len(p[0]) >= least]
            if len(big) == 1:
                own += (len(members) - len(big[0][0])) * (at - birth)
                members, tree = big[0]
                continue
            own += len(members) * (at - birth)
            inner = [visit(*p, at) for p in big]
            worth = sum(i[0] for i in inner)
            return (own, [start], [c for i in inner for c in i[1]]) if own >= worth else (worth, [c for i in inner for c in i[1]], [c for i in inner for c in i[1]])

    return visit(set(range(n)), edges, 0.0)[2]


@pytest.mark.parametrize("rest, exact", [(10**6, True), (0, True)])
def test_topics_are_the_hierarchy(spark, rest, exact):
    rng = random.Random(8)
    v = vectors_(90, dim=5, centres=4, spread=0.3, seed=2)
    rows = [(i % 2, i, rng.randint(1, 4), rng.randint(0, 27), v[i].tolist()) for i in range(90)]
    found = D.topics(spark.createDataFrame(rows, "g long, id long, outlet_id int, day int, embedding array<double>"), samples=3, least=5, k=60, cells=4, exact=exact, rest=rest).collect()
    got, want, noise = defaultdict(set), set(), 0
    for r in found:
        got[r["g"], r["label"]].add(r["id"])
    for g in (0, 1):
        own = [r for r in rows if r[0] == g]
        lo, hi = min(r[3] for r in own), max(r[3] for r in own)
        x = np.array([[*r[4], 0.2 * (r[3] - lo) / (hi - lo)] for r in own])
        far = np.linalg.norm(x[:, None] - x[None], axis=2)
        outlet = np.array([r[2] for r in own])
        share = np.array([(outlet == o).mean() for o in outlet])
        far = np.where(outlet[:, None] == outlet[None], far * (1 + 1.2 * share[:, None]), far)
        sets = plain_hierarchy(far, 3, 5)
        want |= {(g, frozenset(own[i][1] for i in s)) for s in sets}
        noise += len(own) - sum(map(len, sets))
    assert {(g, frozenset(s)) for (g, label), s in got.items() if label >= 0} == want and len(want) >= 3
    assert sum(len(s) for (_, label), s in got.items() if label < 0) == noise > 0
    assert sorted({label for _, label in got if label >= 0}) == list(range(1, len(want) + 1))


def test_topics_of_parts_that_nothing_ties(spark):
    """Two far blobs and a loose row with few neighbours each: parts meet at infinity, each is a topic; equal rows are as close as can be."""
    rows = [(0, i, i, 0, [1.0, 0.001 * (i % 7), 0.0]) for i in range(12)] + [(0, 100 + i, i, 0, [0.0, 0.0, 1.0]) for i in range(11)] + [(0, 500, 1, 0, [-1.0, -1.0, -1.0])]
    frame = spark.createDataFrame(rows, "g long, id long, outlet_id int, day int, embedding array<double>")
    got = {r["id"]: r["label"] for r in D.topics(frame, samples=2, least=5, k=4, penalty=0.0).collect()}
    assert {got[i] for i in range(12)} == {1} and {got[100 + i] for i in range(11)} == {2}
    assert D.topics(frame.limit(0)).count() == 0 and {r["label"] for r in D.topics(frame.limit(3)).collect()} == {-1}
    assert {r["id"]: r["label"] for r in D.first_topics(D.topics(frame.unionByName(frame.withColumn("g", F.lit(1))), samples=2, least=5, k=4, penalty=0.0)).collect()}[3] == 1


def test_numbers(spark):
    rows = spark.range(0, 1000, 1, 13).select((F.col("id") % 7).alias("g"), F.col("id"))
    assert [(r["g"], r["id"], r["number"]) for r in K.numbered(rows, ["g", "id"]).orderBy("number").collect()] == [(g, i, n + 1) for n, (g, i) in enumerate(sorted((i % 7, i) for i in range(1000)))]
    own = defaultdict(list)
    for r in K.numbered_within(rows, "g", [F.desc("id")]).collect():
        own[r["g"]].append((r["number"], -r["id"]))
    assert all([n for n, _ in sorted(x)] == list(range(1, len(x) + 1)) and sorted(x) == sorted(x, key=lambda y: y[1]) for x in own.values())
    assert K.numbered(rows.limit(0), ["id"]).count() == 0
