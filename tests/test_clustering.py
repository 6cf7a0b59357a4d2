"""Event and topic clusters against their definitions in plain Python, on a small table."""

import math
import random
from collections import defaultdict

import pytest

from newsloom.operators import clustering as C


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(k, rng.randint(1, 4), k % 2, rng.randint(0, 20), [x + rng.gauss(0, 0.35) for x in rng.choice(centres)]) for k in range(70)]
    rows += [(70, 1, 2, 3, centres[0]), (71, 2, 2, 4, centres[0])]  # a topic that is too small
    return rows, spark.createDataFrame(rows, "id long, outlet_id int, cluster_id int, day int, embedding array<double>")


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def linked(points, cut):
    """Average linkage by the definition: while the least mean distance of two groups is at most ``cut``, they merge."""
    groups = [[p] for p in points]
    mean = lambda a, b: sum(1 - cosine(x[4], y[4]) for x in a for y in b) / len(a) / len(b)
    while len(groups) > 1:
        far, i, j = min((mean(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if far > cut:
            break
        groups[i] += groups.pop(j)
    return groups


def test_events(articles):
    rows, df = articles
    cut, merge, expected = 0.25, 0.1, set()
    for topic in (0, 1):
        of, part = defaultdict(list), {}
        for r in rows:
            if r[2] == topic:
                for w in range(8):
                    if 3 * w <= r[3] <= 3 * w + 7:
                        of[w].append(r)
        for w in sorted(of):
            for k, g in enumerate(linked(sorted(of[w]), cut)):
                for r in g:
                    part.setdefault(r[0], (w, k))  # the earliest window wins
        nodes = defaultdict(list)
        for r in rows:
            if r[0] in part and r[2] == topic:
                nodes[part[r[0]]].append(r)
        unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
        centre = {n: [sum(x) / len(g) for x in zip(*(unit(r[4]) for r in g), strict=True)] for n, g in nodes.items()}
        event = {n: n for n in nodes}
        for _ in nodes:
            for a in nodes:
                for b in nodes:
                    if b[0] == a[0] + 1 and 1 - cosine(centre[a], centre[b]) < merge:
                        event[a] = event[b] = min(event[a], event[b])
        for top in set(event.values()):
            members = [r for n, g in nodes.items() if event[n] == top for r in g]
            if len({r[1] for r in members}) >= 2:
                expected.add((topic, frozenset(r[0] for r in members), len({r[1] for r in members})))
    found = defaultdict(set)
    for r in C.event_clusters(df, cut=cut, merge=merge).collect():
        found[r["cluster_id"], r["event"], r["outlets"]].add(r["id"])
    assert len(expected) > 3 and {(t, frozenset(ids), n) for (t, _, n), ids in found.items()} == expected


def test_linkage_is_the_greedy_one():
    import numpy as np

    rng = np.random.default_rng(6)
    for n, cut in [(1, 0.3), (2, 2.0), (40, 0.15), (60, 0.4), (50, 0.9), (30, 2.0)]:
        v = rng.normal(size=(n, 4)) + 1.5 * rng.integers(0, 2, (n, 1))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        v[n // 2] = v[0]
        label = C.average_linkage(v, cut)
        want = {frozenset(p[0] for p in g) for g in linked([(i, 0, 0, 0, x.tolist()) for i, x in enumerate(v)], cut)}
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == want


@pytest.mark.parametrize("cells", [1, 7])
def test_parts_of_windows(spark, articles, cells):
    """A group is cut into parts that cannot meet; rows that nothing is near to are parts of their own."""
    rows, _ = articles
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    frame = spark.createDataFrame([(r[2], r[0], unit(r[4])) for r in rows], "g long, id long, vec array<double>")
    found = defaultdict(set)
    for r in C.linkage_parts(frame, 0.12, cells).collect():
        found[r["g"], r["part"]].add(r["id"])
    want = {(g, frozenset(p[0] for p in part)) for g in (0, 1, 2) for part in linked([r for r in rows if r[2] == g], 0.12)}
    assert {(g, frozenset(ids)) for (g, _), ids in found.items()} == want and all(min(ids) == p for (_, p), ids in found.items())


def test_event_numbers(articles):
    _, df = articles
    first = {}
    for r in C.event_clusters(df, cut=0.25, merge=0.1).collect():
        first.setdefault(r["event"], set()).add(r["cluster_id"])
    assert sorted(first) == list(range(1, len(first) + 1)) and all(len(t) == 1 for t in first.values())
    order = [min(first[e]) for e in sorted(first)]
    assert order == sorted(order)


def test_matches_by_index_equal_those_by_matrix(spark, articles):
    from newsloom.operators import factchecks as K

    rows, df = articles
    centres = df.where("id % 6 = 0").selectExpr("cast(id as int) AS cluster", "embedding AS centroid")
    told = [sorted(map(tuple, K.coarse_matches(df, centres, 0.3, most=most).collect())) for most in (100, 5)]
    assert told[0] == told[1] and len(told[0]) > 100 and max(t[2] for t in told[0]) == 3
    assert K.coarse_matches(df, centres.limit(0), 0.3).count() == 0


def test_common_terms_make_no_pairs(spark):
    """Titles that share one term of every title: hardly any pairs, the same rows as of all pairs; copies are one."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(4000)]
    rows = [(i, 1, "știre " + "news " + " ".join(rng.choice(words) for _ in range(9))) for i in range(400)] + [(400 + i, 1, "news copied title of many rows") for i in range(50)] + [(500, 2, "alone here"), (501, 2, None), (502, 3, "x")]
    df = spark.createDataFrame(rows, "id long, g long, title string")
    vectors = C.title_vectors(df, "g").collect()
    of = {(r["g"], r["id"]): {x["term"]: x["w"] for x in r["v"]} for r in vectors}
    close = {a for a in of for b in of if a != b and a[0] == b[0] and sum(w * of[b].get(t, 0) for t, w in of[a].items()) >= 0.15}
    found = {(r["g"], r["id"]) for r in C.title_filter(df, "g").collect()}
    assert found == close | {(2, 500), (2, 501), (3, 502)} and 50 < len(close) < 450
    once = spark.createDataFrame([r for r in vectors if r["id"] < 401], C.title_vectors(df, "g").schema)
    pairs = C.title_candidates(once, 0.15).count()
    assert pairs < 0.05 * 401 * 400 / 2
