"""[F2, J12, J13] Nearest neighbours by inverted lists: cells around centres that are fitted on a bounded sample and cover every row.

An approximate search reads the ``probes`` nearest cells of each query. In an exact one a group's cells, which are numbered so that near ones follow each other,
are put together to runs of about ``block`` rows, and a query goes once to each run that it needs, however many cells of it are near: first to that of its
nearest cell, which gives the k-th distance as a bound, and then to every further run with a cell that may hold something nearer: a cell's rows lie
within its radius of its centre, so none is nearer than the query's distance to the centre less the radius. The rows and the queries of a run (or cell) are
cut into blocks of bounded size by hash, and each pair of blocks is one task's matrix product, a slice of queries at a time, so neither a full cell
nor a popular one lands in one task. What is shuffled are the vectors by the runs that they meet, not by the cells.
Cosine distance is half the square of the distance of unit vectors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import vectors
from newsloom.operators.sinks import checkpointed, shared_folder

#: Rows of the sample and its bytes at most, cells at most, rows of a block, distances held at once.
SAMPLE, SAMPLE_BYTES, CELLS, BLOCK, SLICE = 20_000, 64 << 20, 4_096, 8_192, 1 << 20
PROBES = 8
#: Rows of a table of runs that are broadcast at most.
RUNS = 500_000


class Index(NamedTuple):
    """rows: g (a search stays in its group), id, vec, kin, factor, cell. Rows of one kin lie ``factor`` times as far apart as their vectors."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def _nearest_centres(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point its nearest centre and how far that is."""
    own, far = np.zeros(len(points), int), np.zeros(len(points))
    step = max(1, SLICE // len(centres))
    for i in range(0, len(points), step):
        part = _distances(points[i : i + step], centres)
        own[i : i + step], far[i : i + step] = part.argmin(1), part.min(1)
    return own, far


def fitted_centres(rows: DataFrame, cells: int | None = None, rounds: int = 8) -> np.ndarray:
    """The centres of ``cells`` cells (the root of the number of rows, if None) by k-means on at most SAMPLE rows of (id, vec), drawn by hash of the id."""
    n = rows.count()
    if not n:
        return np.zeros((1, 1))
    wide = max(1, rows.select(F.size("vec").alias("n")).first()["n"])
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * wide)))
    points = _stack(rows.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toPandas()["vec"])
    count = min(len(points), cells or max(1, min(CELLS, round(n**0.5))))
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        own, _ = _nearest_centres(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=count)[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    middle = centres - centres.mean(0)
    return centres[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]  # near ones have near numbers


def build(rows: DataFrame, cells: int | None = None) -> Index:
    """The index of ``rows`` (g, id, vec, kin, factor), without those that have no vector, as a table in the shared folder."""
    spark = rows.sparkSession
    rows = rows.where("vec IS NOT NULL")
    centres = fitted_centres(rows, cells)
    shared = spark.sparkContext.broadcast(centres)  # CELLS vectors at most

    @F.pandas_udf("struct<cell: int, far: double>")
    def placed(vec: pd.Series) -> pd.DataFrame:
        own, far = _nearest_centres(_stack(vec), shared.value)
        return pd.DataFrame({"cell": own.astype(np.int32), "far": far})

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    rows.withColumn("at", placed("vec")).select("g", "id", "vec", "kin", "factor", "at.far", "at.cell").write.parquet(path)
    kept = spark.read.schema("g long, id long, vec array<double>, kin long, factor double, far double, cell int").parquet(path)
    radius = np.full(len(centres), -np.inf)
    for r in kept.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a number for each cell
        radius[r["cell"]] = r["far"]
    return Index(kept.drop("far"), centres, radius)


def prepared(rows: DataFrame, id_col: str, vec: Column, group: Column | None = None, kin: Column | None = None, factor: Column | None = None) -> DataFrame:
    """Rows as build() and nearest() take them; without a group all are one."""
    null = F.lit(None)
    return rows.select((group if group is not None else F.lit(0)).cast("long").alias("g"), F.col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec"), (kin if kin is not None else null).cast("long").alias("kin"), (factor if factor is not None else F.lit(1.0)).cast("double").alias("factor"))


def unit(column: str) -> Column:
    """The vector at length one; null without a length."""
    v = vectors.l2_normalize(F.col(column))
    return F.when(vectors.norm(F.col(column)) > 0, v)


def _probed(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """queries with ``near``, the nearest cells that have rows."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius))

    @F.pandas_udf("array<int>")
    def near(vec: pd.Series) -> pd.Series:
        centres, radius = shared.value
        if np.isinf(radius).all():
            return pd.Series([[]] * len(vec))
        far = _distances(_stack(vec), centres) + np.where(np.isinf(radius), np.inf, 0)
        order = np.argsort(far, 1, kind="stable")[:, :probes]
        return pd.Series([o[np.isfinite(f[o])].astype(np.int32) for o, f in zip(order, far, strict=True)])

    return queries.withColumn("near", near("vec"))


def _small(df: DataFrame) -> DataFrame:
    """A table of runs, stored; broadcast, unless it is of very many groups."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= RUNS else df


def _runs(index: Index, block: int) -> DataFrame:
    """(g, starts): the first cells of the runs of about ``block`` rows that each group's cells are put together to; a cell of more rows is in one run."""
    by = Window.partitionBy("g")  # the cells of a group, CELLS at most
    sizes = index.rows.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"))
    upto = sizes.withColumns({"before": F.sum("n").over(by.orderBy("cell")) - F.col("n"), "all": F.sum("n").over(by)})
    run = F.floor(F.col("before") * F.ceil(F.col("all") / block) / F.col("all"))
    return _small(upto.groupBy("g", run.alias("run")).agg(F.min("cell").alias("start")).groupBy("g").agg(F.array_sort(F.collect_list("start")).alias("starts")))


#: The run of a cell; one that the group has no rows of counts as the one before it.
_RUN = "greatest(0, size(filter(starts, x -> x <= {})) - 1)"


def _further(queries: DataFrame, index: Index) -> DataFrame:
    """queries (with starts, near and bound) and ``more``: the other runs than those of ``near`` that may hold a row nearer than ``bound`` (null: any)."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius))

    @F.pandas_udf("array<int>")
    def more(vec: pd.Series, starts: pd.Series, near: pd.Series, bound: pd.Series) -> pd.Series:
        centres, radius = shared.value
        limit = bound.fillna(np.inf).to_numpy() * (1 + 1e-9) + 1e-6  # more than rounding
        out: list[np.ndarray] = []
        step = max(1, SLICE // len(centres))
        for i in range(0, len(vec), step):
            lower = _distances(_stack(vec.iloc[i : i + step]), centres) - radius
            for row, x, first, seen in zip(lower, limit[i : i + step], starts.iloc[i : i + step], near.iloc[i : i + step], strict=True):
                cells = np.flatnonzero((row <= x) & np.isfinite(row))
                out.append(np.setdiff1d(np.maximum(0, np.searchsorted(first, cells, "right") - 1), seen).astype(np.int32))
        return pd.Series(out, dtype=object)

    return queries.withColumn("more", more("vec", "starts", "near", "bound"))


def _blocks(asked: DataFrame, rows: DataFrame, block: int):
    """The queries and the rows of the index, either with ``run`` (of a query a row for each run that it needs), each in blocks of about ``block`` of a run, as
    groups of one block of either: a, va, ka, fa of the queries; b, vb, kb of the rows."""
    sizes = rows.groupBy("g", "run").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    loads = asked.groupBy("g", "run").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("loads"))
    cut = _small(sizes.join(loads, ["g", "run"]))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = asked.join(cut, ["g", "run"]).withColumn("load", part("loads")).withColumn("block", every("blocks")).select("g", "run", "block", "load", "id", "vec", "kin", "factor").toDF("g", "run", "block", "load", "a", "va", "ka", "fa")
    held = rows.join(cut, ["g", "run"]).withColumn("block", part("blocks")).withColumn("load", every("loads")).select("g", "run", "block", "load", "id", "vec", "kin").toDF("g", "run", "block", "load", "b", "vb", "kb")
    return ask.groupBy("g", "run", "block", "load").cogroup(held.groupBy("g", "run", "block", "load"))


def _searched(asked: DataFrame, rows: DataFrame, k: int, same: bool, within: float | None, block: int) -> DataFrame:
    """(g, query, id, distance): of each (query, run) of ``asked`` and each block of the run the k nearest rows."""
    schema = "g long, query long, id long, distance double"

    def met(key: tuple, ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or rows.empty:
            return pd.DataFrame({"g": [], "query": [], "id": [], "distance": []})
        b, ids, others = _stack(rows["vb"]), rows["b"].to_numpy(), rows["kb"].to_numpy(float)
        query, found, distance = [], [], []
        step = max(1, SLICE // len(b))
        for at in range(0, len(ask), step):
            some = ask.iloc[at : at + step]
            a, own = _stack(some["va"]), some["a"].to_numpy()
            times = np.where(some["ka"].to_numpy(float)[:, None] == others[None, :], some["fa"].to_numpy(float)[:, None], 1.0)
            far = _distances(a, b) * times
            if same:
                far[own[:, None] == ids[None, :]] = np.inf
            if within is not None:
                far[far > within + 1e-6] = np.inf
            limit = np.partition(far, k - 1, 1)[:, k - 1] if k < len(b) else np.full(len(a), np.inf)
            for i, x in enumerate(limit):
                j = np.flatnonzero((far[i] <= x + 1e-6) & np.isfinite(far[i]))
                exact = np.sqrt(((a[i] - b[j]) ** 2).sum(1)) * times[i, j]  # without the rounding of the product
                best = np.lexsort((ids[j], exact))[:k]
                if within is not None:
                    best = best[exact[best] <= within]
                query.append(np.full(len(best), own[i]))
                found.append(ids[j[best]])
                distance.append(exact[best])
        return pd.DataFrame({"g": key[0], "query": np.concatenate(query), "id": np.concatenate(found), "distance": np.concatenate(distance)})

    return _blocks(asked, rows, block).applyInPandas(met, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("g", "query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(index: Index, queries: DataFrame, k: int, *, probes: int = PROBES, exact: bool = False, same: bool = False, within: float | None = None, block: int = BLOCK) -> DataFrame:
    """(g, query, id, distance, rank): the k rows of its group nearest to each of ``queries`` (as prepared()), ties by id, at most ``within`` away. same: queries and
    rows share their ids, and a row is no neighbour of itself."""
    queries = queries.where("vec IS NOT NULL")
    if not exact:
        asked = _probed(queries, index, probes).withColumn("run", F.explode("near")).drop("near")
        return _best(_searched(asked, index.rows.withColumnRenamed("cell", "run"), k, same, within, block), k)
    runs = _runs(index, block)
    rows = index.rows.join(runs, "g").withColumn("run", F.expr(_RUN.format("cell"))).drop("starts", "cell")
    asked = checkpointed(_probed(queries, index, 1).join(runs, "g").withColumn("near", F.expr(f"transform(near, c -> {_RUN.format('c')})")))
    first = checkpointed(_best(_searched(asked.withColumn("run", F.explode("near")).drop("near", "starts"), rows, k, same, within, block), k))
    bound = first.where(F.col("rank") == k).select("g", F.col("query").alias("id"), F.col("distance").alias("bound"))
    bounded = asked.join(bound, ["g", "id"], "left")
    if within is not None:
        bounded = bounded.withColumn("bound", F.least(F.coalesce("bound", F.lit(within)), F.lit(within)))
    rest = checkpointed(_further(bounded, index).where("size(more) > 0").drop("near", "starts", "bound")).withColumn("run", F.explode("more")).drop("more")
    return _best(first.drop("rank").unionByName(_searched(rest, rows, k, same, within, block)), k)


def _tied(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (row, column) that are true; each row and column is looked at once."""
    out: list[tuple[int, int]] = []
    left, fresh = np.ones(len(near), bool), np.ones(near.shape[1], bool)
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start], ahead = False, [start]
        while ahead:
            i = ahead.pop()
            columns = np.flatnonzero(near[i] & fresh)
            fresh[columns] = False
            out += [(i, int(j)) for j in columns]
            for j in columns:
                met = np.flatnonzero(near[:, j] & left)
                left[met] = False
                out += [(int(m), int(j)) for m in met]
                ahead += met.tolist()
    return out


def linked(index: Index, within: float, *, block: int = BLOCK) -> DataFrame:
    """(g, a, b): edges whose components are those of all pairs at most ``within`` apart; of each pair of blocks a spanning forest, not all its pairs."""
    rows = checkpointed(index.rows.join(_runs(index, block), "g").withColumn("run", F.expr(_RUN.format("cell"))).drop("cell"))
    queries = _further(rows.drop("run").withColumns({"near": F.array().cast("array<int>"), "bound": F.lit(float(within))}), index)
    asked = checkpointed(queries.drop("near", "bound", "starts")).withColumn("run", F.explode("more")).drop("more")

    def met(key: tuple, ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(ask) and len(rows):
            b, ids, own = _stack(rows["vb"]), rows["b"].tolist(), ask["a"].tolist()
            step = max(1, SLICE // len(b))
            near = np.concatenate([_distances(_stack(ask["va"].iloc[i : i + step]), b) <= within for i in range(0, len(ask), step)])
            out = [(own[i], ids[j]) for i, j in _tied(near)]
        return pd.DataFrame({"g": key[0], "a": [x for x, _ in out], "b": [y for _, y in out]})

    return _blocks(asked, rows.drop("starts"), block).applyInPandas(met, "g long, a long, b long")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours (g, query, id) that were found."""
    hit = truth.select("g", "query", "id").join(found.select("g", "query", "id"), ["g", "query", "id"], "left_semi").count()
    return hit / max(1, truth.count())
