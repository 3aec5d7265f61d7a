"""Nearest vectors for many queries: all rows in one pass, or the likely rows through an inverted file.

``nearest`` multiplies each Arrow batch of vectors with a block of queries at once; a task keeps no more than the k best of each
query, and those are merged. Queries are broadcast in blocks of a bounded size, one pass over the vectors for each.

``build`` fits centroids on a sample of documented size, deals every vector to its nearest centroid's cell, and stores the vectors by cell.
``search`` compares a query with the centroids, reads the vectors of the nearest cells only, and takes exact cosines
of those. How many cells is tried on a sample of the vectors, so that a wanted share of the nearest is found.

Cases: a null or zero vector has cosine 0 with everything (its length counts as 1), vectors of another number of
dimensions are left out; ties go by id; repeated ids are rows of their own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.shipping import ship
from sieveline.storage import stored

#: Vectors that centroids are fitted on at most.
SAMPLE = 65_536
#: Share of the nearest that a search should find, and vectors on which the cells to read are tried.
RECALL, TRIED = 0.95, 200
#: Queries of one pass.
QUERIES = 4096
#: Vectors that are multiplied at a time.
ROWS = 4096


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size == 0, 1.0, size)


def _fixed(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``dims`` numbers, nulls in them as 0, and null vectors as zeros; and their places."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    whole, none = np.flatnonzero(lengths == dims), np.flatnonzero(lengths == -1)
    flat = pc.fill_null(column.take(whole).flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.concatenate([flat.reshape(len(whole), dims), np.zeros((len(none), dims))]), np.concatenate([whole, none])


class _Best:
    """The k best (score, id) of each query that a task has seen; ties by the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, dtype=object)] * n

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores[query]) == self.k:
            near = scores >= self.scores[query][-1]
            scores, ids = scores[near], ids[near]
        if not len(scores):
            return
        if len(scores) > 4 * self.k:  # what is below the k-th of this batch can't stay
            near = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[near], ids[near]
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i] is None, ids[i]))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


def _scored(shared, k: int, digits: int, by_cell: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        names, asked, cells = shared.value
        best = _Best(len(names), k)
        kind = pa.int64()
        for whole in batches:
            kind = whole.schema.field(0).type
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                rows, at = _fixed(batch.column(1), asked.shape[1])
                if not len(at):
                    continue
                ids = np.array(batch.column(0).to_pylist(), dtype=object)[at]
                unit = _unit(rows)
                if not by_cell:
                    scores = np.round(unit @ asked.T, digits)
                    for q in range(len(names)):
                        best.add(q, scores[:, q], ids)
                    continue
                here = batch.column(2).to_numpy(zero_copy_only=False)[at]
                for cell in np.unique(here):
                    queries = cells.get(int(cell), ())
                    if len(queries):
                        own = here == cell
                        scores = np.round(unit[own] @ asked[queries].T, digits)
                        for j, q in enumerate(queries):
                            best.add(q, scores[:, j], ids[own])
        for q, name in enumerate(names):
            if len(best.ids[q]):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(best.ids[q])), pa.array(list(best.ids[q]), kind), pa.array(best.scores[q])], ["query", "id", "cosine"])

    return run


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Names and unit vectors of the queries, ``QUERIES`` at a time."""
    names, rows = [], []
    for r in queries.select("query", "vector").toLocalIterator():
        names.append(r["query"])
        rows.append([x or 0.0 for x in r["vector"]])
        if len(names) == QUERIES:
            yield names, _unit(np.array(rows, dtype=np.float64))
            names, rows = [], []
    if names:
        yield names, _unit(np.array(rows, dtype=np.float64))


def _merged(found: list[DataFrame], k: int, empty: str, spark) -> DataFrame:
    """The k best of each query among what tasks kept: no more than k rows a task."""
    if not found:
        return spark.createDataFrame([], empty)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("query").orderBy(F.col("cosine").desc(), F.col("id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 100, id_col: str = "id", vector: str = "embedding", digits: int = 10) -> DataFrame:
    """query, id, cosine, rank: each query's k nearest of all vectors. queries: query, vector."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, cosine double"
    found = []
    for names, asked in _blocks(queries):
        shared = spark.sparkContext.broadcast((names, asked, {}))
        found.append(rows.mapInArrow(_scored(shared, k, digits, False), kinds))
    return _merged(found, k, f"{kinds}, rank int", spark)


@dataclass(frozen=True)
class InvertedFile:
    """Vectors by cell (id, vector, cell), sorted by cell, and the cells' centroids."""

    vectors: DataFrame
    centroids: np.ndarray
    n: int


def fit_centroids(vectors: DataFrame, vector: str, cells: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centroids by k-means over at most ``sample`` vectors; a larger table is sampled by the hash of its vectors, so any run picks the same."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "w").first()
    if width is None:
        return np.zeros((0, 0))
    rows = rows.filter(F.size("v") == width["w"])
    if width["n"] > sample:
        rows = rows.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(sample)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.withColumn("size", size).filter("size > 0").select(F.transform("v", lambda x: x / F.col("size")).alias("u"))
    points = stored(unit.select("u"), "sample").select(array_to_vector("u").alias("features"))
    if points.isEmpty():
        return np.zeros((0, width["w"]))
    model = KMeans(k=max(2, min(cells, points.count())), seed=seed, maxIter=15).fit(points)
    return _unit(np.array(model.clusterCenters()))


def _dealt(shared):
    def run(batches) -> Iterator:
        import pyarrow as pa

        centroids = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                rows, at = _fixed(batch.column(1), centroids.shape[1])
                cell = np.argmax(_unit(rows) @ centroids.T, axis=1).astype(np.int32) if len(at) else np.zeros(0, dtype=np.int32)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell)], ["id", "vector", "cell"])

    return run


def build(vectors: DataFrame, id_col: str = "id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> InvertedFile:
    """Index every vector. cells: the square root of their number if not given."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    n = rows.count()
    centroids = fit_centroids(rows, "vector", cells or max(2, round(n**0.5)), sample)
    if not len(centroids):
        return InvertedFile(rows.limit(0).withColumn("cell", F.lit(0)), centroids, 0)
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}, cell int"
    dealt = rows.mapInArrow(_dealt(spark.sparkContext.broadcast(centroids)), kinds)
    return InvertedFile(stored(dealt.repartitionByRange("cell", "id").sortWithinPartitions("cell"), "cells"), centroids, n)


def probes_for(index: InvertedFile, k: int = 50, recall: float = RECALL, sample: int = TRIED) -> int:
    """The fewest cells to read that hold ``recall`` of the k nearest, as found on ``sample`` of the vectors against all.

    How well cells part vectors depends on the vectors: of clear clusters a few cells do, of noise most are needed.
    """
    rows = index.vectors.filter("vector IS NOT NULL").orderBy(F.xxhash64("vector", F.lit(11)), "id").limit(sample)
    asked = stored(rows.withColumn("query", F.monotonically_increasing_id()).select("query", "vector"), "tried")
    exact = nearest(index.vectors, asked, k, "id", "vector")
    where = exact.select("query", "id").join(index.vectors.select("id", "cell"), "id").select("query", "cell").collect()  # sample times k rows
    if not where:
        return len(index.centroids)
    near = {}
    for names, unit in _blocks(asked):
        order = np.argsort(-(unit @ index.centroids.T), axis=1, kind="stable")
        near.update(zip(names, np.argsort(order, axis=1), strict=True))
    places = np.sort([near[r["query"]][r["cell"]] for r in where])
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1


def search(index: InvertedFile, queries: DataFrame, k: int = 50, probes: int | None = None, digits: int = 10) -> tuple[DataFrame, DataFrame]:
    """(query, id, cosine, rank) of each query's k nearest in its ``probes`` nearest cells, and (query, read): how many vectors those hold.

    probes: as many as ``probes_for`` finds if not given.
    """
    spark = index.vectors.sparkSession
    ship(spark)
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, id {index.vectors.schema['id'].dataType.simpleString()}, cosine double"
    probes = probes or (probes_for(index, k) if index.n else 0)
    sizes = index.vectors.groupBy("cell").agg(F.count("*").alias("n"))
    found, read = [], []
    for names, asked in _blocks(queries) if index.n else ():
        near = np.argsort(-(asked @ index.centroids.T), axis=1, kind="stable")[:, :probes]
        cells: dict[int, list[int]] = {}
        for q, row in enumerate(near):
            for c in row:
                cells.setdefault(int(c), []).append(q)
        shared = spark.sparkContext.broadcast((names, asked, {c: np.array(qs) for c, qs in cells.items()}))
        rows = index.vectors.filter(F.col("cell").isin(sorted(cells)))
        found.append(rows.mapInArrow(_scored(shared, k, digits, True), kinds))
        pairs = spark.createDataFrame([(names[q], c) for c, qs in cells.items() for q in qs], f"{kinds.split(',')[0]}, cell int")
        read.append(pairs.join(sizes, "cell", "left").groupBy("query").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read")))
    report = read[0] if read else spark.createDataFrame([], f"{kinds.split(',')[0]}, read bigint")
    for more in read[1:]:
        report = report.unionByName(more)
    return _merged(found, k, f"{kinds}, rank int", spark), report
