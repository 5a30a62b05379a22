"""Approximate neighbours by an inverted file: vectors listed under the nearest of a number of centroids.

Centroids are fitted on a bounded sample; every vector is listed. A query for its k nearest looks through the lists of
its nearest centroids, as many as are asked for: more probes, more recall. A query for all vectors within a threshold
needs no such number: angles obey the triangle inequality, so that the lists which can hold one, and the part of each,
are known, and nothing is missed. Lists are read in parts of bounded size, so a list that holds a third of all vectors
is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scores import usable
from gleanery.operators.retrieval import ASKED_AT_ONCE, VECTOR_BLOCK, components, ranked
from gleanery.operators.steps import written

#: Vectors that centroids are fitted on, at most about, and the rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
#: Queries of a block, which meets a part of a list in a task: each row listed is shuffled once for each block.
QUERY_BLOCK = 16384
_SLACK = 1e-9


def _units(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors at length 1; one of no length stays zero."""
    rows = components(column).reshape(-1, width)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def fit_centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """(lists x width) directions that are centres of a sample of vectors (vec_id, embedding), taken by a hash of the
    id, or of all where they are no more than ``sample``: clustering by cosine, begun at vectors far from each other.
    Vectors of another width than most are left out."""
    held = vectors.where(usable(F.col("embedding")))
    most = held.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    n = most["n"] if most else 0
    held = held.where(F.size("embedding") == (most["width"] if most else 0))
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    rows = held.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= share).select("vec_id", "embedding").limit(2 * sample).toArrow().sort_by("vec_id")
    if not len(rows):
        return np.zeros((0, 0))
    points = _units(rows.column("embedding"), len(rows.column("embedding")[0]))
    points = points[(points != 0).any(axis=1)]
    if not len(points):
        return np.zeros((0, 0))
    chosen, near = [0], points @ points[0]
    while len(chosen) < min(lists, len(points)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1.0), centres)
    return centres


@dataclass(frozen=True)
class InvertedFile:
    """lists: (list, angle, part, vec_id, embedding and further columns), written, by list and angle; sizes: of each
    list its number of parts and the greatest angle of a vector to the centroid."""

    centroids: np.ndarray
    lists: DataFrame
    sizes: dict[int, tuple[int, float]]


def inverted_file(vectors: DataFrame, centroids: np.ndarray) -> InvertedFile:
    """Lists every vector (vec_id, embedding, ...) but those that are null, of another width, of no length, or with
    components that are null or not finite, which are near nothing."""
    width = centroids.shape[1]
    held = vectors.where(usable(F.col("embedding")) & (F.size("embedding") == width) & F.exists("embedding", lambda x: x != 0))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _units(batch.column("embedding"), width) @ centroids.T
            own = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "list", "angle"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    if not len(centroids):
        return InvertedFile(centroids, held.limit(0).selectExpr("*", "0 AS list", "0D AS angle", "0L AS part"), {})
    near = held.mapInArrow(listed, f"{kinds}, list int, angle double")
    rows = written(near.repartitionByRange("list", "angle", "vec_id").sortWithinPartitions("list", "angle"), "inverted-file")
    told = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row a centroid
    sizes = {r["list"]: (-(-r["n"] // VECTOR_BLOCK), r["radius"]) for r in told}
    parts = F.element_at(F.create_map(*[F.lit(x) for k, (n, _) in sizes.items() for x in (k, n)]), F.col("list")) if sizes else F.lit(1)
    return InvertedFile(centroids, rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts)), sizes)


def _probed(queries: DataFrame, file: InvertedFile, probes: int | None, least: float | None) -> DataFrame:
    """(query_id, wanted, list, part): the lists that a query is to look through."""
    centroids, sizes = file.centroids, file.sizes
    width, numbers = centroids.shape[1], np.array(sorted(sizes), np.int64)
    radius = np.array([sizes[int(i)][1] for i in numbers])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _units(batch.column("embedding"), width) @ centroids[numbers].T
            if probes is not None:
                row = np.repeat(np.arange(len(near)), min(probes, len(numbers)))
                at = np.argsort(-near, axis=1, kind="stable")[:, :probes].ravel()
            else:
                row, at = np.nonzero(np.arccos(np.clip(near, -1.0, 1.0)) - radius <= np.arccos(least) + _SLACK)
            starts = np.searchsorted(row, np.arange(len(near) + 1))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(numbers[at].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("embedding"), lists], ["query_id", "wanted", "lists"])

    held = queries.where(usable(F.col("embedding")) & (F.size("embedding") == width) & F.exists("embedding", lambda x: x != 0))
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    # a row a query leaves Python; it meets its lists and their parts afterwards
    told = held.select("query_id", "embedding").mapInArrow(task, f"query_id {kinds['query_id']}, wanted {kinds['embedding']}, lists array<int>").select("query_id", "wanted", F.explode("lists").alias("list"))
    parts = F.element_at(F.create_map(*[F.lit(x) for k, (n, _) in sizes.items() for x in (k, n)]), F.col("list"))
    return told.select("query_id", "wanted", "list", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))


def _looked_through(queries: DataFrame, file: InvertedFile, where: Column | None, probes: int | None, least: float | None, k: int | None, digits: int) -> DataFrame:
    """(query_id, vec_id, similarity): of each query and part of a list, the k best or all that reach ``least``."""
    kinds = queries.schema["query_id"].dataType.simpleString(), file.lists.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double"
    if not file.sizes:
        return queries.sparkSession.createDataFrame([], schema)
    width = file.centroids.shape[1]
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = file.lists if where is None else file.lists.where(where)
    right = rows.select("list", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", F.col("embedding").alias("known"))
    left = _probed(queries, file, probes, least).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def met(asked: pa.Table, known: pa.Table) -> pa.Table:
        query, vector = asked.column("query_id"), known.column("vec_id")
        rows, columns, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(asked) and len(known):
            order = np.argsort(vector.to_numpy(), kind="stable")
            vector = vector.take(pa.array(order))
            wanted, held = _units(asked.column("wanted"), width), _units(known.column("known"), width)[order].T
            asks, knows = query.to_numpy(), vector.to_numpy()
            for i in range(0, len(asks), ASKED_AT_ONCE):
                near = wanted[i : i + ASKED_AT_ONCE] @ held
                if k is not None:
                    near[asks[i : i + ASKED_AT_ONCE, None] == knows] = -np.inf
                    column = np.argsort(-np.round(near, digits), axis=1, kind="stable")[:, :k]  # of equals, the smallest id
                    row, column = np.repeat(np.arange(len(near)), column.shape[1]), column.ravel()
                    own = near[row, column] > -np.inf
                else:
                    row, column = np.nonzero(near >= least)
                    own = asks[i + row] != knows[column]
                row, column = row[own], column[own]
                rows.append(i + row)
                columns.append(column)
                found.append(near[row, column])
        row, column, similarity = map(np.concatenate, (rows, columns, found))
        return pa.table({"query_id": query.take(pa.array(row)), "vec_id": vector.take(pa.array(column)), "similarity": pa.array(np.round(similarity, digits))})

    keys = ("list", "part", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, schema)


def nearest(queries: DataFrame, file: InvertedFile, k: int, probes: int, where: Column | None = None, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, similarity, rank): about the k nearest vectors by cosine of each query (query_id, embedding),
    from the lists of its ``probes`` nearest centroids, among those for which ``where``, over the columns listed, holds.
    Null vectors and those of another width have none; a vector is no neighbour of itself; ties by vec_id."""
    found = _looked_through(queries, file, where, probes, None, k, digits)
    return ranked(found, ["query_id"], F.desc("similarity"), F.col("vec_id")).where(F.col("rank") <= k)


def within(queries: DataFrame, file: InvertedFile, least: float, where: Column | None = None, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, similarity): all vectors whose cosine with a query is ``least`` or more, exactly."""
    return _looked_through(queries, file, where, None, least, None, digits)


def cached(queries: DataFrame, file: InvertedFile, least: float = 0.92, where: Column | None = None) -> DataFrame:
    """(query_id, vec_id, similarity): the nearest earlier question, if it is as near as ``least``; ties by vec_id."""
    return ranked(within(queries, file, least, where), ["query_id"], F.desc("similarity"), F.col("vec_id")).where("rank = 1").drop("rank")
