"""Lloyd's clustering in exact integers, with an annulus search for the nearest centroid.

Centroids are kept sorted by their norms. The distance of a vector to any one centroid bounds that to its nearest one,
and no centroid is nearer to it than their norms differ, so only centroids whose norm lies within that bound of the
vector's, an annulus around the origin that two binary searches cut out, are compared; its edges belong to it, and the
comparison is in integers, so that ties are told. A round is one pass over the vectors, whose tasks give sums by
cluster; the driver sees as many rows as there are clusters times components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.scratch import Scratch
from gleanery.llm.vectors import is_finite, matrix

CLUSTERS, ROUNDS, SCALE, WIDTH = 8, 10, 1024, 64
#: Components below this in size are compared in 64-bit integers, larger ones in integers without bounds.
SMALL = 1 << 27
_LONG = (1 << 63) - 1


def integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all components, each of which fits a long."""
    whole = np.floor(matrix(vectors, width) * scale).astype(np.int64)
    return whole if not len(whole) or np.abs(whole).max() < SMALL else whole.astype(object)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each point's nearest centroid, the smallest among equally near ones, and their squared distance."""
    n, k = len(points), len(centroids)
    if points.dtype == object or centroids.dtype == object:
        points, order, low, high = points.astype(object), np.arange(k), np.zeros(n, np.int64), np.full(n, k)
        centroids, cluster = centroids.astype(object), np.zeros(n, np.int64)
        distance = _squared(points, centroids[cluster])
    else:
        sizes, own = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1)), np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        after = np.clip(np.searchsorted(sizes, own), 0, k - 1)
        before = np.maximum(after - 1, 0)
        cluster = order[np.where(np.abs(sizes[before] - own) <= np.abs(sizes[after] - own), before, after)]
        distance = _squared(points, centroids[cluster])
        reach = np.sqrt(distance) + 1e-9 * own + 1e-6  # the edges of the annulus are in it, rounding or not
        low, high = np.searchsorted(sizes, own - reach, "left"), np.searchsorted(sizes, own + reach, "right")
    for j in range(k):
        rows = np.flatnonzero((low <= j) & (j < high))
        told = _squared(points[rows], centroids[order[j]])
        better = (told < distance[rows]) | ((told == distance[rows]) & (order[j] < cluster[rows]))
        rows = rows[better.astype(bool)]
        cluster[rows], distance[rows] = order[j], told[better.astype(bool)]
    return cluster, distance


def _array(centroids: list[list[int]]) -> np.ndarray:
    return np.array(centroids, np.int64 if max(abs(x) for c in centroids for x in c) < SMALL else object)


def _sums(centroids: list[list[int]], scale: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(embedding) -> (cluster, place, total, n): sums of each component over the vectors that are nearest."""
        k, width, of = len(centroids), len(centroids[0]), _array(centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, width), object)
        for batch in batches:
            points = integers(batch.column("embedding"), width, scale)
            cluster, _ = nearest(points, of)
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += points[cluster == c].sum(axis=0).astype(object)
        rows = [(c, i) for c in range(k) if n[c] for i in range(width)]
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array([c for c, _ in rows], pa.int32()),
                "place": pa.array([i for _, i in rows], pa.int32()),
                "total": pa.array([int(total[c, i]) for c, i in rows], pa.decimal128(38, 0)),
                "n": pa.array([int(n[c]) for c, _ in rows], pa.int64()),
            }
        )

    return task


def _assigned(centroids: list[list[int]], scale: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _array(centroids)
        for batch in batches:
            cluster, distance = nearest(integers(batch.column("embedding"), len(centroids[0]), scale), of)
            distance = distance if distance.dtype != object else np.array([min(int(d), _LONG) for d in distance], np.int64)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})

    return task


def clusters(vectors: DataFrame, first: Column, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """The cluster of every vector, after ``rounds`` rounds of Lloyd's algorithm.

    vectors: vec_id, embedding; further columns are ignored. Kept are vectors of exactly ``width`` components, none of
    them null or not finite; each component x becomes the integer floor(scale * x), x as double, and a vector with one
    that doesn't fit a long isn't kept either. Centroids 0, 1, ... start as the ``k`` kept vectors with the smallest
    ``first`` (nulls last; ties by vec_id, then by the vector itself). A round assigns every vector to the nearest
    centroid, the smaller number among equally near ones, and replaces each centroid that has vectors by their
    componentwise floor(sum / count). Then all are assigned once more.

    Returns one row per kept row: vec_id, cluster int, distance long (squared), cluster_inertia and inertia long
    (summed over the cluster and over all), centroid_sha256 (of the cluster's last centroid, its components in decimal,
    joined by commas). What doesn't fit a long is given as the greatest long. Rows that repeat a vec_id, or have none,
    count as one vector each. With fewer than k kept rows there are as many centroids; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clustering")
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < 9.2e18)
    kept = vectors.where(is_finite(F.col("embedding")) & (F.size("embedding") == width) & fits)
    starts = kept.select("vec_id", "embedding", first.alias("_first")).orderBy(F.col("_first").asc_nulls_last(), "vec_id", "embedding").limit(k).select("embedding").collect()
    kept = scratch.keep(kept.select("vec_id", "embedding"), "kept")
    centroids = [list(map(int, integers(pa.array([list(r[0])]), width, scale)[0])) for r in starts]
    for _ in range(rounds if centroids else 0):
        told = kept.select("embedding").mapInArrow(_sums(centroids, scale), "cluster int, place int, total decimal(38,0), n long")
        for r in told.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            centroids[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    if not centroids:
        found = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        found = kept.mapInArrow(_assigned(centroids, scale), "vec_id long, cluster int, distance long")
    found = scratch.keep(found, "assigned")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # at most k rows
    bounded = lambda x: min(int(x), _LONG)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = bounded(sum(r["own"] for r in inertia))
    told = spark.createDataFrame([(r["cluster"], bounded(r["own"]), whole, digest[r["cluster"]]) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
