"""Hard negatives by branch-and-bound in ball trees.

The rows are dealt into parts of bounded size, and the anchors into blocks; a task holds one part against one block. It
builds the part's ball tree, whose nodes are balls around groups of vectors, and takes all queries of the block down it
together. A node's ball bounds the inner products of its vectors with a query from both sides: the product with the
centre, more or less the radius times the query's length. A query leaves a node where all of its products are outside
the query's window of scores, or strictly beneath its k-th best so far; equal ones stay, as ties are told by id. The
best of all parts are the answer. Anchors are queries twice: for their positives, and then for negatives in the windows
that these set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.scratch import Scratch
from gleanery.llm.vectors import is_finite, matrices, one_row_an_id

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Rows of a part, at least and at most, and anchors of a block. A task holds a part, its tree and a block: some 100 MB.
LEAST_ROWS, MOST_ROWS, BLOCK = 2_048, 131_072, 4_096
#: Vectors of a leaf.
LEAF = 64
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    """Vectors in the order of the leaves, and the nodes: from, to, centre, radius, children (0: a leaf)."""

    def __init__(self, points: np.ndarray):
        self.order, self.nodes = np.arange(len(points)), []
        todo = [(0, len(points), None)]
        while todo:
            a, b, parent = todo.pop()
            own = points[self.order[a:b]]
            centre = own.mean(axis=0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            at = len(self.nodes)
            self.nodes.append([a, b, centre, radius, 0, 0])
            if parent is not None:
                self.nodes[parent][4 if not self.nodes[parent][4] else 5] = at
            if b - a > LEAF and radius > 0:
                middle = (a + b) // 2
                along = np.argmax(own.max(axis=0) - own.min(axis=0))
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, along], middle - a)]
                todo += [(middle, b, at), (a, middle, at)]
        self.points = points[self.order]


def search(tree: BallTree, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, own: np.ndarray, of: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query, by score and then the smaller id: rows other than ``own`` whose label is
    that of the query (``same``) or another one, and whose score lies from low to high. Places without one: _NONE."""
    n, lengths = len(queries), np.sqrt((queries * queries).sum(axis=1))
    score, best = np.full((n, k), _NONE), np.full((n, k), _LAST)
    ids, labels = ids[tree.order], labels[tree.order]
    todo = [(0, np.arange(n))] if len(ids) else []
    while todo:
        at, active = todo.pop()
        a, b, centre, radius, left, right = tree.nodes[at]
        middle, spread = queries[active] @ centre, radius * lengths[active]
        spread = spread + 1e-9 * (np.abs(middle) + spread) + 1e-3
        upper = middle + spread
        active = active[(upper >= low[active]) & (middle - spread <= high[active]) & (upper >= score[active, -1])]
        if not len(active):
            continue
        if left:  # the child with the greater products first
            nodes = [tree.nodes[c] for c in (left, right)]
            means = [float((queries[active] @ x[2]).mean()) for x in nodes]
            todo += [((left, active), (right, active))[i] for i in np.argsort(means)]
            continue
        told = (queries[active] @ tree.points[a:b].T).astype(np.int64)
        fit = ((labels[a:b] == of[active][:, None]) == same) & (ids[a:b] != own[active][:, None]) & (told >= low[active][:, None]) & (told <= high[active][:, None]) & (told >= score[active, -1][:, None])
        some = fit.any(axis=1)
        active, told = active[some], np.where(fit[some], told[some], _NONE)
        told, from_ = np.concatenate((score[active], told), axis=1), np.concatenate((best[active], np.where(fit[some], ids[a:b], _LAST)), axis=1)
        first = np.lexsort((from_, ~told), axis=1)[:, :k]  # ~x falls as x rises, without an overflow
        score[active], best[active] = np.take_along_axis(told, first, 1), np.take_along_axis(from_, first, 1)
    return score, best


_FOUND = "anchor long, high long, score long, id long"
_SCHEMA = pa.schema([("anchor", pa.int64()), ("high", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def _searched(same: bool, k: int, scale: int, low: int, high: int):
    def task(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """A part's rows and a block's queries (one width) -> the best of each query in this part."""
        out = [np.zeros((0, 4), np.int64)]
        if len(rows) and len(queries):
            points, asked = (np.floor(next(iter(matrices(t.column("embedding").combine_chunks())))[1] * scale) for t in (rows, queries))
            ids, labels, own, of = (t.column(c).to_numpy() for t in (rows, queries) for c in ("vec_id", "label"))
            top = queries.column("high").to_numpy()
            # low * positive <= high * negative <= high * positive; without a positive, all scores
            bottom, most = (np.full(len(top), _NONE), np.full(len(top), _LAST)) if same else (-((-low * top) // high), top)
            score, best = search(BallTree(points), ids, labels, asked, own, of, same, bottom, most, k)
            q, place = np.nonzero(best != _LAST)
            out.append(np.column_stack((own[q], top[q], score[q, place], best[q, place])))
        found = np.concatenate(out)
        return pa.table([pa.array(found[:, i]) for i in range(4)], schema=_SCHEMA)

    return task


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """For each anchor and each of its positives, the hardest negatives.

    vectors: vec_id, embedding, label; further columns are ignored. Rows with a null vec_id, label or vector, an empty
    vector, or a component that is null or not finite take no part. Components become floor(scale * x), x as double; a
    row whose vector has then a squared length of 2**53 or more takes no part either, as its products might not be
    exact. A row's score for an anchor is the inner product of both; rows of another width have none. Higher scores come
    first, ties by the smaller vec_id. ``anchors``, over vec_id and label, tells which rows are anchors. Positives are an anchor's
    first ``positives`` other rows of its label, and for each of these, the negatives its first ``negatives`` rows of
    other labels with low * positive_score <= high * negative_score <= high * positive_score. Fewer rows than asked for
    give all of them. Of rows that repeat a vec_id the greatest (label, vector) takes part. An empty table gives no rows.

    Returns anchor_id, positive_id, rank (from 1, among those of the anchor and positive), negative_id, positive_score,
    negative_score. All rows are held against all anchors, part by block; nothing is left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    whole = F.aggregate(F.transform("embedding", lambda x: F.pow(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = one_row_an_id(rows.where(is_finite(F.col("embedding"))).where(F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < 2**27)).where(whole < 2**53))
    rows = scratch.keep(rows.select("*", F.size("embedding").alias("width"), F.coalesce(anchors, F.lit(False)).alias("asks")), "rows")
    counted = rows.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    n, asked = counted[0], counted[1] or 0
    parallel = max(spark.sparkContext.defaultParallelism, 1)
    parts = max(1, -(-n // min(MOST_ROWS, max(LEAST_ROWS, -(-n // (2 * parallel))))))
    blocks = max(1, -(-asked // BLOCK))
    dealt = rows.select("width", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), "vec_id", "label", "embedding")
    anchor = rows.where("asks").select("width", "vec_id", "label", "embedding", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("block"))

    def best(queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, high, score, id, rank): queries has the anchors and what bounds their scores, high."""
        queries = scratch.keep(queries, f"queries_{same}")
        sent = queries.select("width", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"), "block", "vec_id", "label", "embedding", "high")
        keys = ("width", "part", "block")
        found = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_searched(same, k, scale, low, high), _FOUND)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "high").orderBy(F.desc("score"), "id")))
        return ranked.where(F.col("rank") <= k)

    positive = scratch.keep(best(anchor.withColumn("high", F.lit(0).cast("long")), True, positives), "positives")
    windows = positive.select(F.col("anchor").alias("vec_id"), F.col("score").alias("high")).distinct()  # equal scores set one window
    negative = scratch.keep(best(anchor.join(windows, "vec_id"), False, negatives), "negatives")
    scratch.drop("rows", "queries_True", "queries_False")
    met = positive.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("high")).join(negative, ["anchor", "high"])
    return met.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))
