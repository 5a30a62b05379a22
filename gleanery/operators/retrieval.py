"""Retrieval: lexical and dense ranking, fusion, reranking, gating. A batch of queries is one table, and whatever is
ranked is ranked by query, with ties broken by id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scores import clamp, trust_aware, usable
from gleanery.functions.text import dice, normalized, tokens


def ranked(frame: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Adds the rank from 1 within groups."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


#: Queries and vectors of a block: a task holds one block of each, and the products of a few queries at once.
QUERY_BLOCK, VECTOR_BLOCK, ASKED_AT_ONCE = 1024, 16384, 64


def components(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one width, none null, as the rows of a matrix."""
    flat = pc.list_flatten(column)
    return np.asarray(flat, np.float64).reshape(len(column), len(flat) // max(1, len(column)))


def knn(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest vectors by cosine, exactly; a vector is no neighbour of
    itself; a vector of no length is like none (0). Vectors that are null, empty, or have components that are null or
    not finite are no neighbours and have none. Others are to be of one width: ValueError tells which there are.

    queries (query_id, embedding) is a batch of stated queries. Both sides are dealt into blocks by a hash, and each
    block of queries meets each block of vectors in a task, as a product of matrices that keeps k rows a query: memory
    is that of two blocks, and what is shuffled afterwards is k rows for each query and block of vectors.
    """
    queries, vectors = (f.where(usable(F.col("embedding"))) for f in (queries, vectors))
    told = [f.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first() for f in (queries, vectors)]
    widths = sorted({w for _, *of in told for w in of if w is not None})
    if len(widths) > 1:
        raise ValueError(f"vectors of different dimensions: {widths}")
    n_queries, n_vectors = (max(1, -(-r[0] // size)) for r, size in zip(told, (QUERY_BLOCK, VECTOR_BLOCK), strict=True))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # named anew, as both sides may come from one table
    left = queries.select("query_id", F.col("embedding").alias("wanted"), dealt("query_id", n_queries).alias("q"), every(n_vectors).alias("v"))
    right = vectors.select("vec_id", F.col("embedding").alias("known"), dealt("vec_id", n_vectors).alias("v"), every(n_queries).alias("q"))

    def unit(column) -> np.ndarray:
        rows = components(column)
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)

    def met(asked: pa.Table, known: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asked) and len(known):
            query, vector = asked.column("query_id").to_numpy(), known.column("vec_id").to_numpy()
            by = np.argsort(vector, kind="stable")
            wanted, held, vector = unit(asked.column("wanted")), unit(known.column("known"))[by].T, vector[by]
            for i in range(0, len(query), ASKED_AT_ONCE):
                own = query[i : i + ASKED_AT_ONCE]
                near = np.round(wanted[i : i + ASKED_AT_ONCE] @ held, digits)
                near[own[:, None] == vector] = -np.inf
                best = np.argsort(-near, axis=1, kind="stable")[:, :k]  # of equals, the smallest id
                row, column = np.repeat(np.arange(len(own)), best.shape[1]), best.ravel()
                similar = near[row, column]
                kept = similar > -np.inf
                found.append((own[row][kept], vector[column][kept], similar[kept]))
        return pa.table(dict(zip(("query_id", "vec_id", "similarity"), (pa.array(np.concatenate(c)) for c in zip(*found, strict=True)), strict=True)))

    best = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(met, "query_id long, vec_id long, similarity double")
    return ranked(best, ["query_id"], F.desc("similarity"), F.col("vec_id")).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, id, fused): the sum of 1 / (k + rank) over lists (query_id, id, rank)."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    return every.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"))


def min_max(frame: DataFrame, by: str, column: str, name: str) -> DataFrame:
    """Scales a column to 0 ... 1 within groups; all are 1 where they are equal."""
    low, high = F.min(column).over(Window.partitionBy(by)), F.max(column).over(Window.partitionBy(by))
    return frame.withColumn(name, F.when(high == low, 1.0).otherwise((F.col(column) - low) / F.nullif(high - low, F.lit(0.0))))


def fuse_and_rank(lists: list[DataFrame], facts: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): fused ranks, scaled, with topic priority (in 50ths, -0.5 to 1.75), authority and
    freshness of the ids from facts (id, authority, freshness, topic)."""
    scaled = min_max(reciprocal_rank_fusion(lists), "query_id", "fused", "relevance").join(facts, "id")
    score = trust_aware(F.col("relevance") + clamp(F.col("topic") / 50, -0.5, 1.75), F.col("authority"), F.col("freshness"))
    return ranked(scaled.withColumn("score", F.round(score, 6)), ["query_id"], F.desc("score"), F.col("id")).where(F.col("rank") <= k)


def model_rerank(candidates: DataFrame, model_scores: DataFrame, top: int, weight: float = 0.8) -> DataFrame:
    """Reranks the first ``top`` of each query by ``weight`` * model + rest * scaled retrieval score; the others keep
    their order behind them, as does a query without model scores."""
    head = F.col("rank") <= top
    scored = min_max(candidates, "query_id", "score", "base").join(model_scores, ["query_id", "id"], "left")
    scored = scored.withColumn("final", F.when(head & F.col("model").isNotNull(), weight * F.col("model") + (1 - weight) * F.col("base")).when(head, F.col("base")))
    return ranked(scored, ["query_id"], F.col("final").isNull(), F.desc(F.round("final", 9)), F.col("rank"), name="new_rank")


def heuristic_boost(source_type: Column, confidence: Column) -> Column:
    """What the kind of source and the confidence of its extraction add to a score."""
    sure = F.coalesce(confidence, F.lit(0.5))
    return F.when(source_type.isin("html", "pdf"), 0.15).when(source_type.isin("image", "audio", "video"), -0.1).otherwise(0.0) + 0.2 * sure - F.when(sure < 0.5, 0.25).otherwise(0.0)


def reranked(contexts: DataFrame, model_scores: DataFrame | None = None, top: int = 20, weight: float = 0.8) -> DataFrame:
    """(query_id, id, relevance, score, reranked, rank) of contexts (query_id, id, score, source_type, confidence,
    authority, freshness): first by score, what the source adds, authority and freshness. Where a query has scores of a
    model (query_id, id, model) for all of its first ``top``, these are ranked anew by weight * model + rest * score
    scaled among them, with what the source adds, authority and freshness, and stand before the others."""
    boost = heuristic_boost(F.col("source_type"), F.col("confidence")) - F.when(F.col("confidence").isNull(), 0.1).otherwise(0.0)
    trust = lambda relevance: F.round(trust_aware(relevance, F.col("authority"), F.coalesce("freshness", F.lit(1.0))), 6)
    plain = contexts.withColumn("boost", boost).withColumn("relevance", F.col("score") + F.col("boost"))
    first = ranked(plain.withColumn("final", trust(F.col("relevance"))), ["query_id"], F.desc("final"), F.col("id"))
    if model_scores is None:
        return first.select("query_id", "id", F.round("relevance", 6).alias("relevance"), F.col("final").alias("score"), F.lit(False).alias("reranked"), "rank")
    head = first.where(F.col("rank") <= top).join(model_scores, ["query_id", "id"], "left")
    whole = head.groupBy("query_id").agg((F.count("model") == F.count("*")).alias("told"))
    head = min_max(head, "query_id", "score", "scaled").withColumn("again", weight * F.col("model") + (1 - weight) * F.col("scaled") + F.col("boost"))
    every = first.join(head.select("query_id", "id", "again"), ["query_id", "id"], "left").join(whole, "query_id")
    anew = F.col("told") & F.col("again").isNotNull()
    every = every.withColumn("reranked", anew).withColumn("relevance", F.when(anew, F.col("again")).otherwise(F.col("relevance"))).withColumn("final", F.when(anew, trust(F.col("again"))).otherwise(F.col("final")))
    out = ranked(every.drop("rank"), ["query_id"], F.desc("reranked"), F.desc("final"), F.col("id"))
    return out.select("query_id", "id", F.round("relevance", 6).alias("relevance"), F.col("final").alias("score"), "reranked", "rank")


def faq_match(queries: DataFrame, faqs: DataFrame, threshold: float = 0.62, k: int = 2) -> DataFrame:
    """(query_id, faq_id, dice, score, rank): the k best of the FAQs (faq_id, question) that equal a query (query_id,
    text) when normalised (14) or reach a Dice coefficient of their words (12). Candidates share a word."""
    words = lambda f, i: f.select(i, F.array_distinct(tokens(F.col("text"))).alias(f"{i}_w"), normalized(F.col("text")).alias(f"{i}_n"))
    q, f = words(queries, "query_id"), words(faqs.withColumnRenamed("question", "text"), "faq_id")
    # two sets of a and b words with this coefficient share more than a / 2 * threshold / (2 - threshold) of the words:
    # it is enough to look a query up by a prefix of its sorted words
    need = F.ceil(F.size("query_id_w") * threshold / (2 - threshold))
    keys = q.withColumn("term", F.explode(F.slice(F.array_sort("query_id_w"), 1, (F.size("query_id_w") - need + 1).cast("int"))))
    pairs = keys.select("query_id", "term").join(f.select("faq_id", F.explode("faq_id_w").alias("term")), "term").select("query_id", "faq_id").distinct()
    met = pairs.join(q, "query_id").join(f, "faq_id").withColumn("dice", F.when(F.col("query_id_n") == F.col("faq_id_n"), 1.0).otherwise(dice(F.col("query_id_w"), F.col("faq_id_w"))))
    good = met.where(F.col("dice") >= threshold).withColumn("score", F.when(F.col("query_id_n") == F.col("faq_id_n"), 14.0).otherwise(12.0))
    return ranked(good.select("query_id", "faq_id", F.round("dice", 6).alias("dice"), "score"), ["query_id"], F.desc("dice"), F.col("faq_id")).where(F.col("rank") <= k)


def answerability(positive: Column, overlap: Column, on_host: Column, negative: Column) -> Column:
    """How well a text can answer: its answer terms, its share of the query's words, its host, terms that speak against."""
    return clamp(0.45 * F.least(positive / 3, F.lit(1.0)) + 0.35 * overlap + 0.2 * on_host - 0.15 * F.least(negative, F.lit(3)))


def pinned_merge(layers: list[tuple[DataFrame, bool]], k: int) -> DataFrame:
    """Layers (query_id, id, score), pinned or not, in the order of their precedence: an id counts in the first layer
    that has it; pinned rows come first, each kind by score, and k rows a query are kept."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "id", "score").withColumns({"layer": F.lit(i), "pinned": F.lit(p)}) for i, (x, p) in enumerate(layers)])
    first = every.groupBy("query_id", "id").agg(F.min_by(F.struct("score", "layer", "pinned"), "layer").alias("s")).select("query_id", "id", "s.*")
    return ranked(first, ["query_id"], F.desc("pinned"), F.desc("score"), F.col("layer"), F.col("id")).where(F.col("rank") <= k)


def confidence_ladder(top_score: Column, official: Column, n: Column) -> Column:
    """How far the best contexts of a query can be relied on."""
    return F.when((top_score >= 12) & (official >= 1), 0.95).when(top_score >= 10, 0.85).when((official >= 2) & (n >= 3), 0.7).when(official >= 1, 0.55).when(n >= 1, 0.4).otherwise(0.2)


def sufficiency(contexts: DataFrame, structured: Sequence[str]) -> DataFrame:
    """(query_id, confidence, sufficient) of ranked contexts (query_id, rank, score, source_type, demoted, authority):
    how far they can be relied on, and whether nothing else needs to be looked for. A structured first row that is not
    demoted is enough, .95 from 12 points on and .85 below; so are two of official hosts, the first among them, .7; an
    official first row alone .55; any .4; others .2."""
    official = F.col("authority") >= 0.5
    by = contexts.groupBy("query_id").agg(F.min_by(F.struct("score", F.col("source_type").isin(*structured).alias("kind"), F.coalesce("demoted", F.lit(False)).alias("demoted"), official.alias("official")), "rank").alias("top"), F.count_if(official).alias("official"))
    top = F.col("top")
    sure = F.coalesce(top["kind"], F.lit(False)) & ~top["demoted"]
    told = F.when(sure & (top["score"] >= 12), 0.95).when(sure, 0.85).when(top["official"] & (F.col("official") >= 2), 0.7).when(top["official"], 0.55).when(F.col("official") >= 1, 0.4).otherwise(0.2)
    return by.select("query_id", told.alias("confidence"), (told >= 0.7).alias("sufficient"))
