"""Ranked evidence: for each query, the documents that say most about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import content_tokens, tokens


#: Pairs of a query and a document that a task sums, at most about.
PAIRS = 1 << 20


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf): an inverted index of the words of documents."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def top_evidence(queries: DataFrame, docs: DataFrame, k: int = 5, stopwords: Sequence[str] = (), tf_cap: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents with the largest sum of capped term frequencies over the
    query's words that are no stopwords (all its words where nothing else is left); ties by doc_id.

    Words of the queries alone are kept from the documents, before anything is shuffled, as long as there are few
    enough of them to be broadcast; the choice is the optimizer's. What is left is shuffled once, by document: its
    words are counted, met with the queries and summed where they are, in as many parts as leave a task PAIRS pairs of a
    query and a document, however many there are. No word is left out for being frequent.
    """
    wanted = queries.select("query_id", F.explode(content_tokens(F.col("text"), stopwords)).alias("term"))
    found = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    parts = max(1, -(-docs.count() * queries.count() // PAIRS))
    counted = found.repartition(parts, "doc_id").groupBy("doc_id", "term").agg(F.least(F.count("*"), F.lit(tf_cap)).alias("tf"))
    scored = counted.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum("tf").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
