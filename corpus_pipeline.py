"""A training corpus from documents, in five stages; each works on all that the one before it kept.

An empty table goes through as an empty one. Columns that a stage works with keep their own values where the table has
columns of the same names. Tables between the stages stay in the shared folder until the caller has written the result:
``with gleanery.llm.scratch.freed(spark): run(spark, sf_dir).write...`` frees them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, mixing, near_duplicates, toxicity
from gleanery.llm.names import free, set_aside
from gleanery.llm.queries import pack_documents
from gleanery.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score of toxicity is below the threshold. Null and empty texts, which tell nothing, stay; rows
    that repeat are judged each, alike."""
    score = free(docs.columns, "score")
    return toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id. Null and empty texts are groups of their own;
    rows of null ids stay; of rows that repeat a doc_id the one of the greatest text, which was judged, may stay."""
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in passages of the benchmark. Null and empty texts
    are clean; without a benchmark all are."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as before, drawn to flatter weights of the sources, in mixed order. A null source is a source; null
    and empty texts go with the documents at their places; rows that repeat go together."""
    rows, restored = set_aside(docs, *mixing.COLUMNS)
    return restored(mixing.in_mixed_order(mixing.mixture(rows)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed matrices of token ids. Null and empty texts have none; repeated rows are packed each."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The models of the first stage are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for the table documents; each stage is written and read again by the next."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
