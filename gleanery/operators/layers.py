"""Layers of evidence in one plan: gates, demotion, hosts, pinning, and a last layer for questions that have too little."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.retrieval import ranked, sufficiency
from gleanery.operators.search import demoted, host_adjusted
from gleanery.operators.steps import written


@dataclass(frozen=True)
class Layer:
    """Rows (query_id, id, score, label, authority, fits) of one kind: ``label`` is their host's, ``fits`` whether they
    suit the question's intent (null: they do). The layer is asked for questions of ``intents``, of all if there are
    none, and gives ``most`` rows a question: the best, and of equal ones of an id one that fits first. Pinned rows stand
    before others; rows of a structured layer that do not fit score 2 at most and are not pinned."""

    name: str
    rows: DataFrame
    pinned: bool = False
    structured: bool = False
    intents: Sequence[str] = ()
    most: int | None = None


def _of(layer: Layer, place: int, questions: DataFrame) -> DataFrame:
    asked = questions.where(F.col("intent").isin(list(layer.intents))) if layer.intents else questions
    rows = layer.rows.select("query_id", "id", F.col("score").cast("double").alias("score"), "label", F.col("authority").cast("double").alias("authority"), F.coalesce("fits", F.lit(True)).alias("fits")).join(asked.select("query_id", "intent"), "query_id")
    if layer.structured:
        rows = rows.withColumn("score", demoted(F.col("score"), F.col("fits")))
    down = F.lit(layer.structured) & ~F.col("fits")
    rows = rows.withColumns({"demoted": down, "pinned": F.lit(layer.pinned) & ~down, "layer": F.lit(place), "source_type": F.lit(layer.name)})
    if layer.most is not None:
        rows = ranked(rows, ["query_id"], F.desc("score"), F.col("id"), F.desc("fits"), F.col("label"), F.col("authority"), name="place").where(F.col("place") <= layer.most).drop("place")
    return rows.drop("fits")


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """Each id in the first layer that has it, its best row there (of equals, one that is not demoted); pinned ones
    first, then by score."""
    rest = [c for c in rows.columns if c not in ("query_id", "id", "rank")]
    first = rows.groupBy("query_id", "id").agg(F.min_by(F.struct(*rest), F.struct("layer", -F.col("score"), "demoted", "label", "authority")).alias("r")).select("query_id", "id", "r.*")
    return ranked(first, ["query_id"], F.desc("pinned"), F.desc("score"), F.col("layer"), F.col("id")).where(F.col("rank") <= k)


def orchestrated(questions: DataFrame, layers: Sequence[Layer], hosts: DataFrame, k: int, last: Layer | None = None) -> DataFrame:
    """(query_id, id, source_type, score, pinned, confidence, sufficient, rank): the k best rows of all layers for each
    question (query_id, intent), in the order of the layers' precedence.

    Rows that are not pinned gain 3 on hosts of the intent and lose 6 on those it rules out (hosts: intent, label,
    allowed). How far the rows of a question can be relied on is told by ``sufficiency``; a question for which they are
    not enough, or that has none, gets the rows of ``last`` as well, below what is pinned. A question without any row
    gives none.
    """
    every = reduce(DataFrame.unionByName, [_of(x, i, questions) for i, x in enumerate(layers)])

    def adjusted(rows: DataFrame) -> DataFrame:
        moved = host_adjusted(rows.withColumn("own", F.col("score")), hosts)
        return moved.withColumn("score", F.round(F.when(F.col("pinned"), F.col("own")).otherwise(F.col("score")), 6)).drop("own", "intent")

    structured = [x.name for x in layers if x.structured]
    rows = written(adjusted(every), "layers")
    told = sufficiency(_merged(rows, k), structured)
    if last is not None:
        poor = questions.join(told.where("sufficient"), "query_id", "left_anti")
        rows = rows.unionByName(adjusted(_of(last, len(layers), poor)))
        told = sufficiency(_merged(rows, k), structured)
    return _merged(rows, k).join(told, "query_id").select("query_id", "id", "source_type", "score", "pinned", "confidence", "sufficient", "rank")
