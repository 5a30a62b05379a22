"""Verification of answers: entailment, groundedness, citations, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import tokens


def lexical_entailment(premise: Column, claim: Column, stopwords: list[str]) -> Column:
    """How far a premise covers a claim: .2 if a number of two digits or more is not in it; else by the share o of the
    claim's salient words that it has: o below .3, min(1, .6 + .4 o) from there on; 1 for a claim without such words,
    0 for an empty premise."""
    salient = F.filter(F.array_distinct(tokens(claim)), lambda t: (F.char_length(t) > 2) & ~t.isin(stopwords))
    numbers = F.regexp_extract_all(claim, F.lit(r"[0-9][0-9.,]*[0-9]"), F.lit(0))
    missing = F.exists(numbers, lambda n: ~F.contains(premise, n))
    share = F.size(F.array_intersect(salient, tokens(premise))) / F.nullif(F.size(salient), F.lit(0))
    return F.when(F.trim(premise) == "", 0.0).when(missing, 0.2).when(F.size(salient) == 0, 1.0).when(share < 0.3, share).otherwise(F.least(F.lit(1.0), 0.6 + 0.4 * share))


def groundedness(claims: DataFrame, supported_from: float = 0.5) -> DataFrame:
    """(answer_id, claims, supported, score, decision) of claims (answer_id, support): grounded from .9 of them
    supported on, partly from .7, else refused."""
    by = claims.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(F.col("support") >= supported_from).alias("supported"))
    score = F.col("supported") / F.col("claims")
    return by.select("answer_id", "claims", "supported", F.round(score, 6).alias("score"), F.when(score >= 0.9, "grounded").when(score >= 0.7, "partly").otherwise("refused").alias("decision"))


def citation_scores(citations: DataFrame) -> DataFrame:
    """(answer_id, precision, recall) of citations (answer_id, claim, supports; a null: the claim cites nothing): the
    share of citations that support, and of claims that a citation supports."""
    by_claim = citations.groupBy("answer_id", "claim").agg(F.count("supports").alias("n"), F.count_if("supports").alias("good"))
    return by_claim.groupBy("answer_id").agg(F.round(F.coalesce(F.sum("good") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)), 6).alias("precision"), F.round(F.count_if(F.col("good") > 0) / F.count("*"), 6).alias("recall"))


def risk_coverage(records: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n, coverage, risk) of records (confidence, correct): the share answered from a threshold on, and the
    share of these that is wrong. Counts by bin of confidence are summed, so no record is repeated."""
    grid = F.array(*[F.lit(t) for t in thresholds])
    binned = records.groupBy(F.size(F.filter(grid, lambda t: F.col("confidence") >= t)).alias("bin")).agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    every = binned.select(F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))).alias("at"), "bin", "n", "wrong")  # at most (thresholds + 1) * thresholds rows
    by = every.groupBy("at").agg(F.sum(F.when(F.col("bin") >= F.col("at"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("bin") >= F.col("at"), F.col("wrong")).otherwise(0)).alias("wrong"), F.sum("n").alias("all"))
    return by.select(F.get(grid, F.col("at") - 1).alias("threshold"), "n", F.round(F.col("n") / F.col("all"), 6).alias("coverage"), F.round(F.coalesce(F.col("wrong") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 6).alias("risk"))


def certified_threshold(curve: DataFrame, risk: float, delta: float) -> DataFrame:
    """One row: the least threshold of a curve whose risk lies below ``risk`` with confidence 1 - delta by Hoeffding's
    bound; null if none does."""
    bound = F.col("risk") + F.sqrt(F.ln(F.lit(1 / delta)) / (2 * F.nullif(F.col("n"), F.lit(0))))
    return curve.agg(F.min(F.when(bound <= risk, F.col("threshold"))).alias("threshold"))


def validated_citations(cited: DataFrame, sources: DataFrame, url_key) -> DataFrame:
    """(answer_id, number, url) of cited (answer_id, pos, url): those whose URL is known in sources (url), exactly or
    by ``url_key``, the first of each, numbered anew."""
    exact = sources.select("url", F.lit(True).alias("exact")).distinct()
    by_key = sources.select(url_key(F.col("url")).alias("key"), F.lit(True).alias("keyed")).distinct()
    met = cited.withColumn("key", url_key(F.col("url"))).join(exact, "url", "left").join(by_key, "key", "left").where(F.col("exact") | F.col("keyed"))
    first = met.groupBy("answer_id", "key").agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url"))
    return first.select("answer_id", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos")).alias("number"), "url")


def abstention(answerable: Column, abstained: Column) -> Column:
    return F.when(answerable & abstained, "wrong_abstention").when(answerable, "answered").when(abstained, "correct_abstention").otherwise("hallucination_risk")
