"""Analytics and integrity audits over conversations and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import normalized


def rate(holds: Column, digits: int = 4) -> Column:
    """The share of rows for which something holds, rounded; 0 of none."""
    return F.round(F.coalesce(F.count_if(holds) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), digits)


def repeated_unanswered(turns: DataFrame, unanswered: Column, k: int = 10) -> DataFrame:
    """(question, n): the k most frequent questions, normalised, whose answer an assistant did not give; an answer
    belongs to the latest user's turn before it. One pass over each conversation, in place of a correlated query."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = turns.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))
    failed = asked.where((F.col("role") == "assistant") & unanswered & F.col("asked").isNotNull())
    return failed.groupBy(normalized(F.col("asked")).alias("question")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "question").limit(k)


def failed_fanout(turns: DataFrame, failed: Column) -> DataFrame:
    """(conv_id, turn, earlier): for each failed turn, each user's turn before it in the conversation."""
    bad = turns.where((F.col("role") == "assistant") & failed).select("conv_id", "turn")
    asked = turns.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("earlier"))
    return bad.join(asked, "conv_id").where(F.col("earlier") < F.col("turn"))


def orphans(checks: list[tuple[str, DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """(check, n): rows of a table without a partner in another, for each check (name, table, other, keys)."""
    out = None
    for name, table, other, keys in checks:
        row = table.join(other.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def provenance(items: DataFrame, direct: Column, sources: DataFrame, key: str) -> DataFrame:
    """One row: items, and those whose source is given directly or known by key, with the share."""
    known = sources.select(key, F.lit(True).alias("_known")).distinct()
    met = items.withColumn("_direct", direct).join(known, key, "left")
    good = F.col("_direct") | F.coalesce("_known", F.lit(False))
    return met.agg(F.count("*").alias("items"), F.count_if(good).alias("with_source"), rate(good).alias("share"))


def top_counts(frame: DataFrame, column: Column, name: str, k: int) -> DataFrame:
    return frame.groupBy(column.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)
