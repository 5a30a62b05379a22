"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.scratch import Scratch


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them: the larger ones, or the node and the smaller ones."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    if not larger:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    hung = both.join(low, "a")
    hung = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")) if larger else hung.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return hung.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b): component is the smallest node that links lead to.

    Large-star and small-star steps in turn, each written to the shared folder, until every node hangs on the smallest
    of its component. The number of rounds grows with the logarithm of the longest path. No step gathers a component.
    """
    scratch = Scratch(links.sparkSession, "components")
    links = scratch.keep(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "r0")
    seen, turn = None, 0
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen, turn = state, turn + 1
        links = scratch.keep(_star(_star(links, True), False), f"r{turn}")
        scratch.drop(f"r{turn - 1}")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
