"""Evaluation: ranking metrics, percentiles, samples, generated test sets, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Hit rates at 1, 3 and 10 and the mean reciprocal rank of ranks (rank of the target; null: not found)."""
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), at(1).alias("hit_1"), at(3).alias("hit_3"), at(10).alias("hit_10"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def percentile_by_rank(frame: DataFrame, by: list[str], value: str, p: float, rule: str = "ceil") -> DataFrame:
    """The value at a place in the order, counted from 0: ceil(p n) - 1, floor(p n) - 1 or min(n - 1, floor(p n)),
    never before the first. Values are counted first, so that a group of any size is ordered by its distinct values."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    running = counts.withColumn("to", F.sum("c").over(Window.partitionBy(*by).orderBy(value)))
    pn = F.round(F.lit(p) * F.col("n"), 9)
    place = F.greatest(F.lit(0), {"ceil": F.ceil(pn) - 1, "floor": F.floor(pn) - 1, "index": F.least(F.col("n") - 1, F.floor(pn))}[rule])
    return running.join(totals, by).where(F.col("to") > place).groupBy(*by).agg(F.min(value).alias(f"{rule}_{value}"))


def evenly_spaced(frame: DataFrame, stratum: str, key: str, k: int) -> DataFrame:
    """k rows of each stratum, at the places floor(i n / k) of its order by key; all of a smaller one."""
    w = Window.partitionBy(stratum)
    placed = frame.withColumn("_i", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count("*").over(w))
    slot = F.ceil(F.col("_i") * k / F.col("_n"))
    return placed.where((F.col("_n") <= k) | ((slot < k) & (F.floor(slot * F.col("_n") / k) == F.col("_i")))).drop("_i", "_n")


def round_robin(frame: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows, one of each stratum in turn, in the order of a seeded hash within it."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    turn = frame.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n)
    return turn.orderBy("turn", stratum).limit(n)


def expanded_templates(templates: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, category, question): templates (category, template with {}) filled with the entities (category, name) of
    their category, numbered within it."""
    filled = templates.join(entities, "category").select("category", F.replace("template", F.lit("{}"), F.col("name")).alias("question"))
    numbered = filled.distinct().withColumn("i", F.row_number().over(Window.partitionBy("category").orderBy("question")))
    return numbered.select(F.format_string("%s_%04d", "category", "i").alias("id"), "category", "question")


def compared(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta, status) of two runs, keys of either."""
    met = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("after") > F.col("before"), "up").when(F.col("after") < F.col("before"), "down").otherwise("same")
    return met.select(key, "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("delta"), status.alias("status"))


def confusion(records: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, tn, fn, recall and false-positive rate of records (expected, predicted)."""
    n = lambda e, p: F.count_if((F.col("expected") == e) & (F.col("predicted") == p))
    c = records.groupBy(*by).agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(False, False).alias("tn"), n(True, False).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return c.withColumn("recall", ratio("tp", "fn")).withColumn("false_positive_rate", ratio("fp", "tn"))


def running_mean(frame: DataFrame, by: list[str], order: list[str], value: str) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def cyclic_next(column: str, by: list[str], order: str) -> Column:
    """The next row's value, the first one's after the last."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.coalesce(F.lead(column).over(w), F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def alerts(metrics: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """(rule, severity) of the rules that hold for the one row of metrics."""
    found = F.array(*[F.when(holds, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, holds, severity in rules])
    return metrics.select(F.explode(F.filter(found, F.isnotnull)).alias("a")).select("a.*")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, t in tables.items()])
