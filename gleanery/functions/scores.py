"""Scores of freshness, trust and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 where a norm is 0. Arrays of different sizes are an error."""
    checked = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of different dimensions")))
    return F.coalesce(checked / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of which is null or not finite."""
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is above all numbers
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def age_seconds(then: Column, as_of: str) -> Column:
    return F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))


def age_days(then: Column, as_of: str) -> Column:
    """Whole periods of 24 hours."""
    return F.floor(age_seconds(then, as_of) / 86400)


def volatility(words: Column, volatile: list[str], stable: list[str]) -> Column:
    """How soon an answer to a question of these words goes out of date: both kinds of words .6, volatile ones .9,
    stable ones .1, neither .5."""
    has = lambda terms: F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms]))
    return F.when(has(volatile) & has(stable), 0.6).when(has(volatile), 0.9).when(has(stable), 0.1).otherwise(0.5)


def half_life_days(vol: Column) -> Column:
    return 1 + 179 * (1 - clamp(vol))


def freshness(age: Column, half_life: Column) -> Column:
    """0.5 ** (age / half-life); 1 for an unknown or no age, 0 for no half-life."""
    return F.when(age.isNull() | (age <= 0), 1.0).when(half_life <= 0, 0.0).otherwise(F.pow(F.lit(0.5), age / half_life))


def age_tier(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= 30, "fresh").when(days <= 180, "aging").otherwise("stale")


def age_label(days: Column) -> Column:
    """An age in words."""
    return F.when(days.isNull(), "of unknown age").when(days <= 0, "today").when(days == 1, "1 day old").when(days <= 60, F.concat(days.cast("string"), F.lit(" days old"))).otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months old")))


def stale_warning(tier: Column) -> Column:
    """What is to be said of a stale source; null for others."""
    return F.when(tier == "stale", "may be out of date")


def softmax_pair(a: Column, b: Column) -> Column:
    """The probability of the first of two scores."""
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def tier_multiplier(tier: Column) -> Column:
    return F.when(tier == "aging", 0.97).when(tier == "stale", 0.85).otherwise(1.0)


def trust_aware(relevance: Column, authority: Column, fresh: Column, alpha: float = 1.0, beta: float = 0.5) -> Column:
    """Relevance and what a trusted host and a fresh text add to it."""
    return relevance + alpha * F.coalesce(authority, F.lit(0.0)) + beta * F.coalesce(fresh, F.lit(1.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def weighted_mean(weights: dict[str, float]) -> Column:
    """Weighted mean of the columns that are not null."""
    total = sum((F.coalesce(w * F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return total / F.nullif(sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0)), F.lit(0.0))
