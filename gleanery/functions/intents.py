"""Ordered rules that classify texts: intents, topics, answer types, audiences, kinds and priorities of pages.

A rule is declared by the terms it asks for and those it must not meet, by parts of a URL, and by the length of a text;
the first that holds decides. Words of a text are taken once for all rules; terms of several words stand in its words
in a row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import tokens


@dataclass(frozen=True)
class Rule:
    """``any_of``: terms one of which stands in the text; ``none_of``: terms none of which does; ``equal``: texts it is,
    white space and case apart; ``url``: parts one of which its URL holds, ``no_url``: none of which; ``most_words``:
    so many words at most. What is empty asks for nothing. A rule that holds names the text and gives a confidence and
    a priority."""

    name: str
    any_of: Sequence[str] = ()
    none_of: Sequence[str] = ()
    equal: Sequence[str] = ()
    url: Sequence[str] = ()
    no_url: Sequence[str] = ()
    most_words: int | None = None
    confidence: float = 1.0
    priority: int = 0


def _spaced(terms: Sequence[str]) -> list[str]:
    """Terms as their words with a space on both sides."""
    return [f" {' '.join(re.findall(r'\w+', t.lower()))} " for t in terms]


def _one_of(values: Sequence[str], holds) -> Column:
    return F.exists(F.array(*[F.lit(v) for v in values]), holds)


def condition(rule: Rule, spaced: Column, n: Column, url: Column | None) -> Column:
    """Whether a rule holds for words with a space on both sides and between them, n of them."""
    has = lambda terms: _one_of(_spaced(terms), lambda t: F.contains(spaced, t))
    at = lambda parts: _one_of([p.lower() for p in parts], lambda p: F.contains(F.lower(url), p))
    asked = [has(rule.any_of)] if rule.any_of else []
    asked += [~has(rule.none_of)] if rule.none_of else []
    asked += [spaced.isin(_spaced(rule.equal))] if rule.equal else []
    asked += [F.coalesce(at(rule.url), F.lit(False))] if rule.url else []
    asked += [~F.coalesce(at(rule.no_url), F.lit(False))] if rule.no_url else []
    asked += [n <= rule.most_words] if rule.most_words is not None else []
    out = F.lit(True)
    for a in asked:
        out = out & a
    return out


def classified(frame: DataFrame, text: str, rules: Sequence[Rule], default: Rule, url: str | None = None, prefix: str = "") -> DataFrame:
    """Adds <prefix>name, <prefix>confidence and <prefix>priority: those of the first rule that holds for the text, and
    of ``default`` where none does. A null text has no words."""
    words, spaced = f"{prefix}words", f"{prefix}spaced"
    took = frame.withColumn(words, F.coalesce(tokens(F.col(text), "word"), F.array().cast("array<string>")))
    took = took.withColumn(spaced, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    holds = [condition(r, F.col(spaced), F.size(words), F.col(url) if url else None) for r in rules]
    told = lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(float(r.confidence)).alias("confidence"), F.lit(r.priority).alias("priority"))
    out = took.withColumn(spaced, F.coalesce(*[F.when(h, told(r)) for h, r in zip(holds, rules, strict=True)], told(default)))
    return out.select(*[c for c in frame.columns if c not in (f"{prefix}name", f"{prefix}confidence", f"{prefix}priority")], *[F.col(spaced)[c].alias(f"{prefix}{c}") for c in ("name", "confidence", "priority")])
