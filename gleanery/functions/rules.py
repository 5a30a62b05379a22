"""Ordered rule tables as column expressions: the first rule that holds names a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import has_term, tokens


def first_rule(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule (name, condition) that holds."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in rules], F.lit(default))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether one of the terms stands in the lower-cased text. Terms of one word are met by one pass over the words."""
    words, phrases = [t for t in terms if " " not in t], [t for t in terms if " " in t]
    found = F.arrays_overlap(tokens(text), F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    for p in phrases:
        found = found | has_term(text, p)
    return found


def classified(text: Column, table: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first class of an ordered table of terms one of which stands in the text: intents, topics, kinds of answers,
    audiences and kinds of pages are all of this form."""
    return first_rule([(name, any_term(text, terms)) for name, terms in table.items()], default)


def conflicting(history: Column, current: Column, default: str) -> Column:
    """Whether two classes tell of different topics: neither is the default, and they differ."""
    return (history != default) & (current != default) & (history != current)


def reveals_secret(text: Column, malicious: Sequence[str], revealing: Sequence[str], helping: Sequence[str]) -> Column:
    """Whether a request is to be refused: it is malicious, or asks to reveal something without asking for help."""
    return any_term(text, malicious) | (any_term(text, revealing) & ~any_term(text, helping))


def elliptical(text: Column, openings: Sequence[str], most_words: int = 6) -> Column:
    """Whether a question leans on the one before it: it is short and begins like one that does."""
    begins = F.lit(False)
    for o in openings:
        begins = begins | F.lower(F.trim(text)).startswith(o)
    return begins & (F.size(tokens(text)) <= most_words)


def resolved(text: Column, entity: Column, leaning: Column) -> Column:
    """A question that leans on the one before it, with the entity that it is about."""
    return F.when(leaning & entity.isNotNull() & ~F.contains(F.lower(text), F.lower(entity)), F.concat(F.trim(text), F.lit(" "), entity)).otherwise(text)
