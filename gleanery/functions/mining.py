"""Fields that texts tell of people and places: names behind a label, grades, telephone numbers, e-mail and street
addresses, found by patterns, brought into one form and checked. Labels, titles and domains are those of a corpus."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Telephone numbers of a country, once only their digits and a plus are left: the default asks for seven to fifteen.
PHONE = r"^\+?[1-9][0-9]{6,14}$"
_NUMBER = r"(\+?[0-9(][0-9 ().-]{6,18}[0-9])"


def _either(words: Sequence[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True))


def name_pattern(labels: Sequence[str], titles: Sequence[str] = ("Prof.", "Dr.", "Ir."), most: int = 6) -> str:
    """A name of ``most`` words at most behind one of the labels, what belongs to the label, and a colon, dash or ``is``:
    words with one capital, titles before them."""
    return rf"(?i:\b(?:{_either(labels)})\b)[^\n:]{{0,60}}?(?::|\s[-–]|\s(?i:is|adalah)\b)\s*((?:(?:{_either(titles)})\s*)*\p{{Lu}}\p{{Ll}}+(?:[ \t]+\p{{Lu}}\p{{Ll}}+){{0,{most - 1}}})"


def grade_pattern(labels: Sequence[str], grades: Sequence[str]) -> str:
    """One of the grades, as it is written, within forty characters behind one of the labels."""
    return rf"(?i:\b(?:{_either(labels)})\b)[^\n]{{0,40}}?[\s:]({_either(grades)})\b"


def address_pattern(streets: Sequence[str], numbers: Sequence[str] = ("No.", "No")) -> str:
    """A street, which one of the words begins, up to its number and what follows it before a comma."""
    return rf"\b((?:{_either(streets)})\s+\p{{Lu}}[^\n,]{{1,60}}?\s(?:{_either(numbers)})\s*[0-9]+[^,\n]{{0,30}})"


def email_pattern(domains: Sequence[str] = ()) -> str:
    return rf"([A-Za-z0-9._%+-]+@(?:{_either(domains) if domains else r'[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+'}))"


def every(text: Column, pattern: str) -> Column:
    """The distinct values of a pattern's first group in a text, in their order, without white space at their ends."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.coalesce(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), F.array().cast("array<string>")))


def phones(text: Column, valid: str = PHONE) -> Column:
    """Telephone numbers as digits with a plus before them where there is one, those that ``valid`` admits."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)), lambda x: F.regexp_replace(x, r"[^0-9+]", ""))
    return F.array_distinct(F.coalesce(F.filter(plain, lambda x: x.rlike(valid)), F.array().cast("array<string>")))


def mined(frame: DataFrame, text: str, patterns: Mapping[str, str], valid_phone: str | None = None) -> DataFrame:
    """Adds, for each of ``patterns``, an array of what it finds, and ``phones`` where they are asked for; a null text
    has nothing."""
    found = {name: every(F.col(text), p) for name, p in patterns.items()}
    return frame.withColumns(found | ({"phones": phones(F.col(text), valid_phone)} if valid_phone else {}))
