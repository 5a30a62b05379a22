"""Functions that no built-in expresses, in Arrow batches: similarity of strings by matching blocks, slugs, noise."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def slugs(texts: pd.Series) -> pd.Series:
    plain = texts.map(lambda t: unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower())
    return plain.map(lambda t: re.sub("[^a-z0-9]+", "-", t).strip("-"))


def slug(text: Column) -> Column:
    """ASCII letters and digits of the decomposed text in lower case, other runs as a hyphen."""
    return F.pandas_udf(slugs, "string")(text)


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over all characters: 1 for equal strings."""
    return F.pandas_udf(ratios, "double")(a, b)


def corrected(words: Column, vocabulary: list[str], known: dict[str, str], least: float = 0.72) -> Column:
    """Each word of an array as its known form, as it is if it is in the vocabulary, else as the most similar word of
    the vocabulary of about its length, if that is similar enough (the first in the order given among equals)."""
    order = list(vocabulary)

    def one(word: str) -> str:
        if word in known or word in order:
            return known.get(word, word)
        near = [(SequenceMatcher(None, word, v).ratio(), -i) for i, v in enumerate(order) if abs(len(v) - len(word)) <= 2]
        best = max(near, default=(0.0, 0))
        return order[-best[1]] if best[0] >= least else word

    return F.pandas_udf(lambda s: s.map(lambda ws: None if ws is None else [one(w) for w in ws]), "array<string>")(words)


def with_typos(text: Column, key: Column, rate: float, seed: str) -> Column:
    """Swaps neighbouring letters of about ``rate`` of the words, chosen by a hash of the seed, the key and the place."""

    def noisy(texts: pd.Series, keys: pd.Series) -> pd.Series:
        def change(text, key):
            words = (text or "").split(" ")
            for i, w in enumerate(words):
                h = int.from_bytes(hashlib.sha256(f"{seed}|{key}|{i}".encode()).digest()[:8], "big")
                if len(w) > 3 and h % 10_000 < rate * 10_000:
                    at = 1 + (h >> 20) % (len(w) - 2)
                    words[i] = w[:at] + w[at + 1] + w[at] + w[at + 2 :]
            return " ".join(words)

        return pd.Series([change(t, k) for t, k in zip(texts, keys, strict=True)])

    return F.pandas_udf(noisy, "string")(text, key)


def slanged(words: Column, slang: dict[str, str]) -> Column:
    """Words of an array as slang has them."""
    table = F.create_map(*[F.lit(x) for kv in slang.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(table[w], w))


def truncated(words: Column, share: float) -> Column:
    """The first ``share`` of the words, one at least."""
    return F.slice(words, 1, F.greatest(F.ceil(F.size(words) * share).cast("int"), F.lit(1)))


def stripped_of(words: Column, entities: list[str]) -> Column:
    """The words that name no entity; all of them where no other is left."""
    left = F.filter(words, lambda w: ~w.isin(entities))
    return F.when(F.size(left) > 0, left).otherwise(words)
