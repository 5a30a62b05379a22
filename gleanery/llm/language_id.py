"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text. Document frequencies are counted over all
training rows. The weights are learned by follow-the-regularised-leader with an elastic-net penalty, which leaves most
of them zero, on a bounded sample of the training rows, and a temperature is fitted on a part of it that the weights
have not seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.names import free
from gleanery.llm.scratch import Scratch
from gleanery.llm.text_units import constants, mix

#: Size of the feature table: a model has so many rows at most, whatever the corpus.
BUCKETS = 1 << 16
ORDERS = 3
#: Training rows a language that the weights are fitted on (drawn by a hash of doc_id), and characters of one step.
SAMPLE_ROWS = 1500
#: Languages that a model may hold; training fails beyond it.
MOST_LANGUAGES = 512
UNDETERMINED = "und"

_FACTOR = constants(ORDERS, 31)
#: Characters that are counted at once; longer texts are counted part by part, overlapping by ORDERS - 1.
_PART = 1 << 20


def features(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of the whole text, part by part."""
    text = text.lower()
    for at in range(0, len(text), _PART):
        begin = max(0, at - ORDERS + 1)
        codes = np.frombuffer(text[begin : at + _PART].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in range(1, ORDERS + 1):
            skip = max(0, at - begin - n + 1)  # n-grams that end in this part
            grams = len(codes) - n + 1 - skip
            if grams > 0:
                total = np.zeros(grams, np.uint64)
                for j in range(n):
                    total += codes[skip + j : skip + j + grams] * _FACTOR[j]
                yield (mix(total + np.uint64(n)) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and each one's share of its n-grams."""
    parts = list(features(text))
    total = np.bincount(np.concatenate(parts), minlength=BUCKETS) if parts else np.zeros(BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at] / max(1.0, total.sum())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (bucket, df): in how many texts of this task each bucket occurs."""
    df, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            present = np.zeros(BUCKETS, bool)
            for part in features(text or ""):
                present[part] = True
            df[:-1] += present
            n += 1
    df[-1] = n  # the last row is the number of texts
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "df": pa.array(df[at])})


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, passes: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (bucket, class) of softmax regression by FTRL-proximal steps, one row at a time."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(passes):
        for at, x, label in rows:
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(BUCKETS))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest."""
    if not len(labels):
        return 1.0

    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    return float(min(np.geomspace(0.001, 20, 161), key=loss))


@dataclass
class LanguageModel:
    """languages in order; table: idf times weight by (bucket, language); divisor: the temperature."""

    languages: list[str]
    table: np.ndarray
    divisor: float


def is_held_out(doc_id: Column, of: int, rest: int) -> Column:
    """Whether crc32 of the id as text has the remainder ``rest``; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == rest, F.lit(True))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, passes: int = 2) -> LanguageModel:
    """A model from docs (doc_id, text, lang); rows whose text or lang is null teach nothing.

    Document frequencies come from all rows. The fit takes about ``rows`` rows of each language: those whose hash of
    doc_id lies below rows / count of the language; it runs in one task, on that bounded sample alone. Rows that repeat
    teach each; an empty table gives a model without languages.
    """
    docs = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    scratch = Scratch(docs.sparkSession, "language-id")
    found = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(found)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), 1.0)
    seen = docs.select("text").mapInArrow(_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS + 1)
    df[[r["bucket"] for r in seen]] = [r["df"] for r in seen]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows / found[k]))])
    sample = docs.where(part < share[F.col("lang")])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, lang) -> (by, bucket, x, label): features of each text, and what orders the rows."""
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                at, x = counted(text)
                x = x * idf[at]
                x = x / (np.sqrt((x * x).sum()) or 1.0)
                by = hashlib.sha256(f"{text}\n{lang}".encode("utf-8", "surrogatepass")).digest()
                yield pa.RecordBatch.from_pydict({"by": [by], "bucket": pa.array([at.astype(np.int32)]), "x": pa.array([x]), "label": pa.array([languages.index(lang)], pa.int32())})

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # steps are taken in an order of the texts, not of the files that hold them
        own = pd.concat(list(frames), ignore_index=True).sort_values("by", kind="stable")
        made = list(zip(own["bucket"], own["x"], own["label"], strict=True))
        test, learn = made[::5], [m for i, m in enumerate(made) if i % 5]
        w = ftrl(learn or made, len(languages), passes, alpha=0.5, beta=1.0, l1=0.05, l2=0.05)
        scores = np.array([x @ w[at] for at, x, _ in test]).reshape(len(test), len(languages))
        t = temperature(scores, np.array([y for _, _, y in test], int))
        at = np.flatnonzero(w.any(axis=1))
        yield pd.DataFrame({"bucket": np.append(at, -1), "w": [*(w[i] for i in at), np.array([t])]})

    # the texts' features are computed where the texts are; those of the bounded sample then meet in one task
    features_of = scratch.keep(sample.select("text", "lang").mapInArrow(weighed, "by binary, bucket array<int>, x array<double>, label int"), "sample")
    got = features_of.coalesce(1).mapInPandas(fit, "bucket long, w array<double>").collect()  # at most BUCKETS + 1 rows
    table, divisor = np.zeros((BUCKETS, len(languages))), 1.0
    for r in got:
        if r["bucket"] < 0:
            divisor = r["w"][0]
        else:
            table[r["bucket"]] = np.array(r["w"]) * idf[r["bucket"]]
    # the norm of a text needs its idf as well: the last column
    scratch.drop("sample")
    return LanguageModel(languages, np.column_stack([table, idf]), divisor)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred and score (the calibrated probability of lang_pred) to every row of docs.

    Only ``text`` is read, whole. Null texts, texts without a letter and all texts under a model without languages get
    ``und`` and score 0. Ties go to the language that sorts first. Clashing columns lang_pred and score are replaced.
    Rows that repeat get the same guess each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.divisor))  # BUCKETS rows

    def guess(texts: pd.Series) -> pd.DataFrame:
        languages, table, divisor = shared.value
        out = []
        for text in texts:
            if not languages or not isinstance(text, str) or not any(map(str.isalpha, text)):
                out.append((UNDETERMINED, 0.0))
                continue
            at, x = counted(text)
            norm = np.sqrt(((x * table[at, -1]) ** 2).sum()) or 1.0
            s = x @ table[at, :-1] / norm / divisor
            p = np.exp(s - s.max())
            best = int(np.argmax(s))
            out.append((languages[best], float(p[best] / p.sum())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    told = F.pandas_udf(guess, "lang_pred string, score double")
    rest = docs.drop("lang_pred", "score")
    name = free(docs.columns, "told")
    return rest.withColumn(name, told(F.col("text"))).select(*rest.columns, f"{name}.lang_pred", f"{name}.score")
