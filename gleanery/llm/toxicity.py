"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, one of toxic and one of ordinary documents, predict each character from the ORDER - 1
before it. Counts of an n-gram are discounted, and what is discounted goes to the next shorter n-grams by their
continuation counts; the counts of the shortest both classes share. Where neither class has seen a context, and so for
rare expressions, both fall back to the same probabilities, and the comparison is level. A word's score is the
difference of its log-likelihoods under the two models, divided by its length; a document's score weighs its strongest
words and the length-normalised difference of the whole text, by a logistic calibration on rows that the models have
not seen. The calibration also has the logarithm of the number of words: the strongest of n words are the higher the
more words there are, so the same strongest scores mean less in a longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.language_id import is_held_out
from gleanery.llm.scratch import Scratch
from gleanery.llm.text_units import Words, constants, mix, slices

ORDER = 6
#: N-grams shorter than this are counted over both classes together.
SHARED = 3
DISCOUNT = 0.75
#: Labelled rows that the fit takes at most, about, of each class (drawn by a hash of doc_id).
TOXIC_ROWS, ORDINARY_ROWS = 6000, 12000
#: One in so many of them calibrates; the others are counted.
CALIBRATE = 4
#: A document counts as toxic from this score on.
THRESHOLD = 0.3
#: A document's strongest words that its score weighs.
STRONGEST = 3

#: Words whose ratios a worker remembers at most (24 bytes each).
MOST_WORDS = 1 << 18
#: Texts whose features a task computes at once.
ROWS = 1024

#: Words are runs of ASCII letters and of bytes beyond ASCII.
_BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_FACTOR = constants(ORDER + 1, 41)
_PAD, _END = "\x02", "\x03"


def _distinct(words: Words) -> tuple[list[str], np.ndarray]:
    """Distinct lower-cased words of a slice, and which of them each word is."""
    _, first, which = np.unique(words.hashes(fold=True), return_index=True, return_inverse=True)
    raw = words.raw.tobytes()
    return [raw[s:e].decode("utf-8", "replace").lower() for s, e in zip(words.start[first], words.end[first], strict=True)], which


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (word, c1, c0): a slice's words with their counts in toxic and in ordinary texts."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for words in slices(batch.column("text"), _BETWEEN):
            names, which = _distinct(words)
            label = toxic[words.first + words.text]
            c1 = np.bincount(which, weights=label, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()), "c1": pa.array(c1), "c0": pa.array(np.bincount(which, minlength=len(names)) - c1)})


class WordTable:
    """Log-ratios and lengths of words by their hashes, kept between the slices and tasks of a worker; it is emptied
    once it holds MOST_WORDS words."""

    def __init__(self):
        self.keys, self.ratios, self.sizes = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of some sorted hashes stands or belongs, and whether it stands there."""
        at = np.searchsorted(self.keys, hashes)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == hashes if len(self.keys) else np.zeros(len(hashes), bool)

    def look_up(self, words: Words, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ratios, sizes) of the distinct words of a slice, and which of them each word is."""
        hashes, first, which = np.unique(words.hashes(fold=True), return_index=True, return_inverse=True)
        if len(self.keys) > MOST_WORDS:
            self.__init__()
        at, known = self.places(hashes)
        if not known.all():
            fresh, raw = np.flatnonzero(~known), words.raw.tobytes()
            names = [raw[s:e].decode("utf-8", "replace").lower() for s, e in zip(words.start[first[fresh]], words.end[first[fresh]], strict=True)]
            self.ratios = np.insert(self.ratios, at[fresh], word_ratios(names, model))
            self.sizes = np.insert(self.sizes, at[fresh], [len(w) + 1 for w in names])
            self.keys = np.insert(self.keys, at[fresh], hashes[fresh])
            at, _ = self.places(hashes)
        return self.ratios[at], self.sizes[at], which


@dataclass
class ToxicityModel:
    """levels: for each order of class counts, the order, sorted n-gram hashes with the log-ratio of each, and sorted
    context hashes with what an unseen continuation adds to the log-ratio of the next shorter n-gram. weights: the
    calibration, of the features and of 1. met: words that a worker has scored."""

    levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: np.ndarray
    met: WordTable = field(default_factory=WordTable)


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each after ORDER - 1 pads and before an end, and where each begins."""
    codes = np.frombuffer("".join(f"{_PAD * (ORDER - 1)}{w}{_END}" for w in names).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.cumsum([0] + [len(w) + ORDER for w in names])


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points from each place on."""
    total = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for j in range(n):
        total += codes[j : j + len(total)] * _FACTOR[j]
    return mix(total + np.uint64(n))


def _hashed(n: int):
    """A task (n-gram, v) -> (key, v), key being the hash of the n code points."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(_gram_hashes(codes, n)[::n].view(np.int64)), "v": batch.column(1)})

    return task


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0.0), hit


def word_ratios(names: list[str], model: ToxicityModel) -> np.ndarray:
    """Sum over each word's characters of log p(toxic model) - log p(ordinary model)."""
    if not names:
        return np.zeros(0)
    codes, begin = _codes(names)
    ratio = np.zeros(len(codes) - ORDER + 1)
    for n, grams, ratios, contexts, rests in model.levels:  # from the shortest on
        at = slice(ORDER - n, ORDER - n + len(ratio))
        known, seen = _looked_up(grams, ratios, _gram_hashes(codes, n)[at])
        rest, _ = _looked_up(contexts, rests, _gram_hashes(codes, n - 1)[at])
        ratio = np.where(seen, known, ratio + rest)
    inside = np.concatenate(([0.0], np.cumsum(ratio)))
    return inside[begin[1:] - ORDER + 1] - inside[begin[:-1]]


def _features(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    """One row a text: its STRONGEST words' scores, the score of the whole, the logarithm of its number of words."""
    rows = np.zeros((len(texts), STRONGEST + 2))
    for words in slices(texts, _BETWEEN):
        total, sizes, which = model.met.look_up(words, model)
        each, ends = (total / np.maximum(sizes, 1))[which], np.cumsum(words.counts())
        for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
            if b > a:
                top = np.sort(np.partition(each[a:b], -min(STRONGEST, b - a))[-STRONGEST:])[::-1]
                rows[words.first + i, : len(top)] = top
                rows[words.first + i, STRONGEST:] = total[which[a:b]].sum() / sizes[which[a:b]].sum(), np.log1p(b - a)
    return rows


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the features and of 1 in a logistic regression of weighted rows with a small ridge, by Newton's method."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.1] * (len(w) - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _probabilities(grams: DataFrame, scratch: Scratch) -> list[tuple[int, DataFrame, DataFrame]]:
    """For each order from 2 on: (order, (gram, p1, p0) of seen n-grams in either class, (ctx, left1, left0): the weight
    that either class leaves to the n-gram without its first character).

    grams: (gram, c1, c0), the longest n-grams with their counts in either class. A shorter n-gram's count in a class
    is its continuation count: in how many n-grams of the class that are longer by one at the left it occurs. Below
    SHARED the counts of both classes are one. Of the characters themselves, one never met has DISCOUNT / (k + 1) of k
    characters' discounts, so that a context's probabilities sum to 1 over all characters and that one.
    """
    counts = {ORDER: grams.select("gram", "c1", "c0")}
    kinds = lambda c: F.sum((F.col(c) > 0).cast("int"))
    for n in range(ORDER - 1, 0, -1):
        own = counts[n + 1].groupBy(F.substring("gram", 2, n).alias("gram"))
        counted = own.agg(kinds("c1").alias("c1"), kinds("c0").alias("c0")) if n >= SHARED else own.agg(F.count("*").alias("c1"), F.count("*").alias("c0"))
        counts[n] = scratch.keep(counted, f"c{n}")
    whole = counts[1].agg(F.sum("c1").alias("all"), F.count("*").alias("k"))
    level = (F.greatest(F.col("c1") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("k") / (F.col("k") + 1)) / F.col("all")
    lower = counts[1].crossJoin(F.broadcast(whole)).select("gram", level.alias("p1"), level.alias("p0"))  # whole is one row
    out = []
    for n in range(2, ORDER + 1):
        own = counts[n].select("gram", "c1", "c0", F.substring("gram", 1, n - 1).alias("ctx"), F.substring("gram", 2, n - 1).alias("tail"))
        around = own.groupBy("ctx").agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), kinds("c1").alias("k1"), kinds("c0").alias("k0"))
        left = {c: F.when(F.col(f"n{c}") > 0, DISCOUNT * F.col(f"k{c}") / F.col(f"n{c}")).otherwise(1.0) for c in (1, 0)}
        met = own.join(around, "ctx").join(lower.select(F.col("gram").alias("tail"), F.col("p1").alias("b1"), F.col("p0").alias("b0")), "tail")
        p = {c: F.when(F.col(f"n{c}") > 0, F.greatest(F.col(f"c{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"n{c}")).otherwise(0.0) + left[c] * F.col(f"b{c}") for c in (1, 0)}
        lower = scratch.keep(met.select("gram", p[1].alias("p1"), p[0].alias("p0")), f"p{n}")
        out.append((n, lower, around.select("ctx", left[1].alias("left1"), left[0].alias("left0"))))
    return out


def _levels(grams: DataFrame, scratch: Scratch) -> list[tuple[int, DataFrame, DataFrame]]:
    """For each order of class counts: (order, (gram, v) log-ratios of seen n-grams, (ctx, v) what an unseen
    continuation adds to the log-ratio of the n-gram without its first character)."""
    ratio = lambda a, b: F.log(F.col(a) / F.col(b)).alias("v")
    return [(n, seen.select("gram", ratio("p1", "p0")), rests.select("ctx", ratio("left1", "left0"))) for n, seen, rests in _probabilities(grams, scratch) if n >= SHARED]


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic). Of several labels of one document the highest
    counts; null labels and labels without a text teach nothing; rows that repeat a labelled doc_id teach each. Without
    rows of both classes every score is 0."""
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    found = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    toxic_share, ordinary_share = toxic_rows / max(1, found.get(1, 0)), ordinary_rows / max(1, found.get(0, 0))
    share = F.when(F.col("toxic") == 1, toxic_share).otherwise(ordinary_share)
    chosen = labels.where(part < share).orderBy(part).limit(2 * (toxic_rows + ordinary_rows))
    text = docs.select("doc_id", "text").where("text IS NOT NULL")
    sample = scratch.keep(text.join(F.broadcast(chosen), "doc_id"), "sample")  # chosen: bounded by its limit
    learn = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)) != 0)

    words = learn.select("text", "toxic").mapInArrow(_word_counts, "word string, c1 long, c0 long").groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    padded = F.concat(F.lit(_PAD * (ORDER - 1)), F.col("word"), F.lit(_END))
    cut = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))).alias("gram"), "c1", "c0")
    grams = scratch.keep(cut.groupBy("gram").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")), "grams")

    def table(values: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        found = values.mapInArrow(_hashed(n), "key long, v double").toArrow()  # 16 bytes for each n-gram of the sample
        keys = found.column("key").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        return keys[by], found.column("v").to_numpy()[by]

    # a context that adds nothing is as one that is not known
    levels = [(n, *table(seen, n), *table(rests.where("v != 0"), n - 1)) for n, seen, rests in _levels(grams, scratch)] if not grams.isEmpty() else []
    model = ToxicityModel(levels, np.zeros(STRONGEST + 3))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_pydict({"x": pa.array(list(_features(batch.column("text"), shared.value)), pa.list_(pa.float64())), "y": batch.column("toxic").cast(pa.float64())})

    held = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)) == 0).select("text", "toxic").mapInArrow(measured, "x array<double>, y double").toPandas()
    if len(set(held["y"])) == 2:
        y = held["y"].to_numpy()
        weight = np.where(y == 1, 1 / min(1.0, toxic_share), 1 / min(1.0, ordinary_share))  # classes as frequent as in all labels
        model.weights = _calibrated(np.array(held["x"].tolist()), y, weight * len(y) / weight.sum())
    else:
        model.weights[-1] = -np.inf
    return model


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """Adds score, or another ``name`` (0 to 1, the probability that the whole text is toxic), to every row of docs.

    Only ``text`` is read. Null and empty texts have no words and are given the score of no evidence. Repeated rows
    get the same score each. A column of that name is replaced. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the n-grams of the sample

    def scored(texts: pa.Array) -> pa.Array:
        known, out = shared.value, [np.zeros(0)]
        for i in range(0, len(texts), ROWS):
            x = _features(texts.slice(i, ROWS), known)
            with np.errstate(invalid="ignore"):
                s = np.clip(np.nan_to_num(np.column_stack([x, np.ones(len(x))]) @ known.weights, nan=-700, neginf=-700), -700, 700)
            out.append(1 / (1 + np.exp(-s)))
        return pa.array(np.concatenate(out))

    return docs.withColumn(name, F.arrow_udf(scored, "double")(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, name: str = "score", **how) -> DataFrame:
    """docs with score, learned from the labels of the rows that is_held_out(doc_id, 4, 2) leaves."""
    return score(docs, train(docs.where(~is_held_out(F.col("doc_id"), 4, 2)), labels, **how), name)
