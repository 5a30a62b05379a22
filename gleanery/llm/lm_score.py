"""Cross-entropy difference of documents under two matched n-gram models.

One vocabulary, all words of all documents, serves both models. The target model counts the documents of a target set,
the background model all documents. Both are bigram models that fall back to unigrams by the same Dirichlet prior, and
background counts are scaled to the target's number of tokens, so that neither model is sharper for having seen more.
A document's score is its mean loss per token under the target model less that under the background model: the lower,
the more it is like the target. Tokens are the words of a text and its end; its first word follows a start.

All words and bigrams of all documents are counted, and nothing of them is gathered: documents are dealt into blocks of
bounded size; a block tells the counts of its distinct words and bigrams, dealt into parts by their hash; a part sums
those of all blocks and tells each block the sums of what it has; and with these a block is scored. Keys travel as
sorted differences, a few bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.names import free
from gleanery.llm.scratch import Scratch
from gleanery.llm.text_units import Words, constants, mix, slices

#: Weight of the unigram model in a context's counts, and what each word of the vocabulary has beside its count.
PRIOR, ADDED = 200.0, 0.5
#: Target ids are broadcast up to so many (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
#: Bytes of text of a block, about; a row counts as ROW_BYTES besides its text. Bytes of text for each part of the keys,
#: whose distinct ones meet in a task, and the fewest parts.
BLOCK_BYTES, ROW_BYTES, PART_BYTES, LEAST_PARTS = 1 << 22, 64, 1 << 22, 64
#: Bits of a key that are kept, the lowest of which tells bigrams (1) from words (0).
KEY_BITS = 56

_START, _END, _OF, _TO = constants(4, 51)
_PAIR, _SHORT = np.uint64(1), np.uint64(64 - KEY_BITS)


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of a slice: its key, its context's key, the key of both, its text, whether it follows a start.

    A word's contexts are all its occurrences, as each is followed by a word or the end; those of a start are as many
    as there are ends.
    """
    own = words.hashes(fold=True)
    last = np.flatnonzero(np.append(words.text[1:] != words.text[:-1], True)) if len(own) else np.zeros(0, np.int64)
    first = np.zeros(len(own), bool)
    if len(own):
        first[np.append(0, last[:-1] + 1)] = True
    before = np.where(first, _START, np.append(_START, own[:-1])) if len(own) else own
    to, of = np.concatenate((own, np.full(len(last), _END))), np.concatenate((before, own[last]))
    pair = (mix(of * _OF + to * _TO) >> _SHORT) | _PAIR
    return _single(to), _single(of), pair, np.concatenate((words.text, words.text[last])), np.concatenate((first, np.zeros(len(last), bool)))


def _single(words: np.ndarray) -> np.ndarray:
    return (words >> _SHORT) & ~_PAIR


def _summed(keys: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted keys with their summed counts."""
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    return found, *(np.bincount(which, weights=np.concatenate(c), minlength=len(found)).astype(np.int64) for c in counts)


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as their lowest bytes, then their second ones and so on: high bytes are mostly 0, and compress."""
    return values.astype(kind).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _key_bytes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)), "<u8")


def _from_key_bytes(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, "<u8"), dtype=np.uint64)


def _edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the keys of each part begin: parts, a power of two, are ranges of keys."""
    return np.searchsorted(keys, (np.arange(parts, dtype=np.uint64)) << np.uint64(KEY_BITS - parts.bit_length() + 1)).tolist() + [len(keys)]


_BLOBS = "part int, _block long, keys binary, n binary, t binary"


def _counted(parts: int):
    def task(docs: pa.Table) -> pa.Table:
        """The texts of a block -> the counts of its keys in texts that count and in those of the target, part by part."""
        keys, n, t = [], [], []
        for batch in docs.select(["text", "counts", "target"]).to_batches():
            counts, target = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("counts", "target"))
            for words in slices(batch.column("text")):
                to, _, pair, text, _ = _tokens(words)
                found, which = np.unique(np.concatenate((to, pair)), return_inverse=True)
                keys.append(found)
                for out, inside in ((n, counts[words.first + text]), (t, (counts & target)[words.first + text])):
                    out.append(np.bincount(which, weights=np.concatenate((inside, inside)), minlength=len(found)))
        # each block has the end, so that each asks for its counts
        found, n, t = _summed([np.array([_single(_END)]), *keys], [np.zeros(1), *n], [np.zeros(1), *t])
        edges = _edges(found, parts)
        rows = [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        block = docs.column("_block")[0].as_py() if len(docs) else 0
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in rows], pa.int32()),
                "_block": pa.array([block] * len(rows), pa.int64()),
                "keys": pa.array([_key_bytes(found[a:b]) for _, a, b in rows], pa.binary()),
                "n": pa.array([_planes(n[a:b], "<u4") for _, a, b in rows], pa.binary()),
                "t": pa.array([_planes(t[a:b], "<u4") for _, a, b in rows], pa.binary()),
            }
        )

    return task


_TOLD = "part int, _block long, n binary, t binary, words long, tokens long, target_tokens long"


def _told(blobs: pa.Table) -> pa.Table:
    """The blocks' counts of one part -> to each block the sums over all of them for its keys; and, with the first one,
    how many words the part has, their occurrences, and those in the target."""
    if not len(blobs):
        return pa.table([pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)
    own = [_from_key_bytes(k.as_py()) for k in blobs.column("keys")]
    counts = ([_from_planes(x.as_py(), "<u4") for x in blobs.column(c)] for c in ("n", "t"))
    keys, n, t = _summed(own, *counts)
    word = ((keys & _PAIR) == 0) & (n > 0)
    whole = [(int(word.sum()), int(n[word].sum()), int(t[word].sum()))] + [(0, 0, 0)] * (len(own) - 1)
    at = [np.searchsorted(keys, k) for k in own]
    return pa.table(
        [
            blobs.column("part"),
            blobs.column("_block"),
            pa.array([_planes(n[i], "<u8") for i in at], pa.binary()),
            pa.array([_planes(t[i], "<u8") for i in at], pa.binary()),
            *(pa.array([w[i] for w in whole], pa.int64()) for i in range(3)),
        ],
        schema=_SCHEMA,
    )


_SCHEMA = pa.schema([("part", pa.int32()), ("_block", pa.int64()), ("n", pa.binary()), ("t", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64()), ("target_tokens", pa.int64())])


def losses(texts: pa.Array, keys: np.ndarray, counts: np.ndarray, tokens: tuple[int, int], words: int) -> np.ndarray:
    """(number of words, mean loss under the target model, under the background model) of each text.

    keys: sorted, with those of the texts' words and bigrams; counts: (t, n) of each. Others have the counts 0.
    """
    scale = np.array([1.0, tokens[0] / max(1, tokens[1])])  # the background is scaled to the target
    whole = np.array(tokens) * scale + ADDED * (words + 1)

    def counted(of: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((len(of), 2))
        at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
        return np.where((keys[at] == of)[:, None], counts[at], 0.0) * scale

    out, ends = np.zeros((len(texts), 3)), counted(np.array([_single(_END)]))
    for part in slices(texts):
        to, of, pair, text, first = _tokens(part)
        single = (counted(to) + ADDED) / whole
        context = np.where(first[:, None], ends, counted(of))
        p = np.log((counted(pair) + PRIOR * single) / (context + PRIOR))
        size, rows = np.bincount(text, minlength=part.n), slice(part.first, part.first + part.n)
        out[rows, 0] = part.counts()
        for c in (0, 1):
            out[rows, c + 1] = -np.bincount(text, weights=p[:, c], minlength=part.n) / np.maximum(size, 1)
    return out


def block_keys(texts: pa.ChunkedArray) -> np.ndarray:
    """The sorted distinct keys of a block's texts, and the end."""
    found = [np.array([_single(_END)])]
    for chunk in texts.chunks:
        for words in slices(chunk):
            to, _, pair, _, _ = _tokens(words)
            found.append(np.unique(np.concatenate((to, pair))))
    return np.unique(np.concatenate(found))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, counted: Column | None = None) -> DataFrame:
    """Adds n_words, loss_target, loss_background (nats a token) and score, their difference, to every row of docs
    (doc_id, text and any others).

    The target is the ids in target (doc_id). The background is the rows for which ``counted`` holds, all of them by
    default; all rows are scored. Only ``text`` is read, whole. Null and empty texts have no tokens and the score 0.
    Repeated rows count, and are scored, as often as they come; repeated and null ids in target change nothing. A word
    that was never counted has the probability of one. Clashing columns are replaced. Empty tables give no rows.
    """
    names = ("n_words", "loss_target", "loss_background", "score")
    scratch, carried = Scratch(docs.sparkSession, "lm-score"), docs.drop(*names)
    size = carried.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    parts = max(LEAST_PARTS, 1 << max(0, -(-size // PART_BYTES) - 1).bit_length())
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // BLOCK_BYTES))))
    block, known, chosen = (free(carried.columns, n) for n in ("block", "counts", "id"))
    ids = target.select(F.col("doc_id").alias(chosen)).where(F.col(chosen).isNotNull()).distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    counts = F.coalesce(F.lit(True) if counted is None else counted, F.lit(False))
    texts = carried.select("doc_id", "text", counts.alias(known)).join(ids, F.col("doc_id") == F.col(chosen), "left")
    texts = texts.select(number.alias("_block"), "text", F.col(known).alias("counts"), F.col(chosen).isNotNull().alias("target"))
    blobs = texts.groupBy("_block").applyInArrow(_counted(parts), _BLOBS)
    told = scratch.keep(blobs.groupBy("part").applyInArrow(_told, _TOLD), "told")
    whole = told.agg(F.sum("target_tokens"), F.sum("tokens"), F.sum("words")).first()
    tokens, words, own = (whole[0] or 0, whole[1] or 0), whole[2] or 0, carried.columns

    def task(rows: pa.Table, sums: pa.Table) -> pa.Table:
        keys = block_keys(rows.column("text"))
        by = np.argsort(sums.column("part").to_numpy(), kind="stable")
        counts = np.column_stack([np.concatenate([_from_planes(sums.column(c)[int(i)].as_py(), "<u8") for i in by]) for c in ("t", "n")]).astype(np.float64)
        found = np.concatenate([np.zeros((0, 3)), *(losses(part, keys, counts, tokens, words) for part in rows.column("text").chunks)])
        columns = [pa.array(found[:, 0].astype(np.int64)), pa.array(found[:, 1]), pa.array(found[:, 2]), pa.array(found[:, 1] - found[:, 2])]
        return pa.table([*(rows.column(c) for c in own), *columns], [*own, *names])

    kinds = [T.StructField(n, T.LongType() if n == "n_words" else T.DoubleType()) for n in names]
    return carried.withColumn(block, number).groupBy(block).cogroup(told.select("_block", "part", "n", "t").groupBy("_block")).applyInArrow(task, T.StructType([*carried.schema.fields, *kinds]))
