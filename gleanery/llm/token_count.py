"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than CHUNK characters is encoded as overlapping chunks, rows of their own that any executor takes. Two
neighbouring chunks are spliced where both have a token boundary at the same single space between two words, with the
same tokens on either side of it: the splitter never joins what stands on both sides of such a space, so the tokens
before it are those of the whole text in the left chunk, and the tokens after it in the right one. If an overlap has
no such place, the text is encoded again with overlaps and chunks twice as long, at last as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.scratch import Scratch
from gleanery.llm.text_units import UnitTable, slices

#: Characters of a chunk and of the overlap of two; a text of at most CHUNK is encoded at once.
CHUNK, OVERLAP = 50_000, 1_000
#: A single space between two characters that are not white space: a place to splice.
_PLACE = re.compile(r"(?<=\S) (?=\S)")

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    """The tokenizer of a .json or .model file, loaded once a worker."""
    if path not in _loaded:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(path)
            _loaded[path].no_truncation()
            _loaded[path].no_padding()
        else:
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def offsets(path: str, text: str) -> list[tuple[int, int, int]]:
    """(id, first character, end) of each token of a text."""
    t = _tokenizer(path)
    if path.endswith(".json"):
        e = t.encode(text, add_special_tokens=False)
        return [(i, *o) for i, o in zip(e.ids, e.offsets, strict=True)]
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters that begin before each byte
    return [(p.id, int(chars[p.begin]), int(chars[p.end])) for p in t.encode(text, return_type="proto").pieces]


def _plain_counts(path: str, texts: list[str]) -> list[int]:
    t = _tokenizer(path)
    if path.endswith(".json"):
        return [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(x) for x in t.encode(texts, num_threads=1)]


def words_are_independent(path: str) -> bool:
    """Whether white space only separates: the file's splitter keeps matches that hold none, and drops the rest."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        rules = json.load(f).get("pre_tokenizer") or {}
    first = (rules.get("pretokenizers") or [rules])[0]
    if (first.get("type"), first.get("behavior"), first.get("invert")) != ("Split", "Removed", True):
        return False
    import regex

    own = regex.compile(first["pattern"]["Regex"])
    return not any(own.search(f"{a}{w}{b}") and any(regex.search(r"\s", m[0]) for m in own.finditer(f"{a}{w}{b}")) for w in " \t\n\v\f\r" for a in "a1.'" for b in "a1.'")


_units: dict[str, UnitTable] = {}


def counts(path: str, texts: pa.Array, independent: bool) -> np.ndarray:
    """Tokens of each whole text. Where words are independent, each distinct one is encoded once."""
    if not independent:
        return np.array(_plain_counts(path, [t or "" for t in texts.to_pylist()]), np.int64)
    if path not in _units:
        _units[path] = UnitTable(lambda units: [np.array([n], np.int32) for n in _plain_counts(path, [u.decode("utf-8", "replace") for u in units])])
    out = np.zeros(len(texts), np.int64)
    for words in slices(texts):
        start, _ = _units[path].look_up(words)
        out[words.first : words.first + words.n] = np.bincount(words.text, weights=_units[path].values[start], minlength=words.n)
    return out


def places(path: str, text: str, start: int, zone: tuple[int, int], tokens: list[tuple[int, int, int]]) -> list[dict]:
    """Places to splice in a zone of a chunk that starts at ``start``: where, tokens before it, the tokens about it."""
    begins = np.array([t[1] for t in tokens], np.int64)
    ends = np.maximum.accumulate([t[2] for t in tokens]) if tokens else np.zeros(0, np.int64)
    found = []
    for m in _PLACE.finditer(text, max(0, zone[0] - start), max(0, zone[1] - start)):
        at = m.start()
        before = int(np.searchsorted(begins, at, "left"))
        if before and ends[before - 1] > at or not 0 < before < len(tokens):
            continue  # a token lies across
        around = [(i, a - at, b - at) for i, a, b in tokens[max(0, before - 4) : before + 4]]
        found.append({"at": start + at, "before": before, "sign": str(around)})
    return found


def _chunks(chunk: int, overlap: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, text) -> (key, no, chunks, start, text)"""
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                step = chunk - overlap
                n = max(1, -(-(len(text) - overlap) // step))
                for no in range(n):
                    yield pa.RecordBatch.from_pylist([{"key": key, "no": no, "chunks": n, "start": no * step, "text": text[no * step : no * step + chunk]}], schema)

    schema = pa.schema([("key", pa.int64()), ("no", pa.int32()), ("chunks", pa.int32()), ("start", pa.int64()), ("text", pa.string())])
    return task


_PLACES = "array<struct<at: bigint, before: bigint, sign: string>>"


def _encoded_chunks(path: str, overlap: int):
    kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64()), ("sign", pa.string())]))
    schema = pa.schema([("key", pa.int64()), ("no", pa.int32()), ("chunks", pa.int32()), ("tokens", pa.int64()), ("head", kind), ("tail", kind)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text, start = r["text"], r["start"]
                tokens, end = offsets(path, text), r["start"] + len(r["text"])
                row = {"key": r["key"], "no": r["no"], "chunks": r["chunks"], "tokens": len(tokens)}
                row["head"] = places(path, text, start, (start, start + overlap), tokens) if r["no"] else []
                row["tail"] = places(path, text, start, (end - overlap, end), tokens) if r["no"] < r["chunks"] - 1 else []
                yield pa.RecordBatch.from_pylist([row], schema)

    return task


def spliced_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of texts (key, text) with different keys, by overlapping chunks."""
    scratch, done, turn = Scratch(texts.sparkSession, "token-count"), None, 0
    pending = texts
    while True:
        cut = pending.mapInArrow(_chunks(chunk, overlap), "key long, no int, chunks int, start long, text string")
        cut = cut.repartition("key", "no")
        rows = scratch.keep(cut.mapInArrow(_encoded_chunks(path, overlap), f"key long, no int, chunks int, tokens long, head {_PLACES}, tail {_PLACES}"), f"chunks{turn}")
        order = Window.partitionBy("key").orderBy("no")
        met = rows.withColumn("left", F.lag("tail").over(order))
        # the places that both chunks have; the one in the middle is taken
        both = F.filter("head", lambda h: F.exists("left", lambda t: (t["at"] == h["at"]) & (t["sign"] == h["sign"])))
        met = met.withColumn("joint", F.when(F.col("no") > 0, F.get(both, F.floor(F.size(both) / 2).cast("int"))))
        met = met.withColumn("lost", (F.col("no") > 0) & F.col("joint").isNull())
        here = F.col("joint")["at"]
        met = met.withColumn("in_left", F.get(F.filter("left", lambda t: t["at"] == here), F.lit(0))["before"])
        # a chunk counts from its splice with the left one; what the left one has beyond the splice is taken off
        extra = F.when(F.col("no") > 0, F.lag("tokens").over(order) - F.col("in_left") + F.col("joint")["before"]).otherwise(0)
        summed = met.withColumn("extra", extra).groupBy("key").agg(F.max("lost").alias("lost"), (F.sum("tokens") - F.sum("extra")).alias("n_tokens"))
        summed = scratch.keep(summed, f"sums{turn}")
        good = summed.where(~F.col("lost")).select("key", "n_tokens")
        done = good if done is None else done.union(good)
        lost = summed.where("lost").select("key")
        if lost.isEmpty():
            return done
        pending, turn, chunk, overlap = scratch.keep(pending.join(lost, "key", "left_semi"), f"pending{turn}"), turn + 1, 2 * chunk, 2 * overlap
        scratch.drop(f"chunks{turn - 1}")


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs (doc_id, text), whole texts, as the file's library counts them.

    Nothing is added, cut off or filled up, and the special strings of the file's vocabulary count as the library takes
    them by default. Null is an empty text: 0 bytes, 0 tokens. Repeated rows and null ids are rows like others; further
    columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    independent = words_are_independent(path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(counts(path, batch.column("text"), independent))})

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    short = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= chunk).select("doc_id", size.alias("n_bytes"), "text")
    short = short.mapInArrow(task, "doc_id long, n_bytes long, n_tokens long")
    scratch = Scratch(docs.sparkSession, "huge-texts")
    huge = scratch.keep(docs.where(F.char_length("text") > chunk).withColumn("key", F.monotonically_increasing_id()), "huge")
    found = spliced_counts(huge.select("key", "text"), path, chunk, overlap)
    return short.union(huge.select("key", "doc_id", size.alias("n_bytes")).join(found, "key").select("doc_id", "n_bytes", "n_tokens"))
