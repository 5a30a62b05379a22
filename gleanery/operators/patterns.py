"""Many terms at once in many texts: a trie over tokens, one pass a text.

A term is a path of tokens (words, single other characters, and white space, any run of which is one), so a term of
words stands only where words end, and the pass over a text costs a lookup a token, however many terms there are. The
trie is broadcast while the terms are below a bound; beyond it, the texts are passed over once for each share of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms of one trie; a trie takes some twenty times as much in a worker.
TRIE_BYTES = 16 << 20
_TOKEN = re.compile(r"\w+|\s+|[^\w\s]")


def pieces(text: str) -> list[str]:
    return [" " if t.isspace() else t for t in _TOKEN.findall(text.lower())]


class Trie:
    """Terms by their tokens. Under the key None, a node has the term that ends there."""

    def __init__(self, terms: Sequence[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for token in pieces(term.strip()):
                node = node.setdefault(token, {})
            if node is not self.root:
                node[None] = node.get(None, ()) + (term,)

    def found(self, text: str) -> dict[str, list[int]]:
        """How often each term stands in the text, with no character of a word on either side of it, and the place
        (among tokens) of its first occurrence. A term's occurrences do not overlap; different terms' may."""
        tokens, out, ends = pieces(text), {}, {}
        last = len(tokens)
        for at, token in enumerate(tokens):
            node = self.root.get(token)
            if node is None or (at and not _wordly(token) and token != " " and _wordly(tokens[at - 1])):
                continue
            end = at + 1
            while node is not None:
                # a term that ends in another character may not be followed by a word
                if None in node and not (end < last and _wordly(tokens[end]) and not _wordly(tokens[end - 1])):
                    for term in node[None]:
                        if ends.get(term, 0) <= at:
                            ends[term] = end
                            out.setdefault(term, [0, at])[0] += 1
                node = node.get(tokens[end]) if end < last else None
                end += 1
        return out


def _wordly(token: str) -> bool:
    return token[0] == "_" or token[0].isalnum()


def _task(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) -> (id, term, n, first)."""
        trie = Trie(shared.value)
        for batch in batches:
            rows = [(i, term, n, at) for i, text in enumerate(batch.column("text").to_pylist()) if text for term, (n, at) in trie.found(text).items()]
            own = batch.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_pydict({"id": own, "term": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64()), "first": pa.array([r[3] for r in rows], pa.int64())})

    return task


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, n, first): the terms (term) that stand in texts (id, text), how often, and the place of the first.

    Case and runs of white space make no difference. Null and empty texts and terms have none. Terms that repeat count
    once. The terms are taken to the driver a share at a time, by a hash, TRIE_BYTES of them at most.
    """
    spark = texts.sparkSession
    own = terms.select("term").where(F.length(F.trim("term")) > 0).distinct()
    size = own.agg(F.sum(F.octet_length("term").cast("long") + 8)).first()[0] or 0
    shares = max(1, -(-2 * size // TRIE_BYTES)) if size > TRIE_BYTES else 1
    kind, found = texts.schema["id"].dataType.simpleString(), None
    for share in range(shares):
        some = own if shares == 1 else own.where(F.pmod(F.xxhash64("term"), F.lit(shares)) == share)
        listed = spark.sparkContext.broadcast(sorted(r["term"] for r in some.collect()))
        told = texts.select("id", "text").mapInArrow(_task(listed), f"id {kind}, term string, n long, first long")
        found = told if found is None else found.unionByName(told)
    return found


def entities(texts: DataFrame, gazetteer: DataFrame, stop: Sequence[str] = (), acronym: str = r"\b[A-Z]{2,6}(?:-[A-Z]{1,3})?\b", most: int | None = None) -> DataFrame:
    """(id, entities): the names that a text (id, text) has, each once: those of the gazetteer (place, term) as they are
    written there, in its order, then acronyms in the order in which they are met, but those of a stop list. Texts
    without any have an empty array; ``most`` cuts it."""
    known = occurrences(texts, gazetteer).join(gazetteer, "term").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("named"))
    short = F.coalesce(F.regexp_extract_all("text", F.lit(acronym), F.lit(0)), F.array().cast("array<string>"))
    short = F.filter(short, lambda a: ~a.isin(*stop)) if stop else short
    met = texts.join(known, "id", "left").select("id", F.array_distinct(F.concat(F.coalesce("named", F.array().cast("array<string>")), short)).alias("entities"))
    return met if most is None else met.withColumn("entities", F.slice("entities", 1, most))


def mentions(found: DataFrame) -> DataFrame:
    """(doc_id, entity) of entities (id, entities), as graphs take them."""
    return found.select(F.col("id").alias("doc_id"), F.explode("entities").alias("entity"))
