"""Benchmark decontamination with a distributed positional inverted index.

The index holds one posting (term, document key, position) for each occurrence of a test term in the training
documents, written as a table. A test window is looked up from its rarest term: postings of that term, moved back by
the term's place in the window, are the possible starts; they are intersected with the equally moved postings of the
next rarest terms; what is left is compared with the document's own words, by a digest of all words of the window.

Everything here is DataFrame code: words, postings and comparisons stay in the JVM.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.scratch import Scratch

#: Between words: every ASCII character but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Test windows and test terms are broadcast up to so many rows (some 200 bytes each); beyond, the joins shuffle.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z alone; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() agrees with A-Z lower-casing on pure ASCII, and is far cheaper than translate()
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def document_key(doc_id: Column, text: Column) -> Column:
    """A row's key. Rows that share it, by chance or as they are equal, only cost a comparison: matches are confirmed on
    the words of each."""
    return F.xxhash64(doc_id, text)


def small(frame: DataFrame, rows: int) -> DataFrame:
    """``frame``, broadcast only if it has at most so many rows."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def window_id(window: Column) -> Column:
    """A digest of a window's words; no word holds a space."""
    return F.md5(F.array_join(window, " "))


def test_windows(items: DataFrame, width: int) -> DataFrame:
    """Distinct windows (wid, window words, items): ``width`` consecutive words; a shorter item is one window."""
    per_item = items.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    cut = per_item.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, width))).alias("window"))
    return cut.groupBy(window_id(F.col("window")).alias("wid"), "window").agg(F.collect_set("item_id").alias("items"))


@dataclass
class PositionalIndex:
    """postings (term, key, pos); term_counts (term, n); both written tables."""

    postings: DataFrame
    term_counts: DataFrame
    scratch: Scratch

    def drop(self) -> None:
        self.scratch.drop("postings", "term_counts")


def build_index(docs: DataFrame, terms: DataFrame) -> PositionalIndex:
    """Postings of the given terms (column ``term``) in documents (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "positional-index")
    occurrences = docs.select(document_key(F.col("doc_id"), F.col("text")).alias("key"), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    postings = scratch.keep(occurrences.join(small(terms.distinct(), 10 * BROADCAST_ROWS), "term").select("term", "key", "pos"), "postings")
    return PositionalIndex(postings, scratch.keep(postings.groupBy("term").agg(F.count("*").alias("n")), "term_counts"), scratch)


def ranked_terms(windows: DataFrame, index: PositionalIndex) -> DataFrame:
    """Windows all of whose terms have postings, with their terms (n, offset, term) from the rarest on."""
    spread = windows.select("wid", "window", "items", F.posexplode("window").alias("offset", "term")).join(index.term_counts, "term")
    by_window = spread.groupBy("wid", "window").agg(F.first("items").alias("items"), F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("rank"))
    return by_window.where(F.size("rank") == F.size("window"))


def phrase_starts(index: PositionalIndex, ranked: DataFrame, lists: int) -> DataFrame:
    """(key, start, wid, window, items) where the ``lists`` rarest terms of a window stand at their offsets."""
    first = small(ranked.withColumn("term", F.col("rank")[0]["term"]), BROADCAST_ROWS)
    found = index.postings.join(first, "term").select("key", (F.col("pos") - F.col("rank")[0]["offset"]).alias("start"), "wid", "window", "items", "rank").where(F.col("start") >= 0)
    for i in range(1, lists):
        wanted = F.get(F.col("rank"), F.lit(i))
        used = small(ranked.select(wanted["term"].alias("term")).where(F.col("term").isNotNull()).distinct(), BROADCAST_ROWS)
        listed = index.postings.join(used, "term", "left_semi").select(F.col("term").alias("t"), F.col("key").alias("k"), F.col("pos").alias("p"))
        more, done = found.where(F.size("rank") > i), found.where(F.size("rank") <= i)
        found = more.join(listed, (F.col("key") == F.col("k")) & (F.col("start") + wanted["offset"] == F.col("p")) & (wanted["term"] == F.col("t")), "left_semi").unionByName(done)
    return found.drop("rank")


def near_matches(index: PositionalIndex, windows: DataFrame, slop: int, lists: int = 3) -> DataFrame:
    """Proximity matches (key, wid, pos, spread): the ``lists`` rarest terms of a window within ``slop`` words of its rarest.

    pos is the rarest term's position, spread the largest distance of the others from it. Positions are dealt into
    blocks of ``slop + 1``, so that each list is met by an equality join on its own and the two adjoining blocks.
    """
    ranked, wide = ranked_terms(windows, index), slop + 1
    found = index.postings.join(small(ranked.withColumn("term", F.col("rank")[0]["term"]), BROADCAST_ROWS), "term").select("key", "wid", "pos", "rank", F.lit(0).alias("spread"))
    for i in range(1, lists):
        wanted = F.get(F.col("rank"), F.lit(i))
        used = small(ranked.select(wanted["term"].alias("term")).where(F.col("term").isNotNull()).distinct(), BROADCAST_ROWS)
        listed = index.postings.join(used, "term", "left_semi").select(F.col("term").alias("t"), F.col("key").alias("k"), F.col("pos").alias("p"), F.explode(F.sequence(F.floor(F.col("pos") / wide) - 1, F.floor(F.col("pos") / wide) + 1)).alias("block"))
        more, done = found.where(F.size("rank") > i), found.where(F.size("rank") <= i)
        met = more.join(listed, (F.col("key") == F.col("k")) & (F.floor(F.col("pos") / wide) == F.col("block")) & (wanted["term"] == F.col("t")) & (F.abs(F.col("pos") - F.col("p")) <= slop) & (F.col("pos") != F.col("p")))
        met = met.groupBy("key", "wid", "pos").agg(F.first("rank").alias("rank"), F.greatest(F.first("spread"), F.min(F.abs(F.col("pos") - F.col("p")))).alias("spread"))
        found = met.unionByName(done)
    return found.drop("rank")


def near_windows(index: PositionalIndex, ranked: DataFrame, slop: int, lists: int = 3) -> DataFrame:
    """Distinct (key, wid) of the windows that near_matches() finds; equal rows of documents cost nothing more, as a
    posting is kept or not, and never multiplied."""
    wide = slop + 1
    found = index.postings.join(small(ranked.withColumn("term", F.col("rank")[0]["term"]), BROADCAST_ROWS), "term").select("key", "wid", "pos", "rank")
    for i in range(1, lists):
        wanted = F.get(F.col("rank"), F.lit(i))
        used = small(ranked.select(wanted["term"].alias("term")).where(F.col("term").isNotNull()).distinct(), BROADCAST_ROWS)
        listed = index.postings.join(used, "term", "left_semi").select(F.col("term").alias("t"), F.col("key").alias("k"), F.col("pos").alias("p"), F.explode(F.sequence(F.floor(F.col("pos") / wide) - 1, F.floor(F.col("pos") / wide) + 1)).alias("block"))
        more, done = found.where(F.size("rank") > i), found.where(F.size("rank") <= i)
        near = (F.col("key") == F.col("k")) & (F.floor(F.col("pos") / wide) == F.col("block")) & (wanted["term"] == F.col("t")) & (F.abs(F.col("pos") - F.col("p")) <= slop) & (F.col("pos") != F.col("p"))
        found = more.join(listed, near, "left_semi").unionByName(done)
    return found.select("key", "wid").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, lists: int = 2, rows: bool = False, slop: int | None = None) -> DataFrame:
    """Words of each document that stand inside an occurrence of a test window.

    docs: doc_id, text; items: item_id, text; further columns are ignored. Returns one row per input row: doc_id,
    n_words, n_hit, items (sorted strings), spans (array of start, length, items), contaminated: ``share * n_hit >=
    n_words`` and at least one hit. Null and empty texts have no words and are clean; an item without words is no
    window; an item whose id is null counts for its hit words and gives no id; repeated rows each get the same row;
    with an empty benchmark every document is clean. With ``rows``, a column ``row`` holds the whole input row; with
    ``slop``, a column ``n_near`` tells how many windows have their three rarest terms within so many words of their
    rarest, whether in a row or not.
    """
    docs, items = docs.select("doc_id", "text", *[F.struct(*docs.columns).alias("row")] * rows), items.select("item_id", "text")
    carried, told = ["row"] * rows, ["n_near"] * (slop is not None)
    scratch = Scratch(docs.sparkSession, "contamination")
    windows = scratch.keep(test_windows(items, width), "windows")
    index = build_index(docs, windows.select(F.explode("window").alias("term")))
    ranked = scratch.keep(ranked_terms(windows, index), "ranked")
    starts = phrase_starts(index, ranked, lists)
    # a set, as repeated rows share a key and each has brought the same starts
    by_doc = scratch.keep(starts.groupBy("key").agg(F.collect_set(F.struct("start", F.size("window").alias("length"), "wid", "items")).alias("maybe")), "starts")
    if slop is not None:
        near = near_windows(index, ranked, slop).groupBy("key").agg(F.count("*").alias("n_near"))
        by_doc = scratch.keep(by_doc.join(near, "key", "full"), "near")
    index.drop()
    scratch.drop("windows", "ranked")

    keyed = docs.withColumn("key", document_key(F.col("doc_id"), F.col("text")))
    met = keyed.join(by_doc, "key", "left").select("doc_id", words_of(F.col("text")).alias("w"), "maybe", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in told], *carried)
    sure = F.filter(F.coalesce("maybe", F.array()), lambda m: window_id(F.slice(F.col("w"), m["start"] + 1, m["length"])) == m["wid"])
    spans = F.sort_array(F.transform(sure, lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"), m["items"].alias("items"))))
    met = met.select("doc_id", F.size("w").cast("long").alias("n_words"), spans.alias("spans"), *told, *carried)
    # spans come by start: each adds the words beyond what the earlier ones have covered
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("hit")),
        lambda a, s: F.struct(F.greatest(a["to"], s["start"] + s["length"]).alias("to"), (a["hit"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["to"], s["start"]))).alias("hit")),
        lambda a: a["hit"],
    )
    ids = F.sort_array(F.transform(F.filter(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"]))), F.isnotnull), lambda i: i.cast("string")))
    out = met.select("doc_id", "n_words", covered.alias("n_hit"), ids.alias("items"), "spans", *told, *carried)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``contamination`` finds clean."""
    return contamination(docs, items, rows=True, **how).where(~F.col("contaminated")).select("row.*")
