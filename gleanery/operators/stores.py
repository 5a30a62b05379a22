"""Stores as snapshots: upserts, cascades, state ladders, embeddings, candidates. Every operator returns new rows; no
table is changed in place."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.rules import first_rule
from gleanery.functions.text import tokens
from gleanery.operators.ingest import chunked, content_hash


def upserted_sources(sources: DataFrame, chunks: DataFrame, incoming: DataFrame, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) after an idempotent upsert of incoming (url, text, at; one row for each url).

    sources: url, content_hash, status, touched. An indexed source of the same text is touched only; another one is
    written anew, and its chunks (url, chunk_index, chunk_text) are replaced by those of the new text. Other sources
    and their chunks stay.
    """
    new = incoming.select("url", "text", "at", content_hash(F.col("text")).alias("new_hash"))
    met = sources.join(new, "url", "full")
    same = (F.col("content_hash") == F.col("new_hash")) & (F.col("status") == "indexed")
    rewritten = F.col("new_hash").isNotNull() & ~F.coalesce(same, F.lit(False))
    after = met.select("url", F.when(rewritten, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(rewritten, "indexed").otherwise(F.col("status")).alias("status"), F.coalesce("at", "touched").alias("touched"))
    gone = met.where(rewritten).select("url", "text")
    cut = chunked(gone.withColumnRenamed("url", "doc_id"), size, overlap).select(F.col("doc_id").alias("url"), "chunk_index", "chunk_text")
    return after, chunks.join(gone, "url", "left_anti").select("url", "chunk_index", "chunk_text").unionByName(cut)


def reclassified(ledger: DataFrame, slow: Column) -> DataFrame:
    """The ledger (url, frequency, first_seen, last_changed) with monthly crawls where ``slow`` holds, and the first
    sight in place of an unknown last change."""
    return ledger.withColumn("frequency", F.when(slow, "monthly").otherwise(F.col("frequency"))).withColumn("last_changed", F.coalesce("last_changed", "first_seen"))


def cascaded_delete(sources: DataFrame, children: list[tuple[DataFrame, str]], doomed: Column, key: str) -> list[DataFrame]:
    """[sources, children...] without the sources for which ``doomed`` holds and without what hangs on them; each child
    is (table, its key column), and hangs on the table before it by ``key`` of that table."""
    out, gone = [sources.where(~F.coalesce(doomed, F.lit(False)))], sources.where(doomed).select(F.col(key).alias("_gone"))
    for table, column in children:
        out.append(table.join(gone, F.col(column) == F.col("_gone"), "left_anti"))
        own = table.columns[0]
        gone = table.join(gone, F.col(column) == F.col("_gone"), "left_semi").select(F.col(own).alias("_gone"))
    return out


def excluded(sources: DataFrame, chunks: DataFrame, unsafe: Column) -> DataFrame:
    """Sources (source_id, status, ...) whose status is ``excluded`` where they are indexed and unsafe, or indexed
    without a chunk (source_id)."""
    held = chunks.select("source_id").distinct().withColumn("_held", F.lit(True))
    indexed = F.col("status") == "indexed"
    drop = indexed & (F.coalesce(unsafe, F.lit(False)) | F.col("_held").isNull())
    return sources.join(held, "source_id", "left").withColumn("status", F.when(drop, "excluded").otherwise(F.col("status"))).drop("_held")


def pending(rows: DataFrame) -> DataFrame:
    """Rows (allowed, state) that may be read and are neither indexed nor at an end."""
    return rows.where(F.coalesce("allowed", F.lit(False)) & ~F.coalesce("state", F.lit("new")).isin("indexed", "terminal", "exhausted"))


def failure_reason(status: Column, empty: Column, attempts: Column, most: int = 3) -> Column:
    """Why a page is not indexed, or ``none``: its answer, an empty body, too many attempts."""
    return first_rule([("not_found", status.isin(404, 410)), ("forbidden", status.isin(401, 403)), ("retries_exhausted", (status >= 500) & (attempts >= most)), ("retryable", status >= 500), ("empty_page", empty)], "none")


def worth_indexing(text: Column, confidence: Column, least: int) -> Column:
    return (F.char_length(F.trim(text)) >= least) & (F.coalesce(confidence, F.lit(0.0)) > 0)


def validated_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """(…, problem): null for a vector (embedding) of ``dimension`` numbers, all of them finite; else what is wrong."""
    size, bad = F.size("embedding"), F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.withColumn("problem", F.when(F.col("embedding").isNull(), "missing").when(size != dimension, "dimension").when(bad, "not_finite"))


def stored_vectors(store: DataFrame, batch: DataFrame, dimension: int) -> DataFrame:
    """The store (chunk_id, profile, embedding) after an upsert of the valid vectors of a batch, one for each chunk and
    profile: of several, the greatest version wins."""
    good = validated_vectors(batch, dimension).where("problem IS NULL")
    last = good.groupBy("chunk_id", "profile").agg(F.max_by("embedding", "version").alias("embedding"))
    return last.unionByName(store.join(last, ["chunk_id", "profile"], "left_anti").select("chunk_id", "profile", "embedding"))


def missing_vectors(chunks: DataFrame, store: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Chunks (chunk_id) that the store (chunk_id and the keys of ``wanted``) has under no such profile, provider,
    model, dimension and version."""
    held = store
    for column, value in wanted.items():
        held = held.where(F.col(column) == F.lit(value))
    return chunks.join(held.select("chunk_id"), "chunk_id", "left_anti")


def backfilled(chunks: DataFrame, store: DataFrame, wanted: Mapping[str, object], embed: Callable[[Column], Column]) -> DataFrame:
    """Vectors (chunk_id, the keys of ``wanted``, embedding) of the chunks (chunk_id, chunk_text) that lack them, by an
    embedder that is given as a function of columns: a built-in expression or an Arrow function of a model."""
    lacking = missing_vectors(chunks, store, wanted)
    return lacking.select("chunk_id", *[F.lit(v).alias(k) for k, v in wanted.items()], embed(F.col("chunk_text")).alias("embedding"))


def batched(rows: DataFrame, size: int, key: str) -> DataFrame:
    """Adds ``batch``: rows in blocks of about ``size`` by a hash of their key, so that no order over all is needed."""
    n = F.greatest(F.ceil(F.col("_n") / size), F.lit(1))
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n")))).withColumn("batch", F.pmod(F.xxhash64(key), n)).drop("_n")  # one row is broadcast


def candidate_decision(rows: DataFrame, least_words: int = 40, least_relevance: float = 0.6) -> DataFrame:
    """Adds ``decision`` to web results (trusted, relevance, n_words, known): why one is not ingested, or ``ingest``."""
    rules = [("untrusted", ~F.coalesce("trusted", F.lit(False))), ("low_relevance", F.coalesce("relevance", F.lit(0.0)) < least_relevance), ("too_short", F.col("n_words") < least_words), ("known", F.coalesce("known", F.lit(False)))]
    return rows.withColumn("decision", first_rule(rules, "ingest"))


def official_gate(rows: DataFrame, least_words: int = 25) -> DataFrame:
    """(type, outcome, n) of pages (scope, tier, content_type, n_words): scope before authority tier (1 to 5, 5 being
    none), type of content and length."""
    rules = [("out_of_scope", F.col("scope") != "allowed"), ("low_authority", F.col("tier") >= 5), ("unknown_type", F.col("content_type") == "unknown"), ("too_short", F.col("n_words") < least_words)]
    return rows.withColumn("outcome", first_rule(rules, "ingested")).groupBy(F.col("content_type").alias("type"), "outcome").agg(F.count("*").alias("n"))


def authority_tier(name: Column, tiers: Mapping[str, int], default: int = 5) -> Column:
    """The tier of a host by the first part of its name that is listed."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(k)), F.lit(v)) for k, v in tiers.items()], F.lit(default))


def indexed_assets(segments: DataFrame, size: int, overlap: int) -> DataFrame:
    """(url, segment_index, chunk_index, chunk_text) of assets' segments (url, segment_index, text), each chunked by
    itself, so that a chunk keeps its segment's place."""
    keyed = segments.select(F.struct("url", "segment_index").alias("doc_id"), "text")
    return chunked(keyed, size, overlap).select("doc_id.url", "doc_id.segment_index", "chunk_index", "chunk_text")


def first_matches(left: DataFrame, right: DataFrame, key: str, *order: Column) -> DataFrame:
    """left with the first of right's rows of its key, if there is one: the other side is made unique before the join."""
    one = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return left.join(one, key, "left")


def limited_matches(left: DataFrame, right: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """left with up to ``most`` of right's rows of its key."""
    few = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return left.join(few, key)


def text_mentions(names: DataFrame, texts: DataFrame, also: str, most: int) -> DataFrame:
    """(name, doc_id): up to ``most`` texts (doc_id, text) that hold a name (name) of one or more words, in any case,
    and the word ``also``; the first by id. A text is looked up by the first word of a name, which it must have."""
    held = texts.select("doc_id", tokens(F.col("text")).alias("w")).where(F.array_contains("w", also))
    wanted = names.select("name", tokens(F.col("name")).alias("words")).where(F.size("words") > 0).distinct()
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    met = held.select("doc_id", F.explode(F.array_distinct("w")).alias("first")).join(wanted.withColumn("first", F.col("words")[0]), "first")
    met = met.join(held.select("doc_id", spaced(F.col("w")).alias("line")), "doc_id").where(F.contains("line", spaced(F.col("words"))))
    place = Window.partitionBy("name").orderBy("doc_id")
    return met.select("name", "doc_id").distinct().withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).drop("n")


def accepted_scores(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """Adds ``score``, which falls from .5 by .03 with every row accepted before, down to .2."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("score", F.round(F.greatest(F.lit(0.2), 0.5 - 0.03 * place), 6))


def without_repeated_lines(text: Column) -> Column:
    """A line that equals the one before it is left out."""
    lines = F.split(text, "\n")
    before = F.concat(F.array(F.lit(None).cast("string")), lines)
    return F.array_join(F.filter(F.zip_with(lines, before, lambda x, y: F.when(~x.eqNullSafe(y), x)), F.isnotnull), "\n")


def hosts_of(parts: Sequence[DataFrame], root: str) -> DataFrame:
    """(host, place): the distinct hosts of all parts (host), the root first, the others by name."""
    every = reduce(DataFrame.unionByName, [p.select("host") for p in parts]).where("host <> ''").distinct()
    return every.withColumn("place", F.when(F.col("host") == root, 0).otherwise(1))


def known_markers(markers: Column, valid: Column) -> Column:
    """Whether all citation markers are valid ids."""
    return F.size(F.array_except(markers, valid)) == 0


def refresh_due(n_messages: Column, every: int) -> Column:
    """Whether a conversation's summary is to be made anew after a message."""
    return (n_messages > 0) & (n_messages % every == 0)


def recent_counts(events: DataFrame, at: str, as_of: str, days: Sequence[int]) -> DataFrame:
    """One row: how many events lie in the last so many days before ``as_of``."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    return events.agg(*[F.count_if((age >= 0) & (age < d * 86400)).alias(f"last_{d}d") for d in days])


def alive(created: Column, ttl: int, as_of: str) -> Column:
    """Whether an entry of ``ttl`` seconds is still valid."""
    return F.coalesce(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(created.cast("timestamp")) < ttl, F.lit(False))


_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def http_date(at: Column) -> Column:
    """A time as HTTP writes it."""
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def from_http_date(text: Column) -> Column:
    """The time of an HTTP date; null for anything else."""
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.regexp_extract(text, r"^[A-Za-z]{3}, [0-9]{2} ([A-Za-z]{3}) ", 1))
    part = lambda i: F.regexp_extract(text, r"^[A-Za-z]{3}, ([0-9]{2}) [A-Za-z]{3} ([0-9]{4}) ([0-9:]{8}) GMT$", i)
    return F.try_to_timestamp(F.concat(part(2), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), part(1), F.lit(" "), part(3)), F.lit("yyyy-MM-dd HH:mm:ss"))


def fanned_out(rows: DataFrame, column: str, kind: str, keys: Sequence[str]) -> DataFrame:
    """The rows of a JSON list (``kind``: its type) in a column, each with the keys of the row that holds it; a list that
    is null or no JSON gives none."""
    return rows.select(*keys, F.inline(F.from_json(column, kind)))
