"""Ingestion: chunking, idempotent merges of snapshots, crawl ledgers, gates. A table is never changed in place: every
operator returns the new snapshot, or the plan of changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import TOKENIZERS, chunks


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def chunked(docs: DataFrame, size: int, overlap: int, least: int = 1, title: str | None = None) -> DataFrame:
    """(doc_id, chunk_index, n_words, chunk_text): windows of the text's words, those of ``least`` words or more, each
    after the document's title if a column is named. A window of fewer words than the overlap joins the one before it
    with its words repeated, as it would stand alone otherwise."""
    words = docs.withColumn("w", F.regexp_extract_all(F.col("text"), F.lit(TOKENIZERS["unspaced"]), F.lit(0))).where(F.size("w") > 0)
    windows = chunks(F.col("w"), size, overlap)
    short = (F.size(windows) > 1) & (F.size(F.element_at(windows, -1)) < least)
    last = F.size(windows)
    merged = F.when(short, F.concat(F.slice(windows, 1, last - 2), F.array(F.concat(F.element_at(windows, -2), F.element_at(windows, -1))))).otherwise(windows)
    cut = words.select("doc_id", *([title] if title else []), F.posexplode(merged).alias("chunk_index", "c")).where((F.size("c") >= least) | (F.col("chunk_index") == 0))
    body = F.array_join("c", " ")
    return cut.select("doc_id", "chunk_index", F.size("c").alias("n_words"), (F.concat(F.col(title), F.lit("\n"), body) if title else body).alias("chunk_text"))


def segment_chunks(segments: DataFrame, size: int = 900, overlap: int = 120, least: int = 25, pages: tuple[int, int] = (700, 1000)) -> DataFrame:
    """(all columns but text, chunk_index, n_words, chunk_text) of segments (text, source_type, title, heading and any
    others that tell where they stand): windows of ``size`` words, for HTML (and where the type is null) within
    ``pages``, that overlap by so many. A last window of fewer than ``least`` words goes to the one before it. A chunk
    begins with the title and heading unless its text does. Segments of fewer than ``least`` words give none."""
    own = [c for c in segments.columns if c not in ("text", "chunk_index", "n_words", "chunk_text")]
    html = F.coalesce("source_type", F.lit("html")) == "html"
    wide = F.when(html, min(max(size, pages[0]), pages[1])).otherwise(size)
    step = F.greatest(wide - overlap, F.lit(1))
    took = segments.withColumn("_w", F.regexp_extract_all("text", F.lit(TOKENIZERS["unspaced"]), F.lit(0))).where(F.size("_w") >= least)
    n = F.size("_w")
    count = F.when(n <= wide, 1).otherwise(F.ceil((n - wide) / step) + 1).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("_w", i * step + 1, wide))
    tail = (F.size(windows) > 1) & (F.size(F.element_at(windows, -1)) < least)
    merged_ = F.when(tail, F.concat(F.slice(windows, 1, F.size(windows) - 2), F.array(F.concat(F.element_at(windows, -2), F.element_at(windows, -1))))).otherwise(windows)
    cut = took.select(*own, F.posexplode(merged_).alias("chunk_index", "_c"))
    body, before = F.array_join("_c", " "), F.concat_ws(" - ", F.nullif("title", F.lit("")), F.nullif("heading", F.lit("")))
    return cut.select(*own, "chunk_index", F.size("_c").alias("n_words"), F.when((before == "") | F.startswith(body, before), body).otherwise(F.concat(before, F.lit("\n"), body)).alias("chunk_text"))


def upsert_plan(current: DataFrame, incoming: DataFrame, key: str, hashed: str) -> DataFrame:
    """(key, action): insert, touch (same content), replace, keep (not in the incoming rows)."""
    met = current.select(key, F.col(hashed).alias("old")).join(incoming.select(key, F.col(hashed).alias("new")), key, "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").when(F.col("old") == F.col("new"), "touch").otherwise("replace")
    return met.select(key, action.alias("action"))


def merged(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The snapshot after an upsert: incoming rows, one of each key (of several, the greatest), and current rows of
    other keys."""
    incoming = incoming.groupBy(key).agg(F.max(F.struct(*[c for c in incoming.columns if c != key])).alias("_row")).select(key, "_row.*")
    return incoming.unionByName(current.join(incoming.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def insert_ignore(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The snapshot after adding the rows of new keys, one for each."""
    return current.unionByName(incoming.dropDuplicates([key]).join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def changed(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, old, new): values that differ, null-safe, between two snapshots."""
    met = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    pairs = F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("string").alias("old"), F.col(f"b_{c}").cast("string").alias("new"))) for c in columns])
    return met.select(key, F.explode(F.filter(pairs, F.isnotnull)).alias("d")).select(key, "d.*")


def detected_change(known_hash: Column, new_hash: Column, known_time: Column, new_time: Column) -> Column:
    """new, hash_changed, last_modified_changed or unchanged."""
    return F.when(known_hash.isNull(), "new").when(new_hash.isNotNull() & (new_hash != known_hash), "hash_changed").when(new_hash.isNull() & new_time.isNotNull() & (known_time.isNull() | (new_time > known_time)), "last_modified_changed").otherwise("unchanged")


#: Seconds between crawls by frequency; other frequencies count as weekly.
CADENCE = {"daily": 86400, "weekly": 7 * 86400, "monthly": 30 * 86400}


def is_due(last_crawl: Column, frequency: Column, as_of: str) -> Column:
    """Never crawled, or not for the time of its frequency."""
    wait = F.coalesce(F.create_map(*[F.lit(x) for kv in CADENCE.items() for x in kv])[frequency], F.lit(CADENCE["weekly"]))
    return last_crawl.isNull() | (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(last_crawl.cast("timestamp")) >= wait)


def recorded(ledger: DataFrame, fetches: DataFrame) -> DataFrame:
    """The ledger (url, content_hash, last_crawl, last_changed, failures) after fetches (url, ok, new_hash, at); of
    several fetches of a URL the last one counts."""
    fetches = fetches.groupBy("url").agg(F.max(F.struct("at", "ok", "new_hash")).alias("f")).select("url", "f.*")
    met = ledger.join(fetches, "url", "full")
    changes = F.col("ok") & ~F.col("new_hash").eqNullSafe(F.col("content_hash"))
    tried = F.col("ok").isNotNull()
    return met.select(
        "url",
        F.when(changes, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(tried, F.col("at")).otherwise(F.col("last_crawl")).alias("last_crawl"),
        F.when(changes, F.col("at")).otherwise(F.col("last_changed")).alias("last_changed"),
        F.when(F.col("ok"), 0).when(tried, F.coalesce("failures", F.lit(0)) + 1).otherwise(F.coalesce("failures", F.lit(0))).alias("failures"),
    )


def ladder(*rungs: tuple[Column, str], default: str) -> Column:
    """The reason of the first rung that holds."""
    return F.coalesce(*[F.when(holds, F.lit(reason)) for holds, reason in rungs], F.lit(default))


def pruned_metadata(meta: Column, keep: list[str]) -> Column:
    """A map without the keys that are not to be kept."""
    return F.map_filter(meta, lambda k, v: k.isin(keep))


def next_state(state: Column, event: Column, attempts: Column, most: int = 3) -> tuple[Column, Column]:
    """(state, attempts) after an event: ok indexes, a terminal error ends, another one retries up to ``most`` times."""
    tried = attempts + 1
    failed = F.when(tried >= most, "exhausted").otherwise("retryable")
    return F.when(event == "ok", "indexed").when(event == "gone", "terminal").when(event == "error", failed).otherwise(state), F.when(event.isin("ok", "gone", "error"), tried).otherwise(attempts)


def hints_merged(hints: DataFrame) -> DataFrame:
    """One row for each url of hints (url, pos, source, title, score): the first source, the first title that is not
    null, the best score."""
    return hints.groupBy("url").agg(F.min_by("source", "pos").alias("source"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("pos"))).alias("title"), F.max("score").alias("score"))


def enriched(entities: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fills what is empty in entities from found; confidence is the greater of the two."""
    met = entities.join(found.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.col("confidence").alias("_confidence")), key, "left")
    return met.select(key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) for c in columns], F.greatest("confidence", "_confidence").alias("confidence"))


def canonical_registry(parts: list[tuple[str, DataFrame]], existing: DataFrame) -> DataFrame:
    """New rows (kind, name, url) of all parts (name, urls: array) that the registry does not have."""
    every = reduce(DataFrame.unionByName, [p.select(F.lit(kind).alias("kind"), "name", F.explode("urls").alias("url")) for kind, p in parts])
    return every.distinct().join(existing, ["kind", "name", "url"], "left_anti")


def concatenated(contexts: DataFrame) -> DataFrame:
    """(url, n_texts, text): the distinct texts of contexts (url, pos, text), joined in their order."""
    first = contexts.groupBy("url", "text").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return listed.select("url", F.size("t").alias("n_texts"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
