"""Queries of stores: upserts, cascades, states, vectors, candidates, joins of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import stores as S
from gleanery.operators.ingest import content_hash
from gleanery.plans.common import AS_OF, Family, read, sql_text

FAMILY = Family()
query = FAMILY.query
_WORDS = f"regexp_extract_all(lower(text), {sql_text(T.TOKENIZERS['word'])})"


# sources of all languages but one are known, by the hash of a text in which one ending was another; one source brings nothing
_UPSERT = """d AS (SELECT 'd' || doc_id AS url, text, lang = 'es' AS unknown, source = 'src3' AS silent, sha256(text) AS h, sha256(replace(text, 'tion', 'TION')) AS o FROM documents)"""


def _upserted(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("url", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    known = docs.where("lang <> 'es'")
    old = known.select("url", content_hash(F.replace("text", F.lit("tion"), F.lit("TION"))).alias("content_hash"), F.lit("indexed").alias("status"), F.lit(1).cast("long").alias("touched"))
    new = docs.where("source <> 'src3'").select("url", "text", F.lit(2).cast("long").alias("at"))
    return old, S.upserted_sources(old, known.select("url", F.lit(0).alias("chunk_index"), F.lit("old").alias("chunk_text")), new, 300, 50)


@query(f"""WITH {_UPSERT} SELECT url, CASE WHEN silent THEN o ELSE h END AS content_hash, CASE WHEN unknown THEN 'new' WHEN silent THEN 'kept' WHEN o = h THEN 'same' ELSE 'changed' END AS action, CASE WHEN silent THEN 1 ELSE 2 END::BIGINT AS touched FROM d WHERE NOT (unknown AND silent)""")
def source_upsert(spark, sf_dir):
    """Sources after an upsert, told by what has become of their text."""
    old, (after, _) = _upserted(spark, sf_dir)
    met = after.join(old.select("url", F.col("content_hash").alias("before")), "url", "left")
    action = F.when(F.col("before").isNull(), "new").when(F.col("touched") == 1, "kept").when(F.col("before") == F.col("content_hash"), "same").otherwise("changed")
    return met.select("url", "content_hash", action.alias("action"), "touched")


@query(f"""WITH {_UPSERT} SELECT url, CASE WHEN NOT unknown AND (silent OR o = h) THEN 1 WHEN n <= 300 THEN 1 ELSE ceil((n - 300) / 250.0) + 1 END::BIGINT AS n_chunks FROM (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS n FROM d WHERE NOT (unknown AND silent)) WHERE n > 0 OR NOT unknown AND (silent OR o = h)""")
def source_upsert_chunks(spark, sf_dir):
    """Chunks after the same upsert: replaced for new and changed texts, kept for the others."""
    _, (_, chunks) = _upserted(spark, sf_dir)
    return chunks.groupBy("url").agg(F.count("*").alias("n_chunks"))


@query("""SELECT page_id, CASE WHEN contains(url, 'blog') THEN 'monthly' ELSE 'weekly' END AS frequency, coalesce(CASE WHEN page_id % 3 <> 0 THEN page_id END, page_id + 7) AS last_changed FROM pages""")
def ledger_reclassified(spark, sf_dir):
    i = F.col("page_id")
    ledger = read(spark, sf_dir, "pages").select("page_id", "url", F.lit("weekly").alias("frequency"), (i + 7).alias("first_seen"), F.when(i % 3 != 0, i).alias("last_changed"))
    return S.reclassified(ledger, F.contains("url", F.lit("blog"))).select("page_id", "frequency", "last_changed")


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)), d AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT 'customers' AS kind, count(*) AS n FROM customer WHERE c_mktsegment NOT LIKE 'B%' UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'items', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM d)""")
def cascaded_delete(spark, sf_dir):
    customer, orders, items = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    left = S.cascaded_delete(customer.select("c_custkey", "c_mktsegment"), [(orders.select("o_orderkey", "o_custkey"), "o_custkey"), (items.select("l_linenumber", "l_orderkey"), "l_orderkey")], F.col("c_mktsegment").like("B%"), "c_custkey")
    out = [f.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, f in zip(("customers", "orders", "items"), left, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT c_custkey AS source_id, CASE WHEN c_nationkey % 5 <> 0 AND (c_mktsegment = 'BUILDING' OR c_custkey NOT IN (SELECT o_custkey FROM orders)) THEN 'excluded' WHEN c_nationkey % 5 <> 0 THEN 'indexed' ELSE 'pending' END AS status FROM customer""")
def excluded_sources(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_nationkey") % 5 != 0, "indexed").otherwise("pending").alias("status"), "c_mktsegment")
    return S.excluded(c, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id")), F.col("c_mktsegment") == "BUILDING").select("source_id", "status")


@query("""SELECT page_id, CASE WHEN st IN (404, 410) THEN 'not_found' WHEN st IN (401, 403) THEN 'forbidden' WHEN st >= 500 AND page_id % 5 >= 3 THEN 'retries_exhausted' WHEN st >= 500 THEN 'retryable' WHEN e THEN 'empty_page' ELSE 'none' END AS reason,
page_id % 2 = 0 AND page_id % 3 <> 0 AS pending, length(trim(html)) >= 5000 AND page_id % 4 > 0 AS worth FROM (SELECT *, [200, 404, 403, 500, 200, 410, 503][page_id % 7 + 1] AS st, page_id % 7 = 4 AS e FROM pages)""")
def index_failures(spark, sf_dir):
    i = F.col("page_id")
    status = F.get(F.array(*[F.lit(x) for x in (200, 404, 403, 500, 200, 410, 503)]), (i % 7).cast("int"))
    rows = read(spark, sf_dir, "pages").withColumns({"allowed": i % 2 == 0, "state": F.when(i % 3 == 0, "indexed").otherwise("retryable")})
    waiting = S.pending(rows).select("page_id", F.lit(True).alias("p"))
    told = rows.join(waiting, "page_id", "left")
    return told.select("page_id", S.failure_reason(status, i % 7 == 4, i % 5).alias("reason"), F.coalesce("p", F.lit(False)).alias("pending"), S.worth_indexing(F.col("html"), (i % 4).cast("double"), 5000).alias("worth"))


@query("""SELECT chunk_id, profile, round(first, 6)::DOUBLE AS first FROM (SELECT vec_id AS chunk_id, 'a' AS profile, embedding[1]::DOUBLE + CASE WHEN vec_id % 3 = 0 AND vec_id % 5 <> 0 THEN 1 ELSE 0 END AS first FROM embeddings)""")
def vector_store_upsert(spark, sf_dir):
    """A store after a batch in which every fifth vector is cut and comes to nothing."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("a").alias("profile"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    moved = F.transform("embedding", lambda x, i: F.when(i == 0, x + 1).otherwise(x))
    batch = e.where("chunk_id % 3 = 0").select("chunk_id", "profile", F.when(F.col("chunk_id") % 5 == 0, F.slice("embedding", 1, 3)).otherwise(moved).alias("embedding"), F.lit(2).alias("version"))
    size = e.select(F.size("embedding")).first()[0]
    return S.stored_vectors(e, batch, size).select("chunk_id", "profile", F.round(F.col("embedding")[0], 6).alias("first"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0 AND label % 3 = 1)")
def vectors_missing(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 2).alias("profile"), (F.col("label") % 3).alias("model"))
    return S.missing_vectors(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), e, {"profile": 0, "model": 1}).select(F.col("chunk_id").alias("doc_id"))


@query(f"""SELECT doc_id, CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'untrusted' WHEN (doc_id % 10) / 10.0 < 0.6 THEN 'low_relevance' WHEN len({_WORDS}) < 40 THEN 'too_short' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'known' ELSE 'ingest' END AS decision FROM documents""")
def ingest_candidates(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    rows = docs.select("doc_id", F.col("source").isin("src0", "src1", "src2").alias("trusted"), ((F.col("doc_id") % 10) / 10.0).alias("relevance"), F.size(T.tokens(F.col("text"))).alias("n_words"), "known")
    return S.candidate_decision(rows).select("doc_id", "decision")


@query("""WITH p AS (SELECT page_id, url, CASE WHEN contains(url, 'm.') THEN 2 WHEN contains(url, 'blog.') THEN 4 ELSE 5 END AS tier, CASE WHEN page_id % 4 = 0 THEN 'unknown' ELSE 'html' END AS type, CASE WHEN page_id % 6 = 0 THEN 'outside' ELSE 'allowed' END AS scope, page_id % 50 AS n FROM pages)
SELECT type, CASE WHEN scope <> 'allowed' THEN 'out_of_scope' WHEN tier >= 5 THEN 'low_authority' WHEN type = 'unknown' THEN 'unknown_type' WHEN n < 25 THEN 'too_short' ELSE 'ingested' END AS outcome, count(*) AS n FROM p GROUP BY 1, 2""")
def official_gate(spark, sf_dir):
    i = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select(S.authority_tier(F.col("url"), {"m.": 2, "blog.": 4}).alias("tier"), F.when(i % 4 == 0, "unknown").otherwise("html").alias("content_type"), F.when(i % 6 == 0, "outside").otherwise("allowed").alias("scope"), (i % 50).alias("n_words"))
    return S.official_gate(rows)


@query("""SELECT conv_id, turn, CASE WHEN n <= 20 THEN 1 ELSE ceil((n - 20) / 15.0) + 1 END::BIGINT AS n_chunks FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS n FROM conversations) WHERE n > 0""")
def asset_chunks(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("url"), F.col("turn").alias("segment_index"), "text")
    return S.indexed_assets(said, 20, 5).groupBy(F.col("url").alias("conv_id"), F.col("segment_index").alias("turn")).agg(F.count("*").alias("n_chunks"))


@query("""SELECT n_nationkey, n_name, s_name FROM nation LEFT JOIN (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS i FROM supplier) ON s_nationkey = n_nationkey AND i = 1""")
def first_contact(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name", "s_acctbal", "s_suppkey")
    return S.first_matches(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), suppliers, "n_nationkey", F.desc("s_acctbal"), F.col("s_suppkey")).select("n_nationkey", "n_name", "s_name")


@query("""SELECT n_nationkey, c_custkey FROM nation JOIN (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) ON c_nationkey = n_nationkey AND i <= 3""")
def limited_contacts(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return S.limited_matches(read(spark, sf_dir, "nation").select("n_nationkey"), customers, "n_nationkey", 3, F.col("c_custkey"))


_NAMES = ["of the", "license", "und", "permission notice"]


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT unnest({_NAMES}) AS name),
m AS (SELECT name, doc_id FROM d, n WHERE list_contains(w, 'the') AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || name || ' '))
SELECT name, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS i FROM m) WHERE i <= 20""")
def names_in_texts(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return S.text_mentions(names, read(spark, sf_dir, "documents"), "the", 20)


@query("""SELECT c_mktsegment, c_custkey, round(greatest(0.2, 0.5 - 0.03 * (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1)), 6)::DOUBLE AS score FROM customer""")
def accepted_scores(spark, sf_dir):
    return S.accepted_scores(read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], F.col("c_custkey"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


@query(f"""SELECT host, CASE WHEN host = 'www.example.com' THEN 0 ELSE 1 END AS place FROM (SELECT {_HOST} AS host FROM pages WHERE starts_with(url, 'https:') UNION SELECT {_HOST} FROM pages WHERE NOT starts_with(url, 'https:') UNION SELECT 'www.example.com' UNION SELECT source FROM documents) WHERE host <> ''""")
def distinct_hosts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("url", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)).alias("host"))
    safe = F.startswith("url", F.lit("https:"))
    root = spark.createDataFrame([("www.example.com",)], "host string")
    return S.hosts_of([pages.where(safe), pages.where(~safe), root, read(spark, sf_dir, "documents").select(F.col("source").alias("host"))], "www.example.com")


@query("""SELECT o_custkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS kinds FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING bool_and(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))""")
def known_markers(spark, sf_dir):
    """Customers all of whose closed orders have a known priority: a subset test."""
    by = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_set("o_orderpriority").alias("k"))
    valid = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))
    return by.where(S.known_markers(F.col("k"), valid)).select("o_custkey", "n", F.array_join(F.array_sort("k"), ",").alias("kinds"))


@query("""SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels""")
def unfinished_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").exceptAll(read(spark, sf_dir, "labels").select("doc_id"))


@query("""SELECT conv_id, count(*) AS n, count(*) > 0 AND count(*) % 4 = 0 AS refresh FROM conversations GROUP BY 1""")
def memory_refresh(spark, sf_dir):
    by = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return by.withColumn("refresh", S.refresh_due(F.col("n"), 4))


@query("""SELECT count(*) FILTER (a >= 0 AND a < 86400) AS last_1d, count(*) FILTER (a >= 0 AND a < 7 * 86400) AS last_7d, count(*) FILTER (a >= 0 AND a < 30 * 86400) AS last_30d FROM (SELECT epoch(TIMESTAMP '2024-01-25') - floor(epoch(ts)) AS a FROM events)""")
def recent_windows(spark, sf_dir):
    return S.recent_counts(read(spark, sf_dir, "events"), "ts", "2024-01-25 00:00:00", [1, 7, 30])


@query(f"""SELECT o_orderkey, coalesce(epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate::TIMESTAMP) < 86400 * 2000, false) AS alive, strftime(o_orderdate::TIMESTAMP, '%a, %d %b %Y %H:%M:%S GMT') AS http, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS back FROM orders""")
def ttl_and_http_dates(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", S.alive(at, 86400 * 2000, AS_OF).alias("alive"), S.http_date(at).alias("http"))
    return rows.withColumn("back", F.date_format(S.from_http_date(F.col("http")), "yyyy-MM-dd HH:mm:ss"))


@query("SELECT n_nationkey, n_name, u.kind AS kind, u.url AS url FROM (SELECT n_nationkey, n_name, unnest([{'kind': 'home', 'url': 'https://' || lower(n_name) || '.example/'}, {'kind': 'map', 'url': 'https://maps.example/' || n_nationkey}]) AS u FROM nation)")
def keyed_fanout(spark, sf_dir):
    """One JSON list of each row as rows."""
    nation = read(spark, sf_dir, "nation")
    listed = F.to_json(F.array(F.struct(F.lit("home").alias("kind"), F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/")).alias("url")), F.struct(F.lit("map").alias("kind"), F.concat(F.lit("https://maps.example/"), F.col("n_nationkey").cast("string")).alias("url"))))
    return S.fanned_out(nation.withColumn("listed", listed), "listed", "array<struct<kind: string, url: string>>", ["n_nationkey", "n_name"])


@query("""SELECT n_nationkey, c_custkey, c_acctbal FROM (SELECT n_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS i FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE i <= 20""")
def recent_memories(spark, sf_dir):
    """Up to twenty of each group by importance, then by age."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")
    return S.limited_matches(read(spark, sf_dir, "nation").select("n_nationkey"), c, "n_nationkey", 20, F.desc("c_acctbal"), F.desc("c_custkey"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS state FROM orders")
def cards_with_dates(spark, sf_dir):
    """Source cards with what is known of their URL; others stay without."""
    orders = read(spark, sf_dir, "orders")
    known = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state"))
    return orders.select("o_orderkey").join(known, "o_orderkey", "left")
