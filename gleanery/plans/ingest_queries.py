"""Queries of ingestion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import ingest as I
from gleanery.plans.common import Family, read, sql_text

FAMILY = Family()
query = FAMILY.query

_W = f"regexp_extract_all(text, {sql_text(T.TOKENIZERS['unspaced'])})"


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(generate_series(0, CASE WHEN len(w) <= 200 THEN 0 ELSE CAST(ceil((len(w) - 200) / 160.0) AS BIGINT) END)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(len(list_slice(w, i * 160 + 1, i * 160 + 200)) AS INTEGER) AS n_words, sha256(array_to_string(list_slice(w, i * 160 + 1, i * 160 + 200), ' ')) AS chunk_sha256 FROM c""")
def ingest_chunks(spark, sf_dir):
    return I.chunked(read(spark, sf_dir, "documents"), 200, 40).select("doc_id", "chunk_index", "n_words", I.content_hash(F.col("chunk_text")).alias("chunk_sha256"))


@query(f"""WITH s AS (SELECT doc_id, lang AS title, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS heading, CASE WHEN n_chars > 9000 THEN 'pdf' WHEN lang <> 'fr' THEN 'html' END AS source_type, {_W} AS w FROM documents),
z AS (SELECT *, CASE WHEN coalesce(source_type, 'html') = 'html' THEN 700 ELSE 300 END AS size FROM s WHERE len(w) >= 25),
c AS (SELECT *, unnest(generate_series(0, CASE WHEN len(w) <= size THEN 0 ELSE CAST(ceil((len(w) - size) / (size - 120)::DOUBLE) AS BIGINT) END)) AS i FROM z),
d AS (SELECT *, list_slice(w, i * (size - 120) + 1, i * (size - 120) + size) AS x, max(i) OVER (PARTITION BY doc_id) AS last FROM c),
e AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM d), f AS (SELECT *, CASE WHEN i = last - 1 AND len(next) < 25 THEN x || next ELSE x END AS y FROM e WHERE i = 0 OR len(x) >= 25),
g AS (SELECT *, array_to_string(y, ' ') AS body, title || CASE WHEN heading = '' THEN '' ELSE ' - ' || heading END AS before FROM f)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(len(y) AS INTEGER) AS n_words, sha256(CASE WHEN starts_with(body, before) THEN body ELSE before || chr(10) || body END) AS chunk_sha256 FROM g""")
def segment_chunks(spark, sf_dir):
    """Chunks with their titles, by the kind of source; short tails go to the chunk before them."""
    kind = F.when(F.col("n_chars") > 9000, "pdf").when(F.col("lang") != "fr", "html")
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("heading"), kind.alias("source_type"))
    return I.segment_chunks(rows, 300, 120).select("doc_id", "chunk_index", "n_words", I.content_hash(F.col("chunk_text")).alias("chunk_sha256"))


@query("SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def ingest_hash_dedup(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(I.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")


# the snapshot before: without a tenth of the documents, another tenth with other contents
_BEFORE = "SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 0"
_AFTER = "SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 2"


def _snapshots(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    before = docs.where("doc_id % 10 <> 0").select("doc_id", I.content_hash(F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return before, docs.where("doc_id % 10 <> 2").select("doc_id", I.content_hash(F.col("text")).alias("h"))


@query(f"SELECT doc_id, CASE WHEN a.h IS NULL THEN 'insert' WHEN b.h IS NULL THEN 'keep' WHEN a.h = b.h THEN 'touch' ELSE 'replace' END AS action FROM ({_BEFORE}) a FULL JOIN ({_AFTER}) b USING (doc_id)")
def ingest_upsert_plan(spark, sf_dir):
    return I.upsert_plan(*_snapshots(spark, sf_dir), "doc_id", "h")


@query(f"SELECT doc_id, coalesce(b.h, a.h) AS h FROM ({_BEFORE}) a FULL JOIN ({_AFTER}) b USING (doc_id)")
def ingest_merge(spark, sf_dir):
    return I.merged(*_snapshots(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, coalesce(a.h, b.h) AS h FROM ({_BEFORE}) a FULL JOIN ({_AFTER}) b USING (doc_id)")
def ingest_insert_ignore(spark, sf_dir):
    return I.insert_ignore(*_snapshots(spark, sf_dir), "doc_id")


@query("""SELECT c_custkey, 'c_mktsegment' AS "column", c_mktsegment AS old, CAST(NULL AS VARCHAR) AS new FROM customer WHERE c_custkey % 7 = 0 AND c_mktsegment IS NOT NULL
UNION ALL SELECT c_custkey, 'c_name', c_name, c_name || 'x' FROM customer WHERE c_custkey % 5 = 0""")
def ingest_changed_values(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    new = old.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))).withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")))
    return I.changed(old, new, "c_custkey", ["c_mktsegment", "c_name"])


# a ledger of orders: the last crawl of each customer, by market segment
_LEDGER = f"""SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN max(o_orderdate) END AS last_crawl,
CASE c_mktsegment WHEN 'BUILDING' THEN 'daily' WHEN 'MACHINERY' THEN 'monthly' WHEN 'AUTOMOBILE' THEN 'weekly' ELSE 'other' END AS frequency FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment"""
_DUE = "last_crawl IS NULL OR floor(epoch(TIMESTAMP '1998-08-20')) - floor(epoch(last_crawl)) >= CASE frequency WHEN 'daily' THEN 86400 WHEN 'monthly' THEN 2592000 ELSE 604800 END"


def _ledger(spark, sf_dir):
    met = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    frequency = F.when(F.col("c_mktsegment") == "BUILDING", "daily").when(F.col("c_mktsegment") == "MACHINERY", "monthly").when(F.col("c_mktsegment") == "AUTOMOBILE", "weekly").otherwise("other")
    by = met.groupBy("c_custkey", frequency.alias("frequency")).agg(F.max("o_orderdate").alias("last"))
    return by.select("c_custkey", "frequency", F.when(F.col("c_custkey") % 9 != 0, F.col("last")).alias("last_crawl"))


@query(f"SELECT c_custkey, frequency FROM ({_LEDGER}) WHERE {_DUE}")
def ledger_due(spark, sf_dir):
    return _ledger(spark, sf_dir).where(I.is_due(F.col("last_crawl"), F.col("frequency"), "1998-08-20 00:00:00")).select("c_custkey", "frequency")


@query(f"""SELECT count(*) AS urls, count(*) FILTER (last_crawl IS NULL) AS never, count(*) FILTER ({_DUE}) AS due, count(*) FILTER (frequency = 'daily') AS daily, min(last_crawl) AS oldest, max(last_crawl) AS newest FROM ({_LEDGER})""")
def ledger_registry_status(spark, sf_dir):
    due = I.is_due(F.col("last_crawl"), F.col("frequency"), "1998-08-20 00:00:00")
    return _ledger(spark, sf_dir).agg(F.count("*").alias("urls"), F.count_if(F.col("last_crawl").isNull()).alias("never"), F.count_if(due).alias("due"), F.count_if(F.col("frequency") == "daily").alias("daily"), F.min("last_crawl").alias("oldest"), F.max("last_crawl").alias("newest"))


# known are hashes of pages in which the first word of one kind was written otherwise, and times by the form of the URL
_CHANGE = """c AS (SELECT page_id, CASE WHEN length(html) % 6 > 0 THEN sha256(regexp_replace(html, 'the', 'The')) END AS known, CASE WHEN NOT contains(url, '#') THEN sha256(html) END AS new,
CASE WHEN contains(url, '?') THEN DATE '2024-01-02' WHEN length(url) % 2 = 0 THEN DATE '2024-01-01' END AS seen, CASE WHEN length(html) % 4 > 0 THEN DATE '2024-01-02' END AS told FROM pages)"""


@query(f"""WITH {_CHANGE} SELECT page_id, CASE WHEN known IS NULL THEN 'new' WHEN new <> known THEN 'hash_changed' WHEN new IS NULL AND told IS NOT NULL AND (seen IS NULL OR told > seen) THEN 'last_modified_changed' ELSE 'unchanged' END AS decision FROM c""")
def ledger_change_detection(spark, sf_dir):
    """Decisions on pages by the hashes of what is known and of what has come, and by times where there is no hash."""
    n, day = F.char_length("html"), lambda d: F.lit(f"2024-01-0{d}").cast("timestamp")
    known = F.when(n % 6 > 0, F.sha2(F.regexp_replace("html", "^((?s:.)*?)the", "$1The"), 256))
    new = F.when(~F.contains("url", F.lit("#")), F.sha2("html", 256))
    seen = F.when(F.contains("url", F.lit("?")), day(2)).when(F.char_length("url") % 2 == 0, day(1))
    return read(spark, sf_dir, "pages").select("page_id", I.detected_change(known, new, seen, F.when(n % 4 > 0, day(2))).alias("decision"))


_RECORD = """r AS (SELECT c_custkey, md5(c_name || c_mktsegment) AS known, c_acctbal > 0 AS tried, c_acctbal > 2000 AS ok, md5(c_name || replace(c_mktsegment, 'BUILDING', 'HOUSE')) AS new FROM customer)"""


@query(f"""WITH {_RECORD} SELECT c_custkey AS url, CASE WHEN changes THEN new ELSE known END AS content_hash, CASE WHEN tried THEN 2 ELSE 1 END AS last_crawl, CASE WHEN changes THEN 2 ELSE 1 END AS last_changed, CASE WHEN tried AND ok THEN 0 WHEN tried THEN 2 ELSE 1 END AS failures
FROM (SELECT *, tried AND ok AND new <> known AS changes FROM r)""")
def ledger_record(spark, sf_dir):
    """A ledger of customers, known by a digest, after fetches of some."""
    customers = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "url")
    ledger = customers.select("url", F.md5(F.concat("c_name", "c_mktsegment")).alias("content_hash"), F.lit(1).alias("last_crawl"), F.lit(1).alias("last_changed"), F.lit(1).alias("failures"))
    digest = F.md5(F.concat("c_name", F.replace("c_mktsegment", F.lit("BUILDING"), F.lit("HOUSE"))))
    return I.recorded(ledger, customers.where("c_acctbal > 0").select("url", (F.col("c_acctbal") > 2000).alias("ok"), digest.alias("new_hash"), F.lit(2).alias("at")))


@query(f"""SELECT reason, count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS n_words FROM (SELECT w, CASE WHEN source IN ('src3', 'src7') THEN 'untrusted' WHEN lang = 'es' THEN 'out_of_scope' WHEN len(w) < 25 THEN 'too_short' WHEN seen > 1 AND doc_id > first THEN 'duplicate' ELSE 'accepted' END AS reason
FROM (SELECT *, {_W} AS w, count(*) OVER (PARTITION BY sha256(text)) AS seen, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)) GROUP BY 1""")
def ingest_gate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", I.content_hash(F.col("text")).alias("h"), F.size(F.regexp_extract_all(F.col("text"), F.lit(T.TOKENIZERS["unspaced"]), F.lit(0))).alias("words"))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    reason = I.ladder((F.col("source").isin("src3", "src7"), "untrusted"), (F.col("lang") == "es", "out_of_scope"), (F.col("words") < 25, "too_short"), (F.col("doc_id") > F.col("first"), "duplicate"), default="accepted")
    return docs.join(firsts, "h").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("words").alias("n_words"))


@query("""SELECT event_id, array_to_string(list_sort(list_filter(['k', 'type', 'user'], lambda k: k IN ('k', 'type'))), ',') AS keys, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def metadata_prune(spark, sf_dir):
    meta = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")))
    kept = I.pruned_metadata(meta, ["k", "type"])
    return read(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"), kept["k"].cast("bigint").alias("k"))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'indexed' WHEN 'signup' THEN 'terminal' WHEN 'error' THEN CASE WHEN user_id % 4 + 1 >= 3 THEN 'exhausted' ELSE 'retryable' END ELSE 'pending' END AS state,
CAST(user_id % 4 + CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 1 ELSE 0 END AS BIGINT) AS attempts FROM events""")
def index_state(spark, sf_dir):
    event = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "signup", "gone").when(F.col("event_type") == "error", "error").otherwise("none")
    state, attempts = I.next_state(F.lit("pending"), event, F.col("user_id") % 4)
    return read(spark, sf_dir, "events").select("event_id", state.alias("state"), attempts.alias("attempts"))


@query("""SELECT user_id AS url, arg_min(event_type, event_id) AS source, arg_min(t, event_id) FILTER (t IS NOT NULL) AS title, max(value) AS score FROM (SELECT *, CASE WHEN event_type IN ('purchase', 'error') THEN event_type || event_id END AS t FROM events) GROUP BY 1""")
def hint_merge(spark, sf_dir):
    title = F.when(F.col("event_type").isin("purchase", "error"), F.concat("event_type", F.col("event_id").cast("string")))
    return I.hints_merged(read(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("pos"), F.col("event_type").alias("source"), title.alias("title"), F.col("value").alias("score")))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE s_name END AS name, greatest(CASE WHEN s_suppkey % 2 = 0 THEN 0.8 ELSE 0.4 END, 0.6)::DOUBLE AS confidence FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def enrich_fill(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, 0.8).otherwise(0.4).alias("confidence"))
    found = supplier.select("s_suppkey", "s_nationkey").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.col("n_name").alias("name"), F.lit(0.6).alias("confidence"))
    return I.enriched(supplier, found, "s_suppkey", ["name"])


@query("""SELECT * FROM (SELECT 'nation' AS kind, n_name AS name, 'https://' || lower(n_name) || '/' || u AS url FROM nation, (SELECT unnest(['a', 'b', 'a']) AS u) GROUP BY ALL UNION ALL SELECT 'region', r_name, 'https://' || lower(r_name) FROM region) WHERE url <> 'https://asia'""")
def canonical_registry(spark, sf_dir):
    urls = lambda c, *ends: F.array(*[F.concat(F.lit("https://"), F.lower(c), F.lit(e)) for e in ends])
    nation = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), urls("n_name", "/a", "/b", "/a").alias("urls"))
    region = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), urls("r_name", "").alias("urls"))
    known = read(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.lit("region").alias("kind"), F.col("r_name").alias("name"), F.lit("https://asia").alias("url"))
    return I.canonical_registry([("nation", nation), ("region", region)], known)


@query("""SELECT conv_id AS url, CAST(count(*) AS INTEGER) AS n_texts, sha256(string_agg(text, chr(10) || chr(10) ORDER BY pos, text)) AS text_sha256 FROM (SELECT conv_id, text, min(turn) AS pos FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def web_contexts(spark, sf_dir):
    contexts = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("url"), F.col("turn").alias("pos"), "text")
    return I.concatenated(contexts).select("url", "n_texts", F.sha2("text", 256).alias("text_sha256"))
