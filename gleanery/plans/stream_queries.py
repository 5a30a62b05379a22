"""Queries of what streams keep: passes of a crawl, sessions in bounded memory. The stream forms are held against these
in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.plans.common import AS_OF, Family, read
from gleanery.streaming import crawl, memory

FAMILY = Family()
query = FAMILY.query

# a ledger of pages: known by their text, by an older one, or not at all; crawled so many days ago as their text tells
_LEDGER = f"""g AS (SELECT page_id, html, length(html) AS n, sha256(html) AS h FROM pages),
l AS (SELECT 'p' || page_id AS url, ['daily', 'weekly', 'monthly', 'never'][n % 4 + 1] AS frequency, CASE WHEN page_id % 5 = 0 THEN NULL WHEN contains(html, 'nav') THEN h ELSE sha256(html || ' old') END AS content_hash,
CASE WHEN page_id % 5 <> 0 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * (n % 40) END AS last_crawl FROM g),
f AS (SELECT 'p' || page_id AS url, n % 7 <> 0 AS ok, CASE WHEN n % 7 = 0 THEN 500 WHEN n % 11 = 0 THEN 304 ELSE 200 END AS http_status, CASE WHEN n % 13 <> 0 THEN h END AS new_hash, CASE WHEN n % 14 = 0 THEN 'timeout' END AS error FROM g WHERE page_id % 6 <> 1),
m AS (SELECT l.*, f.ok, f.new_hash, http_status, error, f.url IS NOT NULL AND (last_crawl IS NULL OR epoch(TIMESTAMP '{AS_OF}') - epoch(last_crawl) >= 86400 * CASE frequency WHEN 'daily' THEN 1 WHEN 'monthly' THEN 30 ELSE 7 END) AS tried FROM l LEFT JOIN f USING (url)),
o AS (SELECT *, CASE WHEN NOT tried THEN NULL WHEN NOT ok THEN 'failed' WHEN http_status = 304 OR new_hash IS NULL THEN 'skipped' WHEN content_hash IS NULL OR content_hash <> new_hash THEN 'reingested' ELSE 'skipped' END AS outcome,
CASE WHEN NOT tried THEN NULL WHEN NOT ok THEN coalesce(error, 'http_' || http_status) WHEN http_status = 304 OR new_hash IS NULL THEN 'not_modified' WHEN content_hash IS NULL THEN 'new' WHEN content_hash <> new_hash THEN 'hash_changed' ELSE 'unchanged' END AS reason FROM m)"""


def crawl_state(spark, sf_dir):
    """(ledger, fetches) of the pages."""
    page = read(spark, sf_dir, "pages").withColumn("n", F.char_length("html")).withColumn("h", F.sha2("html", 256))
    url, none = F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url"), F.lit(None).cast("timestamp")
    known = F.when(F.col("page_id") % 5 == 0, None).when(F.contains("html", F.lit("nav")), F.col("h")).otherwise(F.sha2(F.concat("html", F.lit(" old")), 256))
    ago = F.when(F.col("page_id") % 5 != 0, F.lit(AS_OF).cast("timestamp") - F.make_interval(days=F.col("n") % 40))
    frequency = F.element_at(F.array(*[F.lit(x) for x in ("daily", "weekly", "monthly", "never")]), (F.col("n") % 4 + 1).cast("int"))
    ledger = page.select(url, frequency.alias("frequency"), known.alias("content_hash"), none.alias("last_modified"), ago.alias("last_crawl"), none.alias("last_changed"), F.lit(1).alias("failures"))
    n = F.col("n")
    status, error = F.when(n % 7 == 0, 500).when(n % 11 == 0, 304).otherwise(200), F.when(n % 14 == 0, "timeout")
    fetches = page.where("page_id % 6 <> 1").select(url, (n % 7 != 0).alias("ok"), status.alias("http_status"), F.when(n % 13 != 0, F.col("h")).alias("new_hash"), none.alias("last_modified"), error.alias("error"), F.lit(AS_OF).cast("timestamp").alias("at"))
    return ledger, fetches


@query(f"""WITH {_LEDGER} SELECT url, CASE WHEN outcome <> 'failed' AND http_status <> 304 AND new_hash IS NOT NULL THEN new_hash ELSE content_hash END AS content_hash,
CASE WHEN tried THEN TIMESTAMP '{AS_OF}' ELSE last_crawl END AS last_crawl, CASE WHEN outcome = 'reingested' THEN TIMESTAMP '{AS_OF}' END AS last_changed, CAST(CASE WHEN outcome = 'failed' THEN 2 WHEN tried THEN 0 ELSE 1 END AS INTEGER) AS failures, outcome, reason FROM o""")
def crawl_worker_pass(spark, sf_dir):
    """Due pages met with their fetches, and what is recorded of them."""
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return crawl.tick(*crawl_state(spark, sf_dir), AS_OF).select("url", "content_hash", ntz("last_crawl"), ntz("last_changed"), "failures", "outcome", "reason")


@query(f"WITH {_LEDGER} SELECT frequency, outcome, reason, count(*) AS n FROM o WHERE outcome IS NOT NULL GROUP BY 1, 2, 3")
def crawl_pass_counts(spark, sf_dir):
    return crawl.pass_counts(crawl.tick(*crawl_state(spark, sf_dir), AS_OF))


def remembered_events(spark, sf_dir):
    slot = F.when(F.col("event_type").isin("view", "click"), F.concat("event_type", (F.col("event_id") % 9).cast("string")))
    return read(spark, sf_dir, "events"), slot, F.col("event_type") == "signup"


@query()
def session_memory_bounded(spark, sf_dir):
    """Memory of the latest 20 sessions of each of four shards, forgotten after half a day: what goes depends on all that
    came before, which SQL can't say without a recursion over every event."""
    return memory.remembered(*remembered_events(spark, sf_dir), idle_seconds=43_200, most=20, shards=4)


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, CASE WHEN event_type IN ('view', 'click') THEN event_type || (event_id % 9) END AS slot FROM events),
e AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200 * 1000000::BIGINT OR event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS epoch FROM o)
SELECT event_id, user_id, last_value(slot IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried, coalesce(gap <= 43200 * 1000000::BIGINT, false) AS known FROM e""")
def session_memory_idle(spark, sf_dir):
    """Memory that only time bounds."""
    return memory.remembered(*remembered_events(spark, sf_dir), idle_seconds=43_200, most=1_000_000, shards=4)
