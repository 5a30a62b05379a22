"""Queries of analytics, audits and windows over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import analytics as A
from gleanery.operators import evaluation as E
from gleanery.plans.common import Family, read
from gleanery.streaming import windows as W

FAMILY = Family()
query = FAMILY.query

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark, sf_dir):
    return E.table_counts({t: read(spark, sf_dir, t) for t in TABLES})


@query("""SELECT CAST(ts::DATE AS VARCHAR) AS day, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 4)::DOUBLE AS error_rate, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1""")
def kpi_rates(spark, sf_dir):
    by = read(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"))
    return by.agg(F.count("*").alias("n"), A.rate(F.col("event_type") == "error").alias("error_rate"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(r"""SELECT trim(lower(regexp_replace(asked, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS question, count(*) AS n FROM (SELECT a.conv_id, (SELECT u.text FROM conversations u WHERE u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < a.turn ORDER BY u.turn DESC LIMIT 1) AS asked
FROM conversations a WHERE a.role = 'assistant' AND length(a.text) % 3 = 0) WHERE asked IS NOT NULL GROUP BY 1 ORDER BY n DESC, question LIMIT 10""")
def kpi_repeated_unanswered(spark, sf_dir):
    return A.repeated_unanswered(read(spark, sf_dir, "conversations"), F.char_length("text") % 3 == 0)


@query("SELECT a.conv_id, a.turn, u.turn AS earlier FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn < a.turn AND u.role = 'user' WHERE a.role = 'assistant' AND length(a.text) % 3 = 0")
def kpi_failed_fanout(spark, sf_dir):
    return A.failed_fanout(read(spark, sf_dir, "conversations"), F.char_length("text") % 3 == 0)


@query("""SELECT 'orders without items' AS "check", count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'customers without orders', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'pairs of part and supplier sold once', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') r WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey AND l_returnflag = 'N')""")
def integrity_anti_joins(spark, sf_dir):
    orders, items, customer = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    pair = ["l_partkey", "l_suppkey"]
    return A.orphans(
        [
            ("orders without items", orders.select(F.col("o_orderkey").alias("k")), items.select(F.col("l_orderkey").alias("k")), ["k"]),
            ("customers without orders", customer.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k")), ["k"]),
            ("pairs of part and supplier sold once", items.where("l_returnflag = 'R'").select(*pair).distinct(), items.where("l_returnflag = 'N'"), pair),
        ]
    )


@query("SELECT count(*) AS items, count(*) FILTER (g) AS with_source, round(count(*) FILTER (g) / count(*), 4)::DOUBLE AS share FROM (SELECT source = 'src1' OR doc_id IN (SELECT doc_id FROM labels) AS g FROM documents)")
def integrity_semi_joins(spark, sf_dir):
    return A.provenance(read(spark, sf_dir, "documents"), F.col("source") == "src1", read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 0) GROUP BY 1")
def semi_over_aggregate(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    never = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f")).where("f = 0")
    return orders.join(never, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def coverage_rollup(spark, sf_dir):
    return read(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, source LIMIT 5")
def top_sources(spark, sf_dir):
    return A.top_counts(read(spark, sf_dir, "documents"), F.col("source"), "source", 5)


@query("""WITH m AS (SELECT count(*) FILTER (event_type = 'error') / count(*) AS e, max(value) AS v, count(DISTINCT user_id) AS u FROM events)
SELECT 'errors' AS rule, 'critical' AS severity FROM m WHERE e > 0.1 UNION ALL SELECT 'outlier', 'warning' FROM m WHERE v > 100 UNION ALL SELECT 'few users', 'info' FROM m WHERE u < 10""")
def alerts_eval(spark, sf_dir):
    m = read(spark, sf_dir, "events").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("e"), F.max("value").alias("v"), F.countDistinct("user_id").alias("u"))
    return E.alerts(m, [("errors", F.col("e") > 0.1, "critical"), ("outlier", F.col("v") > 100, "warning"), ("few users", F.col("u") < 10, "info")])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return W.windowed_counts(read(spark, sf_dir, "events"), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    return W.windowed_counts(read(spark, sf_dir, "events"), "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions_30min(spark, sf_dir):
    return W.sessions(read(spark, sf_dir, "events"), "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT CAST(ceil(n / 500.0) AS BIGINT) AS batches, CAST(ceil(c / 3600.0) AS BIGINT) AS pages, n FROM (SELECT count(*) AS n, sum(n_chars) AS c FROM documents)")
def capacity_projection(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c")).select(F.ceil(F.col("n") / 500).alias("batches"), F.ceil(F.col("c") / 3600).alias("pages"), "n")


@query()
def rate_limit_recursive(spark, sf_dir):
    """Events admitted at three a day and user: denied ones do not count, so a window of counts would be wrong."""
    return W.admitted(read(spark, sf_dir, "events"), 3, 86400)
