"""Queries of evaluation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import audits as A
from gleanery.operators.ingest import pruned_metadata
from gleanery.plans.common import AS_OF, STOPWORDS, Family, read, sql_in, sql_text
from gleanery.plans.evaluation_queries import _ENTAIL, _entailed
from gleanery.plans.search_queries import _KEYWORD, _keyword

FAMILY = Family()
query = FAMILY.query
_WORDS = f"regexp_extract_all(lower(text), {sql_text(T.TOKENIZERS['word'])})"
_LONG = sql_text(T.TOKENIZERS["hyphenated"])

# results of the keyword search against labels: a host, a beginning of the text, a kind
_TARGETS = f"""{_KEYWORD}, x AS (SELECT rk.item_id, rank, source AS host, text, lang AS kind FROM rk JOIN documents USING (doc_id) WHERE rank <= 10),
e AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 4) END AS host, CASE WHEN item_id % 3 = 1 THEN 'license' END AS contains, CASE WHEN item_id % 3 = 2 THEN 'fr' END AS kind FROM benchmark),
h AS (SELECT x.item_id, rank, coalesce(x.host = e.host, false) OR coalesce(contains(lower(text), e.contains), false) OR coalesce(x.kind = e.kind, false) AS hit FROM x JOIN e USING (item_id)),
tr AS (SELECT item_id AS query_id, min(rank) FILTER (hit)::INTEGER AS target, coalesce(NOT bool_or(hit) FILTER (rank = 1), true) AS noisy FROM h GROUP BY 1)"""
_TARGETS = _TARGETS.replace(", x AS (SELECT rk.", ", hx AS (SELECT rk.").replace("FROM x JOIN e", "FROM hx JOIN e").replace("x.item_id, rank, coalesce(x.host", "hx.item_id, rank, coalesce(hx.host").replace("coalesce(x.kind", "coalesce(hx.kind").replace("e AS (SELECT item_id, CASE", "e AS (SELECT item_id, CASE")


def _targets(spark, sf_dir):
    docs, i = read(spark, sf_dir, "documents"), F.col("item_id")
    found = _keyword(spark, sf_dir, 10).join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), F.lit(None).cast("string").alias("url"), "text", F.col("lang").alias("kind")), "id")
    expected = read(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.when(i % 3 == 0, F.concat(F.lit("src"), (i % 4).cast("string"))).alias("host"), F.lit(None).cast("string").alias("url"), F.when(i % 3 == 1, "license").alias("contains"), F.when(i % 3 == 2, "fr").alias("kind"))
    return A.target_ranks(found.select("query_id", "rank", "host", "url", "text", "kind"), expected)


@query(f"{_TARGETS} SELECT query_id, target, noisy FROM tr")
def retrieval_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


@query(f"{_TARGETS} SELECT count(*) AS n, round(count(target) / count(*), 4)::DOUBLE AS hit_rate, round(count(*) FILTER (target = 1) / count(*), 4)::DOUBLE AS hit_1, round(count(*) FILTER (noisy) / count(*), 4)::DOUBLE AS noisy_1, round(avg(coalesce(1.0::DOUBLE / target, 0)), 6)::DOUBLE AS mrr FROM tr")
def retrieval_evaluation(spark, sf_dir):
    return _targets(spark, sf_dir).agg(F.count("*").alias("n"), A.share(F.col("target").isNotNull()).alias("hit_rate"), A.share(F.col("target") == 1).alias("hit_1"), A.share(F.col("noisy")).alias("noisy_1"), A.mean(F.coalesce(1.0 / F.col("target"), F.lit(0.0))).alias("mrr"))


# questions of the benchmark: latency by length, an answer expected where the text is long enough
_ASKED = f"""{_TARGETS}, q AS (SELECT item_id % 3 AS kind, tr.query_id IS NOT NULL AS found, item_id % 5 > 0 AS labelled, CASE WHEN item_id % 5 > 0 THEN target END AS target, noisy, CASE WHEN item_id % 4 > 0 THEN length(text) < 200 END AS not_expected, length(text) AS ms FROM benchmark LEFT JOIN tr ON tr.query_id = item_id)"""
_METRICS = """count(*) AS n, count(*) FILTER (labelled) AS labelled, coalesce(round(count(*) FILTER (found AND NOT coalesce(not_expected, false)) / nullif(count(*) FILTER (NOT coalesce(not_expected, false)), 0), 4), 0)::DOUBLE AS hit_rate,
coalesce(round(count(target) / nullif(count(*) FILTER (labelled), 0), 4), 0)::DOUBLE AS target_rate, coalesce(round(count(*) FILTER (target = 1) / nullif(count(*) FILTER (labelled), 0), 4), 0)::DOUBLE AS hit_1, coalesce(round(count(*) FILTER (target <= 3) / nullif(count(*) FILTER (labelled), 0), 4), 0)::DOUBLE AS hit_3,
coalesce(round(sum(CASE WHEN labelled THEN coalesce(1.0::DOUBLE / target, 0) END) / nullif(count(*) FILTER (labelled), 0), 6), 0)::DOUBLE AS mrr, coalesce(round(count(*) FILTER (labelled AND coalesce(noisy, false)) / nullif(count(*) FILTER (labelled), 0), 4), 0)::DOUBLE AS noisy_1, round(count(*) FILTER (NOT found) / count(*), 4)::DOUBLE AS not_found,
round(quantile_cont(ms, 0.5), 6)::DOUBLE AS median_ms, quantile_disc(ms, 0.95)::DOUBLE AS p95_ms, count(*) FILTER (found AND not_expected = false) AS answered_right, count(*) FILTER (found AND not_expected) AS answered_wrong, count(*) FILTER (NOT found AND not_expected) AS refused_right, count(*) FILTER (NOT found AND not_expected = false) AS refused_wrong"""


@query(f"{_ASKED} SELECT kind, {_METRICS} FROM q GROUP BY 1")
def retrieval_metrics(spark, sf_dir):
    """Rates, latencies and the matrix of abstentions by kind of question."""
    i, size = F.col("item_id"), F.char_length("text")
    asked = read(spark, sf_dir, "benchmark").select(i.alias("query_id"), (i % 3).alias("kind"), (i % 5 > 0).alias("labelled"), F.when(i % 4 > 0, size < 200).alias("not_expected"), size.alias("ms"))
    met = asked.join(_targets(spark, sf_dir).withColumn("found", F.lit(True)), "query_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return A.retrieval_metrics(met.withColumn("target", F.when(F.col("labelled"), F.col("target"))), "kind")


_CURATED = ["What is the license?", "who may use it", "What is the License?"]


@query(f"""WITH m AS (SELECT role, trim(text) AS said, trim(lower(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS key, TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR * (conv_id * 24 + turn) AS stamp FROM (SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN left(text, 13) ELSE text END AS text FROM conversations)),
c AS (SELECT key, count(*) AS n, arg_min(said, (stamp, said)) AS question FROM m WHERE role = 'user' AND length(said) >= 12 AND stamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1 ORDER BY n DESC, key LIMIT 40),
e AS (SELECT question, n, -1 AS place, key FROM c UNION ALL SELECT q, 0, i, trim(lower(q)) FROM (VALUES (0, 'What is the license?'), (1, 'who may use it')) AS t(i, q) WHERE trim(lower(q)) NOT IN (SELECT key FROM c))
SELECT CAST(rank AS INTEGER) AS rank, question, n FROM (SELECT *, row_number() OVER (ORDER BY place, n DESC, key) AS rank FROM e) WHERE rank <= 40""")
def top_questions_recent(spark, sf_dir):
    """The questions asked most in thirty days, filled up with curated ones: a top-k report."""
    at = F.lit(AS_OF).cast("timestamp") - F.make_interval(hours=F.col("conv_id") * 24 + F.col("turn"))
    told = read(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("conv_id") % 2 == 0, F.substring("text", 1, 13)).otherwise(F.col("text")))
    return A.top_questions(told.select("role", "text", at.alias("at")), AS_OF, _CURATED, k=40)


_RUNS = "SELECT o_orderpriority AS category, o_orderstatus AS layer, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 7 + 1 END AS rank, 'i' || (o_orderkey % 3) AS intent, CASE WHEN o_orderkey % 9 > 0 THEN 'i' || (o_custkey % 3) END AS wanted_intent, CAST(floor(o_totalprice) AS BIGINT) AS ms, o_orderkey % 11 = 0 AS control FROM orders"


def _runs(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    intent = lambda x: F.concat(F.lit("i"), (x % 3).cast("string"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("layer"), F.when(k % 4 > 0, k % 7 + 1).alias("rank"), intent(k).alias("intent"), F.when(k % 9 > 0, intent(c)).alias("wanted_intent"), F.floor("o_totalprice").alias("ms"), (k % 11 == 0).alias("control"), "o_orderdate")


@query(f"""SELECT category, layer, count(*) AS n, round(count(rank) / count(*), 4)::DOUBLE AS hit_rate, round(count(*) FILTER (intent = wanted_intent) / count(*), 4)::DOUBLE AS correct_intent, quantile_disc(ms, 0.95)::DOUBLE AS p95_ms, quantile_disc(ms, 0.99)::DOUBLE AS p99_ms FROM ({_RUNS}) WHERE NOT control GROUP BY ROLLUP (category, layer)""")
def benchmark_summary(spark, sf_dir):
    found = A.benchmark_summary(_runs(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("double") for c in ("p95_ms", "p99_ms")})


@query(f"SELECT wanted_intent, intent, count(*) AS n FROM ({_RUNS}) WHERE wanted_intent IS NOT NULL GROUP BY 1, 2")
def intent_confusion(spark, sf_dir):
    return A.intent_confusion(_runs(spark, sf_dir))


@query(f"""WITH t AS (SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS length, turn, contains(lower(text), 'license') AS x, contains(lower(text), 'the') AS y, len({_WORDS}) % 3 AS topic, first_value(len({_WORDS}) % 3) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM conversations)
SELECT length, count(*) AS n, round(count(*) FILTER (x = y) / count(*), 4)::DOUBLE AS retained, round(count(*) FILTER (y) / count(*), 4)::DOUBLE AS resolved, round(count(*) FILTER (x) / count(*), 4)::DOUBLE AS leaked, round(count(*) FILTER (topic <> first) / count(*), 4)::DOUBLE AS drifted FROM t GROUP BY 1""")
def conversation_retention(spark, sf_dir):
    from pyspark.sql import Window

    own, low = Window.partitionBy("conv_id"), F.lower("text")
    topic = F.size(T.tokens(F.col("text"))) % 3
    turns = read(spark, sf_dir, "conversations").withColumns({"expected": F.contains(low, F.lit("license")), "carried": F.contains(low, F.lit("the")), "topic": topic})
    turns = turns.withColumns({"answered": F.col("carried"), "foreign": F.col("expected"), "first_topic": F.first("topic").over(own.orderBy("turn")), "length": F.count("*").over(own)})
    return A.retention(turns, "length")


@query("""SELECT doc_id, list_filter(['password', 'license', 'the'], lambda t: contains(lower(text), t))[1] AS leaked FROM documents""")
def first_leaked_term(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", A.first_leaked(F.col("text"), ["password", "license", "the"]).alias("leaked"))


@query("""SELECT event_type AS level, count(*) AS n, quantile_disc(c, 0.5)::BIGINT AS p50, quantile_disc(c, 0.95)::BIGINT AS p95, quantile_disc(c, 0.99)::BIGINT AS p99, max(c) AS max, round(avg(c), 3)::DOUBLE AS mean, round(count(*) / (epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT), 6)::DOUBLE AS throughput FROM (SELECT event_type, date_trunc('second', ts) AS ts, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY 1""")
def load_levels(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select(F.col("event_type").alias("level"), F.date_trunc("second", "ts").cast("timestamp").alias("at"), F.round(F.col("value") * 100).cast("long").alias("ms"))
    found = A.load_levels(calls, "level")
    return found.withColumns({c: F.col(c).cast("long") for c in ("p50", "p95", "p99")})


@query("""SELECT c_mktsegment AS suite, count(*) AS n, round(count(*) FILTER (c_acctbal > 0) / count(*), 4)::DOUBLE AS pass_rate, round(count(*) FILTER (c_acctbal > 0) / count(*), 4) >= 0.9 AS passed FROM customer WHERE c_custkey % 10 <> 0 GROUP BY 1""")
def pass_rate_gate(spark, sf_dir):
    return A.gate(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("suite"), (F.col("c_acctbal") > 0).alias("ok"), F.when(F.col("c_custkey") % 10 == 0, "timeout").alias("error")), "suite", 0.9)


@query("""WITH m AS (SELECT count(*) FILTER (event_type = 'error') / count(*) AS e, count(DISTINCT user_id) AS u, avg(value) AS v FROM events), s AS (SELECT (CASE WHEN e < 0.5 THEN 2.0 ELSE 0 END + CASE WHEN u > 5 THEN 1.0 ELSE 0 END + CASE WHEN v > 1e9 THEN 1.0 ELSE 0 END) / 4.0 AS h, e, u, v FROM m)
SELECT CASE WHEN h >= 0.9 THEN 'certified' WHEN h >= 0.7 THEN 'conditional' ELSE 'failed' END AS verdict, round(h, 6)::DOUBLE AS score, array_to_string(list_filter([CASE WHEN NOT e < 0.5 THEN 'errors' END, CASE WHEN NOT u > 5 THEN 'users' END, CASE WHEN NOT v > 1e9 THEN 'value' END], lambda x: x IS NOT NULL), ',') AS failed FROM s""")
def certification(spark, sf_dir):
    m = read(spark, sf_dir, "events").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("e"), F.countDistinct("user_id").alias("u"), F.avg("value").alias("v"))
    return A.certification(m, [("errors", F.col("e") < 0.5, 2.0), ("users", F.col("u") > 5, 1.0), ("value", F.col("v") > 1e9, 1.0)])


@query("SELECT count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'info') AS info FROM (SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'info' ELSE 'warning' END AS s FROM events)")
def alert_severities(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "info").otherwise("warning")
    return A.severities(read(spark, sf_dir, "events").select(severity.alias("severity")), ["critical", "warning", "info"])


@query("""SELECT col AS "column", count(*) AS n, round(avg(c), 4)::DOUBLE AS mean, max(c)::INTEGER AS largest, sum(c)::BIGINT AS total FROM (SELECT 'source' AS col, length(to_json({v: source})) AS c FROM documents UNION ALL SELECT 'doc_id', length(to_json({v: doc_id})) FROM documents UNION ALL SELECT 'lang', length(to_json({v: lang})) FROM documents) GROUP BY 1""")
def json_sizes(spark, sf_dir):
    return A.json_sizes(read(spark, sf_dir, "documents"), ["source", "doc_id", "lang"])


# what has been found of pages, by eight groupings
AREAS = {"listing": ["?page="], "language": ["/es/", "/de/"], "spam": ["spam-farm", "casino"], "nowhere": ["no such marker"], "mobile": ["//m."]}
_COVER = r"""p AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang FROM pages),
c AS (SELECT host, scheme, nullif(lang, '') AS language, regexp_extract(host, '[^.]+$') AS top, CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' END AS form, CASE WHEN length(html) < 1500 THEN 'short' WHEN length(html) < 6000 THEN 'middle' ELSE 'long' END AS size,
CASE WHEN regexp_matches(url, '\.html$') THEN 'html' END AS suffix, regexp_extract(host, '^[^.]+') AS first, length(html) < 1500 AS low, contains(url, '#') AS anchored, lower(url) AS t FROM p)"""


def _kinds():
    url, text = F.col("url"), F.col("html")
    host = F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#:]*)", 1))
    size = F.when(F.char_length(text) < 1500, "short").when(F.char_length(text) < 6000, "middle").otherwise("long")
    form = F.when(F.contains(url, F.lit("?")), "query").when(F.contains(url, F.lit("#")), "fragment")
    return {
        "host": host,
        "scheme": F.regexp_extract(url, "^([a-z]+):", 1),
        "language": F.nullif(F.regexp_extract(url, "^[a-z]+://[^/]*/([a-z]+)/", 1), F.lit("")),
        "top": F.regexp_extract(host, "[^.]+$", 0),
        "form": form,
        "size": size,
        "suffix": F.when(url.rlike(r"\.html$"), "html"),
        "first": F.regexp_extract(host, "^[^.]+", 0),
    }


_BY = ("host", "scheme", "language", "top", "form", "size", "suffix", "first")


@query(f"""WITH {_COVER}, n AS (SELECT {', '.join(f"coalesce({k}, 'unknown') AS {k}" for k in _BY)} FROM c),
g AS (SELECT {', '.join(_BY)}, grouping({', '.join(_BY)}) AS s, count(*) AS n FROM n GROUP BY GROUPING SETS ((), {', '.join(f'({k})' for k in _BY)}))
SELECT CASE s {' '.join(f"WHEN {255 - (1 << (7 - i))} THEN '{k}'" for i, k in enumerate(_BY))} ELSE 'all' END AS kind, CASE s {' '.join(f"WHEN {255 - (1 << (7 - i))} THEN {k}" for i, k in enumerate(_BY))} ELSE 'all' END AS value, n FROM g
UNION ALL SELECT 'state', 'low_content', count(*) FILTER (low) FROM c UNION ALL SELECT 'state', 'anchored', count(*) FILTER (anchored) FROM c
""" + " ".join(f"UNION ALL SELECT 'area', '{a}', count(*) FILTER ({' OR '.join(f'contains(t, {sql_text(m)})' for m in ms)}) FROM c" for a, ms in AREAS.items()))
def coverage_report(spark, sf_dir):
    """Eight groupings, states and areas by one aggregation."""
    states = {"low_content": F.char_length("html") < 1500, "anchored": F.contains("url", F.lit("#"))}
    return A.coverage(read(spark, sf_dir, "pages"), _kinds(), states, AREAS, F.col("url"))


@query(f"WITH {_COVER} SELECT array_to_string(list_filter([" + ", ".join(f"CASE WHEN (SELECT count(*) FROM c WHERE {' OR '.join(f'contains(t, {sql_text(m)})' for m in ms)}) = 0 THEN '{a}' END" for a, ms in AREAS.items()) + "], lambda x: x IS NOT NULL), ',') AS missing")
def missing_areas(spark, sf_dir):
    return A.missing_areas(A.coverage(read(spark, sf_dir, "pages"), _kinds(), {}, AREAS, F.col("url")), list(AREAS)).select(F.array_join("missing", ",").alias("missing"))


_STATE = "CASE page_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'excluded' ELSE 'indexed' END"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


@query(f"""WITH p AS (SELECT url, {_HOST} AS host, {_STATE} AS state FROM pages), f AS (SELECT host, string_agg(url, ' ' ORDER BY url) AS samples FROM (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY url) AS i FROM p WHERE state = 'failed') WHERE i <= 50 GROUP BY 1)
SELECT p.host, count(*) AS n, count(*) FILTER (state = 'indexed') AS indexed, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'excluded') AS excluded, round(count(*) FILTER (state = 'indexed') / count(*), 4)::DOUBLE AS share, any_value(samples) AS samples FROM p LEFT JOIN f ON f.host = p.host GROUP BY 1""")
def index_audit(spark, sf_dir):
    i = F.col("page_id") % 5
    state = F.when(i == 0, "failed").when(i == 1, "pending").when(i == 2, "excluded").otherwise("indexed")
    return A.index_audit(read(spark, sf_dir, "pages").select("url", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)).alias("host"), state.alias("state")))


_CHECKS = [
    ("documents", "SELECT count(*) FROM documents"),
    ("empty texts", "SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = ''"),
    ("repeated texts", "SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM documents GROUP BY text)"),
    ("without a label", "SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    ("labels without a document", "SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    ("without a source", "SELECT count(*) FROM documents WHERE source IS NULL"),
    ("wrong lengths", "SELECT count(*) FROM documents WHERE n_chars <> length(text)"),
    ("vectors", "SELECT count(*) FROM embeddings"),
    ("vectors without a document", "SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)"),
    ("documents without a vector", "SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    ("pages without a URL", "SELECT count(*) FROM pages WHERE url IS NULL OR url = ''"),
    ("repeated URLs", "SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM pages GROUP BY url)"),
    ("turns without a text", "SELECT count(*) FROM conversations WHERE text IS NULL OR text = ''"),
    ("conversations without an answer", "SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') = 0)"),
]


@query(" UNION ALL ".join(f"""SELECT '{name}' AS "check", ({sql})::BIGINT AS n""" for name, sql in _CHECKS))
def integrity_report(spark, sf_dir):
    docs, labels, vectors, pages, turns = (read(spark, sf_dir, t) for t in ("documents", "labels", "embeddings", "pages", "conversations"))
    ids, marked, own = docs.select("doc_id"), labels.select("doc_id"), vectors.select(F.col("vec_id").alias("doc_id"))
    repeated = lambda f, c: f.groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    count = lambda f: f.agg(F.count("*").alias("n"))
    of_docs = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty texts"), F.count_if(F.col("source").isNull()).alias("without a source"), F.count_if(F.col("n_chars") != F.char_length("text")).alias("wrong lengths"))
    parts = [of_docs.unpivot([], of_docs.columns, "check", "n")]
    silent = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("a")).where("a = 0")
    for name, frame in (
        ("repeated texts", repeated(docs, "text")), ("without a label", count(ids.join(marked, "doc_id", "left_anti"))), ("labels without a document", count(marked.join(ids, "doc_id", "left_anti"))),
        ("vectors", count(vectors)), ("vectors without a document", count(own.join(ids, "doc_id", "left_anti"))), ("documents without a vector", count(ids.join(own, "doc_id", "left_anti"))),
        ("pages without a URL", count(pages.where("url IS NULL OR url = ''"))), ("repeated URLs", repeated(pages, "url")), ("turns without a text", count(turns.where("text IS NULL OR text = ''"))), ("conversations without an answer", count(silent)),
    ):
        parts.append(frame.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""SELECT answer_id, count(*) AS claims, count(*) FILTER (support >= 0.1) AS kept, count(*) FILTER (support >= 0.1) < 1 AS abstain, CASE WHEN count(*) FILTER (support >= 0.1) < 1 THEN '' ELSE string_agg('c' || turn, ' ' ORDER BY turn) FILTER (support >= 0.1) END AS text FROM (SELECT conv_id AS answer_id, turn, support FROM ({_ENTAIL})) GROUP BY 1""")
def claim_gate(spark, sf_dir):
    claims = _entailed(spark, sf_dir).select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("text"), "support")
    return A.claim_gate(claims, 0.1)


@query("""WITH c AS (SELECT conv_id AS answer_id, turn AS claim, text, unnest([turn - 1, turn + 1, 99]) AS id, unnest([0, 1, 2]) AS pos FROM conversations WHERE role = 'assistant')
SELECT answer_id, claim, coalesce(string_agg(v.text, chr(10) ORDER BY pos), '') AS premise FROM c LEFT JOIN conversations v ON v.conv_id = answer_id AND v.turn = id GROUP BY 1, 2""")
def claim_contexts(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    claims = turns.where("role = 'assistant'").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim"), "text", F.array(F.col("turn") - 1, F.col("turn") + 1, F.lit(99)).alias("cited"))
    return A.claim_contexts(claims, turns.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("id"), F.col("text").alias("context"))).drop("text")


@query("""SELECT lang AS question, other AS source, CASE WHEN lang = 'auto' OR other = 'auto' OR lang = other THEN 0.0 ELSE 0.15 END::DOUBLE AS penalty, n FROM (SELECT coalesce(lang, 'auto') AS lang, CASE WHEN doc_id % 4 = 0 THEN 'auto' WHEN doc_id % 4 = 1 THEN 'en' ELSE coalesce(lang, 'auto') END AS other, count(*) AS n FROM documents GROUP BY 1, 2)""")
def cross_lingual_penalty(spark, sf_dir):
    lang, i = F.coalesce("lang", F.lit("auto")), F.col("doc_id") % 4
    by = read(spark, sf_dir, "documents").groupBy(lang.alias("question"), F.when(i == 0, "auto").when(i == 1, "en").otherwise(lang).alias("source")).agg(F.count("*").alias("n"))
    return by.withColumn("penalty", A.cross_lingual_penalty(F.col("question"), F.col("source")))


@query(f"""{_KEYWORD}, o AS (SELECT rk.item_id AS answer_id, CASE WHEN score > 1.5 THEN score / 10 ELSE score END AS s, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(q.text), {_LONG}), lambda t: length(t) > 2)), list_filter(regexp_extract_all(lower(d.text), {_LONG}), lambda t: length(t) > 2))) / greatest(len(list_distinct(list_filter(regexp_extract_all(lower(q.text), {_LONG}), lambda t: length(t) > 2))), 1) AS o
FROM rk JOIN benchmark q ON q.item_id = rk.item_id JOIN documents d ON d.doc_id = rk.doc_id WHERE rank <= 3)
SELECT answer_id, n, top, overlap, CASE WHEN top < 1.5 THEN 'weak_context' WHEN overlap < 0.3 THEN 'ungrounded' ELSE 'grounded' END AS verdict FROM (SELECT answer_id, count(*) AS n, round(max(s), 6)::DOUBLE AS top, round(max(o), 6)::DOUBLE AS overlap FROM o GROUP BY 1)""")
def grounding_verdict(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("context")), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer"))
    return A.grounding_verdict(_keyword(spark, sf_dir, 3).withColumnRenamed("query_id", "answer_id").join(docs, "id").join(items, "answer_id"), 1.5, 0.3)


@query("""SELECT o_custkey, n, bad, round(CASE WHEN bad = n THEN 0.4 ELSE 0.8 * (1 - 0.5 * bad / n) END, 6)::DOUBLE AS confidence FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS bad FROM orders GROUP BY 1)""")
def downgraded_confidence(spark, sf_dir):
    by = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("bad"))
    return by.withColumn("confidence", A.downgraded(F.lit(0.8), F.col("bad"), F.col("n")))


@query("""SELECT CASE WHEN s = 304 THEN 'not_modified' WHEN s IN (404, 410) THEN 'gone' WHEN s >= 400 OR s IS NULL THEN 'failed' ELSE change END AS outcome, count(*) AS n FROM (SELECT CASE page_id % 7 WHEN 0 THEN 304 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END AS s, CASE WHEN page_id % 2 = 0 THEN 'hash_changed' ELSE 'unchanged' END AS change FROM pages) GROUP BY 1""")
def worker_outcomes(spark, sf_dir):
    i = F.col("page_id")
    status = F.when(i % 7 == 0, 304).when(i % 7 == 1, 404).when(i % 7 == 2, 500).when(i % 7 == 3, F.lit(None)).otherwise(200)
    return A.worker_outcomes(read(spark, sf_dir, "pages").select(status.alias("status"), F.when(i % 2 == 0, "hash_changed").otherwise("unchanged").alias("change")))


@query("""WITH p AS (SELECT trim(n_name) AS question, 'nations' AS origin, 0 AS part FROM nation UNION ALL SELECT lower(trim(n_name)), 'again', 1 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name, 'again', 1 FROM region),
r AS (SELECT question, origin FROM (SELECT *, row_number() OVER (PARTITION BY lower(question) ORDER BY part, question) AS i FROM p) WHERE i = 1),
a AS (SELECT question, origin, NULL AS parent, -1 AS t FROM r UNION ALL SELECT replace(tpl, '{}', question), 'synthetic', question, t FROM r, (SELECT unnest(['where is {}?', 'tell me of {}']) AS tpl, unnest([0, 1]) AS t))
SELECT question, origin, parent FROM a ORDER BY t, coalesce(parent, question) LIMIT 50""")
def golden_set(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    again = nation.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("question")).unionByName(region.select(F.col("r_name").alias("question")))
    return A.golden_set([("nations", nation.select(F.col("n_name").alias("question"))), ("again", again)], ["where is {}?", "tell me of {}"], 50)


@query("""SELECT query_id, kind, value, coalesce(passed, false) AS passed FROM (
SELECT d.doc_id AS query_id, kind, value, CASE kind WHEN 'entity_type' THEN lang = value WHEN 'contains' THEN contains(lower(text), lower(value)) WHEN 'official' THEN ends_with(source, value) ELSE doc_id % 3 > 0 END AS passed FROM documents d, (SELECT unnest(['entity_type', 'contains', 'official', 'no_hallucination']) AS kind, unnest(['fr', 'LICENSE', '1', '']) AS value))""")
def assertion_results(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    answers = docs.select(F.col("doc_id").alias("query_id"), "text", F.col("lang").alias("entity_type"), F.col("source").alias("host"), (F.col("doc_id") % 3 > 0).alias("supported"))
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in (("entity_type", "fr"), ("contains", "LICENSE"), ("official", "1"), ("no_hallucination", ""))]))
    return A.assertion_results(answers, docs.select(F.col("doc_id").alias("query_id"), each))


@query(f"""WITH v AS (SELECT 'topic' AS kind, unnest(list_filter(['password', 'license', 'the'], lambda t: list_contains({_WORDS}, t))) AS value FROM documents UNION ALL SELECT 'word', unnest(list_distinct(list_filter({_WORDS}, lambda t: t NOT IN {sql_in(STOPWORDS)}))) FROM documents)
SELECT kind, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS rank FROM (SELECT kind, value, count(*) AS n FROM v GROUP BY 1, 2)) WHERE rank <= 15""")
def missing_knowledge(spark, sf_dir):
    """Topics and words of what was asked, the most frequent of each."""
    words = T.tokens(F.col("text"))
    topics = F.array_intersect(F.array(*[F.lit(t) for t in ("password", "license", "the")]), words)
    return A.most_common(read(spark, sf_dir, "documents"), {"topic": topics, "word": F.array_distinct(F.filter(words, lambda t: ~t.isin(STOPWORDS)))}, 15)


@query("""SELECT count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars_before, sum(length(coalesce(trim(regexp_replace(text, '[ \\t]+', ' ', 'g')), '')))::BIGINT AS chars_after, round(1 - sum(length(coalesce(trim(regexp_replace(text, '[ \\t]+', ' ', 'g')), ''))) / sum(length(coalesce(text, ''))), 6)::DOUBLE AS saved, count(*) FILTER (coalesce(text, '') <> coalesce(trim(regexp_replace(text, '[ \\t]+', ' ', 'g')), '')) AS changed FROM documents""")
def prune_impact(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("after", F.trim(F.regexp_replace("text", r"[ \t]+", " ")))
    return A.prune_impact(docs, "text", "after")


@query(f"SELECT role, count(*) AS n, round(avg(len({_WORDS})), 4)::DOUBLE AS mean_words, round(count(DISTINCT text) / count(*), 4)::DOUBLE AS distinct_share, round(count(*) / (SELECT count(*) FROM conversations), 4)::DOUBLE AS share FROM conversations GROUP BY 1")
def dataset_statistics(spark, sf_dir):
    return A.dataset_statistics(read(spark, sf_dir, "conversations").select("role", F.col("text").alias("question")), "role")


@query("""SELECT a.o_orderkey, a.ms AS before, b.ms AS after, b.ms - a.ms AS delta FROM (SELECT o_orderkey, o_custkey % 90 AS ms FROM orders) a JOIN (SELECT l_orderkey, sum(l_quantity)::BIGINT AS ms FROM lineitem GROUP BY 1) b ON l_orderkey = o_orderkey""")
def latency_deltas(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 90).alias("ms"))
    b = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("ms"))
    return A.deltas(a, b, "o_orderkey", "ms")


@query("""SELECT doc_id, CASE WHEN length(m) > 60 THEN 1 ELSE 3 END::INTEGER AS n_keys FROM (SELECT doc_id, repeat('x', CAST(doc_id % 100 AS INTEGER)) AS m FROM documents)""")
def metadata_prune_long(spark, sf_dir):
    """Metadata of more than sixty characters are cut to what is to be kept; shorter ones stay."""
    filler = F.repeat(F.lit("x"), (F.col("doc_id") % 100).cast("int"))
    meta = F.create_map(F.lit("title"), F.lit("t"), F.lit("noise"), filler, F.lit("more"), F.lit("m"))
    cut = F.when(F.char_length(filler) > 60, pruned_metadata(meta, ["title"])).otherwise(meta)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(cut).alias("n_keys"))


@query("""WITH u AS (SELECT trim(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS question, text, conv_id, turn FROM conversations WHERE role = 'user' AND length(text) >= 12)
SELECT question, count(*) AS n, arg_min(text, conv_id * 1000 + turn) AS shown FROM u GROUP BY 1 ORDER BY n DESC, question LIMIT 20""")
def top_questions(spark, sf_dir):
    """The most asked questions of a window, long enough, shown as first asked."""
    asked = read(spark, sf_dir, "conversations").where("role = 'user' AND char_length(text) >= 12")
    return asked.groupBy(T.normalized(F.col("text")).alias("question")).agg(F.count("*").alias("n"), F.min_by("text", F.struct("conv_id", "turn")).alias("shown")).orderBy(F.desc("n"), "question").limit(20)
