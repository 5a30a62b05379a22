"""Queries of verification, evaluation and conversation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.urls import normalized_url
from gleanery.operators import conversation as C
from gleanery.operators import evaluation as E
from gleanery.operators import verification as V
from gleanery.plans.common import STOPWORDS, Family, read, sql_in, sql_text
from gleanery.plans.url_queries import _NORMAL

FAMILY = Family()
query = FAMILY.query
_TOK = sql_text(T.TOKENIZERS["word"])

# an assistant's turn is held against the user's turn before it
_PAIRS = "SELECT a.conv_id, a.turn, u.text AS premise, a.text AS claim FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'"
_ENTAIL = f"""SELECT conv_id, turn, CASE WHEN trim(premise) = '' THEN 0.0 WHEN len(list_filter(n, lambda x: NOT contains(premise, x))) > 0 THEN 0.2 WHEN len(s) = 0 THEN 1.0 WHEN o < 0.3 THEN o ELSE least(1.0, 0.6 + 0.4 * o) END::DOUBLE AS support FROM (
SELECT *, len(list_intersect(s, regexp_extract_all(lower(premise), {_TOK}))) / nullif(len(s), 0) AS o FROM (
SELECT *, list_filter(list_distinct(regexp_extract_all(lower(claim), {_TOK})), lambda t: length(t) > 2 AND t NOT IN {sql_in(STOPWORDS)}) AS s, regexp_extract_all(claim, '[0-9][0-9.,]*[0-9]') AS n FROM ({_PAIRS})))"""


def _entailed(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("premise"))
    said = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return said.select("conv_id", "turn", V.lexical_entailment(F.col("premise"), F.col("text"), STOPWORDS).alias("support"))


@query(f"SELECT conv_id, turn, round(support, 6) AS support FROM ({_ENTAIL})")
def entailment_lexical(spark, sf_dir):
    return _entailed(spark, sf_dir).withColumn("support", F.round("support", 6))


@query(f"""SELECT answer_id, claims, supported, round(supported / claims, 6) AS score, CASE WHEN supported / claims >= 0.9 THEN 'grounded' WHEN supported / claims >= 0.7 THEN 'partly' ELSE 'refused' END AS decision FROM (
SELECT conv_id AS answer_id, count(*) AS claims, count(*) FILTER (support >= 0.05) AS supported FROM ({_ENTAIL}) GROUP BY 1)""")
def groundedness_decision(spark, sf_dir):
    return V.groundedness(_entailed(spark, sf_dir).withColumnRenamed("conv_id", "answer_id"), 0.05)


@query("""WITH c AS (SELECT l_orderkey AS answer_id, l_linenumber AS claim, CASE WHEN l_quantity > 10 THEN l_returnflag = 'N' END AS supports FROM lineitem),
g AS (SELECT answer_id, claim, count(supports) AS n, count(*) FILTER (supports) AS good FROM c GROUP BY 1, 2)
SELECT answer_id, round(coalesce(sum(good) / nullif(sum(n), 0), 0), 6)::DOUBLE AS precision, round(count(*) FILTER (good > 0) / count(*), 6)::DOUBLE AS recall FROM g GROUP BY 1""")
def citation_precision_recall(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    return V.citation_scores(items.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("claim"), F.when(F.col("l_quantity") > 10, F.col("l_returnflag") == "N").alias("supports")))


GRID = [i / 20 for i in range(20)]
_RECORDS = "SELECT (n_chars % 97) / 97.0::DOUBLE AS confidence, quality = 1 AS correct FROM labels JOIN documents USING (doc_id)"
_CURVE = f"SELECT threshold, count(*) FILTER (confidence >= threshold) AS n, round(count(*) FILTER (confidence >= threshold) / count(*), 6)::DOUBLE AS coverage, round(coalesce(count(*) FILTER (confidence >= threshold AND NOT correct) / nullif(count(*) FILTER (confidence >= threshold), 0), 0), 6)::DOUBLE AS risk FROM ({_RECORDS}), (SELECT unnest({GRID})::DOUBLE AS threshold) GROUP BY 1"


def _curve(spark, sf_dir):
    met = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return V.risk_coverage(met.select(((F.col("n_chars") % 97) / 97.0).alias("confidence"), (F.col("quality") == 1).alias("correct")), GRID)


@query(_CURVE)
def risk_coverage(spark, sf_dir):
    return _curve(spark, sf_dir)


@query(f"SELECT min(threshold) FILTER (risk + sqrt(ln(1 / 0.1) / (2 * nullif(n, 0))) <= 0.35) AS threshold FROM ({_CURVE})")
def conformal_threshold(spark, sf_dir):
    return V.certified_threshold(_curve(spark, sf_dir), 0.35, 0.1)


@query(f"""WITH n AS (SELECT page_id, url, normalized AS key FROM ({_NORMAL})), c AS (SELECT page_id % 20 AS answer_id, page_id AS pos, CASE WHEN page_id % 4 = 0 THEN url || '#x' WHEN page_id % 4 = 1 THEN 'https://nowhere.example/' ELSE url END AS url FROM n),
k AS (SELECT answer_id, pos, c.url, CASE WHEN c.pos % 4 = 1 THEN 'https://nowhere.example' ELSE n.key END AS key FROM c JOIN n ON n.page_id = c.pos),
v AS (SELECT answer_id, key, min(pos) AS pos, arg_min(url, pos) AS url FROM k WHERE key IN (SELECT key FROM n) GROUP BY 1, 2)
SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS INTEGER) AS number, url FROM v""")
def citation_validation(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    url = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("#x"))).when(F.col("page_id") % 4 == 1, "https://nowhere.example/").otherwise(F.col("url"))
    return V.validated_citations(pages.select((F.col("page_id") % 20).alias("answer_id"), F.col("page_id").alias("pos"), url.alias("url")), pages.select("url"), normalized_url)


@query("SELECT CASE WHEN a AND b THEN 'wrong_abstention' WHEN a THEN 'answered' WHEN b THEN 'correct_abstention' ELSE 'hallucination_risk' END AS outcome, count(*) AS n FROM (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels) GROUP BY 1")
def abstention_outcomes(spark, sf_dir):
    return read(spark, sf_dir, "labels").groupBy(V.abstention(F.col("quality") == 1, F.col("toxic") == 1).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) AS n, round(avg((r <= 1)::INT), 6) AS hit_1, round(avg((r <= 3)::INT), 6) AS hit_3, round(avg((r <= 10)::INT), 6) AS hit_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM (SELECT lang, coalesce(rank, 99) AS r, rank FROM (SELECT lang, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 13 + 1 END AS rank FROM documents)) GROUP BY 1""")
def ranking_metrics(spark, sf_dir):
    rank = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 13 + 1)
    return E.ranking_metrics(read(spark, sf_dir, "documents").select("lang", rank.alias("rank")), ["lang"])


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, v[greatest(0, CAST(ceil(round(0.95 * n, 9)) AS INT) - 1) + 1] AS ceil_value, v[greatest(0, CAST(floor(round(0.95 * n, 9)) AS INT) - 1) + 1] AS floor_value, v[least(n - 1, CAST(floor(round(0.95 * n, 9)) AS INT)) + 1] AS index_value FROM s""")
def percentiles_three_rules(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_type", "value")
    a, b, c = (E.percentile_by_rank(events, ["event_type"], "value", 0.95, rule) for rule in ("ceil", "floor", "index"))
    return a.join(b, "event_type").join(c, "event_type")


@query("""SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE n <= 7 OR i IN (SELECT CAST(floor(j * n / 7) AS BIGINT) FROM range(7) t(j))""")
def stratified_even(spark, sf_dir):
    return E.evenly_spaced(read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 7)


@query("""SELECT c_mktsegment, c_custkey, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s1' || c_custkey), c_custkey) AS turn FROM customer) ORDER BY turn, c_mktsegment LIMIT 37""")
def stratified_round_robin(spark, sf_dir):
    return E.round_robin(read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 37, "s1")


@query("""WITH t AS (SELECT 'AFRICA' AS category, unnest(['where is {}?', 'who sells in {}?']) AS template UNION ALL SELECT 'ASIA', 'how far is {}?'),
f AS (SELECT DISTINCT category, replace(template, '{}', n_name) AS question FROM t JOIN region ON r_name = category JOIN nation ON n_regionkey = r_regionkey)
SELECT category || '_' || lpad(row_number() OVER (PARTITION BY category ORDER BY question)::VARCHAR, 4, '0') AS id, category, question FROM f""")
def template_expansion(spark, sf_dir):
    templates = spark.sql("SELECT * FROM VALUES ('AFRICA', 'where is {}?'), ('AFRICA', 'who sells in {}?'), ('ASIA', 'how far is {}?') AS t(category, template)")
    names = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("category"), F.col("n_name").alias("name"))
    return E.expanded_templates(templates, names)


@query("""WITH a AS (SELECT l_shipdate::DATE AS day, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_shipdate::DATE AS day, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, a.v AS before, b.v AS after, round(b.v - a.v, 2) AS delta, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN b.v > a.v THEN 'up' WHEN b.v < a.v THEN 'down' ELSE 'same' END AS status FROM a FULL JOIN b USING (day)""")
def compare_runs_full_outer(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    run = lambda s: items.where(F.col("l_linestatus") == s).groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return E.compared(run("F"), run("O"), "day", "v").withColumn("delta", F.round("delta", 2))


@query("""SELECT o_orderpriority, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6)::DOUBLE AS false_positive_rate FROM (SELECT o_orderpriority, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (e AND NOT p) AS fn
FROM (SELECT *, o_orderstatus = 'F' AS e, o_totalprice > 100000 AS p FROM orders) GROUP BY 1)""")
def confusion_matrix(spark, sf_dir):
    records = read(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("expected"), (F.col("o_totalprice") > 100000).alias("predicted"))
    return E.confusion(records, ["o_orderpriority"])


@query("SELECT user_id, event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER w::DOUBLE / count(*) OVER w / 100.0::DOUBLE AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_average(spark, sf_dir):
    """Means of cents, so that they do not depend on the order in which doubles are added."""
    events = read(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return events.select("user_id", "event_id", (E.running_mean(events, ["user_id"], ["ts", "event_id"], "cents") / 100.0).alias("mean"))


@query("SELECT n_nationkey, n_name, coalesce(lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS other FROM nation")
def negative_pairs(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name", E.cyclic_next("n_name", ["n_regionkey"], "n_nationkey").alias("other"))


@query("SELECT * FROM (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS from_end FROM conversations) WHERE from_end <= 3")
def conversation_last_n(spark, sf_dir):
    return C.last_turns(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3)


_ENT = r"regexp_extract(lower(text), '(^|[^a-z])(thing|tion|for|this)([^a-z]|$)', 2)"


@query(f"""WITH t AS (SELECT *, CASE WHEN role = 'user' THEN nullif({_ENT}, '') END AS own FROM conversations)
SELECT conv_id, turn, coalesce(own, CASE WHEN role = 'user' THEN last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END) AS entity FROM t""")
def conversation_sticky_entity(spark, sf_dir):
    entity = F.nullif(F.regexp_extract(F.lower("text"), "(^|[^a-z])(thing|tion|for|this)([^a-z]|$)", 2), F.lit(""))
    return C.sticky(read(spark, sf_dir, "conversations"), entity).select("conv_id", "turn", "entity")


@query(f"""WITH u AS (SELECT *, {_ENT} AS intent FROM conversations WHERE role = 'user'), l AS (SELECT *, lag(intent) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM u)
SELECT conv_id, turn, sure::DOUBLE AS followup_confidence, sure >= 0.75 AS followup FROM (SELECT *, CASE WHEN before IS NULL THEN 0.1 WHEN length(text) < 60 THEN 0.9 WHEN intent = before THEN 0.8 ELSE 0.3 END AS sure FROM l)""")
def conversation_followup(spark, sf_dir):
    intent = F.regexp_extract(F.lower("text"), "(^|[^a-z])(thing|tion|for|this)([^a-z]|$)", 2)
    found = C.followups(read(spark, sf_dir, "conversations"), intent, F.char_length("text") < 60)
    return found.select("conv_id", "turn", "followup_confidence", "followup")


@query("""WITH s AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)),
e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS epoch, CASE WHEN event_type IN ('click', 'purchase') THEN value END AS slot FROM s)
SELECT event_id, CAST(session AS BIGINT) AS session, last_value(slot IGNORE NULLS) OVER (PARTITION BY user_id, session, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM e""")
def session_memory_slots(spark, sf_dir):
    slot = F.when(F.col("event_type").isin("click", "purchase"), F.col("value"))
    return C.session_slots(read(spark, sf_dir, "events"), slot, F.col("event_type") == "signup", 1800).select("event_id", "session", "carried")
