"""Queries of retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import scores as S
from gleanery.functions import text as T
from gleanery.operators import inverted as N
from gleanery.operators import retrieval as R
from gleanery.plans.common import Family, read, sql_text

FAMILY = Family()
query = FAMILY.query
_WORDS = f"regexp_extract_all(lower(text), {sql_text(T.TOKENIZERS['word'])})"

_KNN = """SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id"""


def _queries(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors.select("vec_id", "embedding")


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM ({_KNN})) WHERE rank <= 10")
def knn_cosine_topk(spark, sf_dir):
    return R.knn(*_queries(spark, sf_dir), k=10)


@query(f"SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM ({_KNN})) WHERE rank = 1 AND similarity >= 0.3")
def semantic_cache_hits(spark, sf_dir):
    """The nearest earlier answer, if it is near enough."""
    return R.knn(*_queries(spark, sf_dir), k=1).where("similarity >= 0.3").drop("rank")


# an inverted file; cached questions are vectors with a part of the next one mixed in
_FILE = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT a.vec_id AS query_id, list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] + (0.2 + (a.vec_id % 7) / 20) * b.v[i]) AS q FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"""


def _file(spark, sf_dir, lists=16):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return N.inverted_file(vectors, N.fit_centroids(vectors, lists))


def _asked_again(spark, sf_dir):
    """Every vector with a part of the next one, as questions put in other words."""
    vectors = read(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("w"))
    share = 0.2 + (F.col("vec_id") % 7) / 20
    both = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(after, "vec_id")
    return both.select((-F.col("vec_id") - 1).alias("query_id"), F.zip_with("v", "w", lambda a, b: a + share * b).alias("embedding"))


@query(f"""WITH {_FILE}, s AS (SELECT -query_id - 1 AS query_id, vec_id, round(list_cosine_similarity(q, v), 6) AS similarity FROM c JOIN e ON list_cosine_similarity(q, v) >= 0.92)
SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r = 1""")
def semantic_cache(spark, sf_dir):
    """Answers to earlier questions that are near enough, by an inverted file: exact, as the threshold bounds what is read."""
    return N.cached(_asked_again(spark, sf_dir), _file(spark, sf_dir), 0.92)


@query(f"""WITH {_FILE} SELECT -query_id - 1 AS query_id, vec_id, round(list_cosine_similarity(q, v), 6) AS similarity FROM c JOIN e ON label = 3 AND list_cosine_similarity(q, v) >= 0.35""")
def vectors_within(spark, sf_dir):
    """All vectors of a label within a threshold; the filter is pushed into the lists."""
    return N.within(_asked_again(spark, sf_dir), _file(spark, sf_dir), 0.35, F.col("label") == 3)


@query()
def knn_inverted_file(spark, sf_dir):
    """About the ten nearest, from 12 of 16 lists; recall is held against knn_cosine_topk in tests."""
    return N.nearest(_queries(spark, sf_dir)[0], _file(spark, sf_dir), 10, 12)


# two rankings of orders by customer segment
_LISTS = """WITH o AS (SELECT o_orderkey AS id, o_custkey % 10 AS query_id, o_totalprice, o_orderdate FROM orders),
a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o_totalprice DESC, id) AS rank FROM o),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o_orderdate DESC, id) AS rank FROM o),
l AS (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS fused FROM l GROUP BY 1, 2)"""


def _lists(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("query_id"), "o_totalprice", "o_orderdate")
    return [R.ranked(orders, ["query_id"], F.desc(c), F.col("id")).where("rank <= 50") for c in ("o_totalprice", "o_orderdate")]


@query(f"{_LISTS} SELECT query_id, id, round(fused, 9) AS fused FROM f")
def rrf_fusion(spark, sf_dir):
    fused = R.reciprocal_rank_fusion(_lists(spark, sf_dir))
    return fused.select("query_id", "id", F.round("fused", 9).alias("fused"))


_FACTS = "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.5 ELSE 0.25 END::DOUBLE AS authority, CASE o_orderstatus WHEN 'F' THEN 0.4 ELSE 1.0 END::DOUBLE AS freshness, (o_orderkey % 120 - 50)::DOUBLE AS topic FROM orders"


@query(f"""{_LISTS}, m AS (SELECT *, min(fused) OVER (PARTITION BY query_id) AS lo, max(fused) OVER (PARTITION BY query_id) AS hi FROM f),
s AS (SELECT query_id, id, round(CASE WHEN hi = lo THEN 1.0 ELSE (fused - lo) / (hi - lo) END + greatest(-0.5, least(1.75, topic / 50)) + authority + 0.5 * freshness, 6) AS score FROM m JOIN ({_FACTS}) USING (id))
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def trust_fused_rank(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    authority = F.when(F.col("o_orderpriority") == "1-URGENT", 0.9).when(F.col("o_orderpriority") == "2-HIGH", 0.5).otherwise(0.25)
    facts = o.select(F.col("o_orderkey").alias("id"), authority.alias("authority"), F.when(F.col("o_orderstatus") == "F", 0.4).otherwise(1.0).alias("freshness"), (F.col("o_orderkey") % 120 - 50).cast("double").alias("topic"))
    return R.fuse_and_rank(_lists(spark, sf_dir), facts, 10).select("query_id", "id", "score", "rank")


@query("""WITH c AS (SELECT p_size AS query_id, p_partkey AS id, p_retailprice AS score, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
m AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM c),
s AS (SELECT query_id, id, rank, CASE WHEN rank <= 20 THEN CASE WHEN id % 7 = 0 THEN CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END ELSE 0.8 * ((id * 37) % 101 / 100.0)::DOUBLE + (1 - 0.8::DOUBLE) * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END END END AS final FROM m)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final IS NULL, round(final, 9) DESC, rank) AS INTEGER) AS new_rank FROM s""")
def minmax_rerank(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    model = parts.where("id % 7 <> 0").select("query_id", "id", ((F.col("id") * 37) % 101 / 100.0).alias("model"))
    return R.model_rerank(R.ranked(parts, ["query_id"], F.desc("score"), F.col("id")), model, 20).select("query_id", "id", "new_rank")


@query("""SELECT page_id, round(0.5 + CASE kind WHEN 0 THEN 0.15 WHEN 1 THEN -0.1 ELSE 0 END + 0.2 * sure - CASE WHEN sure < 0.5 THEN 0.25 ELSE 0 END, 6)::DOUBLE AS score FROM (
SELECT page_id, page_id % 3 AS kind, CASE WHEN page_id % 5 = 0 THEN 0.5 ELSE (page_id % 10) / 10.0 END AS sure FROM pages)""")
def heuristic_rerank(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "html").when(F.col("page_id") % 3 == 1, "audio").otherwise("document")
    sure = F.when(F.col("page_id") % 5 != 0, (F.col("page_id") % 10) / 10.0)
    return read(spark, sf_dir, "pages").select("page_id", F.round(0.5 + R.heuristic_boost(kind, sure), 6).alias("score"))


# articles of a size are the candidates of a query; sources, confidences and dates come with them
_CANDIDATES = """c AS (SELECT p_size AS query_id, p_partkey AS id, p_retailprice / 1000 AS score, CASE p_type WHEN 'ECONOMY' THEN 'html' WHEN 'PROMO' THEN 'audio' ELSE 'text' END AS source_type, CASE WHEN p_type <> 'SMALL' THEN length(p_name) / 15.0 END::DOUBLE AS confidence,
CASE WHEN contains(p_brand, '1') THEN 0.9 ELSE 0.25 END AS authority, CASE WHEN contains(p_name, 'r') THEN 0.4 END AS freshness FROM part),
b AS (SELECT *, CASE source_type WHEN 'html' THEN 0.15 WHEN 'audio' THEN -0.1 ELSE 0 END + CASE WHEN confidence IS NULL THEN 0 ELSE 0.2::DOUBLE * confidence - CASE WHEN confidence < 0.5 THEN 0.25 ELSE 0 END END AS boost FROM c),
f AS (SELECT *, score + boost AS relevance, round(score + boost + 1.0 * authority + 0.5 * coalesce(freshness, 1.0), 6) AS final FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM f)"""


def _candidates(spark, sf_dir):
    kind = F.when(F.col("p_type") == "ECONOMY", "html").when(F.col("p_type") == "PROMO", "audio").otherwise("text")
    sure, fresh = F.when(F.col("p_type") != "SMALL", F.char_length("p_name") / 15.0), F.when(F.contains("p_name", F.lit("r")), 0.4)
    return read(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000).alias("score"), kind.alias("source_type"), sure.alias("confidence"), F.when(F.contains("p_brand", F.lit("1")), 0.9).otherwise(0.25).alias("authority"), fresh.alias("freshness"))


@query(f"WITH {_CANDIDATES} SELECT query_id, id, round(relevance, 6)::DOUBLE AS relevance, final::DOUBLE AS score, false AS reranked, CAST(rank AS INTEGER) AS rank FROM r")
def trust_rerank(spark, sf_dir):
    """Retrieval scores with what the source adds, authority and freshness."""
    return R.reranked(_candidates(spark, sf_dir))


@query(f"""WITH {_CANDIDATES}, h AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, bool_and(query_id % 5 <> 0 OR id % 2 = 0) OVER w AS told FROM r WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)),
a AS (SELECT query_id, id, 0.8::DOUBLE * (length(p_name) / 20.0)::DOUBLE + (1 - 0.8::DOUBLE) * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END + boost AS again FROM h JOIN part ON p_partkey = id WHERE told),
m AS (SELECT r.query_id, r.id, again IS NOT NULL AS reranked, round(coalesce(again, relevance), 6) AS relevance, CASE WHEN again IS NULL THEN final ELSE round(again + 1.0 * authority + 0.5 * coalesce(freshness, 1.0), 6) END AS score FROM r LEFT JOIN a USING (query_id, id))
SELECT query_id, id, relevance::DOUBLE AS relevance, score::DOUBLE AS score, reranked, CAST(row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, score DESC, id) AS INTEGER) AS rank FROM m""")
def trust_model_rerank(spark, sf_dir):
    """The first twenty of a query by a model's scores, where it has told all of them."""
    part = read(spark, sf_dir, "part").where("p_size % 5 <> 0 OR p_partkey % 2 = 0")
    model = part.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("id"), (F.char_length("p_name") / 20.0).alias("model"))
    return R.reranked(_candidates(spark, sf_dir), model)


@query(f"""WITH {_CANDIDATES}, n AS (SELECT query_id, count(*) FILTER (authority >= 0.5) AS n FROM r GROUP BY 1),
t AS (SELECT query_id, n, CASE WHEN source_type IN ('html', 'audio') AND NOT coalesce(confidence < 0.6, false) THEN CASE WHEN score * (12 / 0.95::DOUBLE) >= 12 THEN 0.95 ELSE 0.85 END END AS s, authority >= 0.5 AS o FROM r JOIN n USING (query_id) WHERE rank = 1)
SELECT query_id, coalesce(s, CASE WHEN o AND n >= 2 THEN 0.7 WHEN o THEN 0.55 WHEN n >= 1 THEN 0.4 ELSE 0.2 END)::DOUBLE AS confidence, coalesce(s, CASE WHEN o AND n >= 2 THEN 0.7 ELSE 0 END) >= 0.7 AS sufficient FROM t""")
def retrieval_sufficiency(spark, sf_dir):
    """Whether what was found is enough to look no further."""
    first = R.reranked(_candidates(spark, sf_dir)).select("query_id", "id", "rank")
    rows = first.join(_candidates(spark, sf_dir), ["query_id", "id"]).withColumn("demoted", F.col("confidence") < 0.6)
    return R.sufficiency(rows.withColumn("score", F.col("score") * (12 / 0.95)), ["html", "audio"])


@query(f"""WITH f AS (SELECT item_id AS faq_id, text FROM benchmark), q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN regexp_replace(text, '[^ ]+ [^ ]+ ', '') ELSE text || ' ' || text || ' again' END AS text FROM benchmark),
fw AS (SELECT faq_id, list_distinct({_WORDS}) AS w, trim(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS n FROM f),
qw AS (SELECT query_id, list_distinct({_WORDS}) AS w, trim(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS n FROM q),
m AS (SELECT query_id, faq_id, qw.n = fw.n AS same, CASE WHEN qw.n = fw.n THEN 1.0 ELSE round(2.0 * len(list_intersect(qw.w, fw.w)) / (len(qw.w) + len(fw.w)), 6) END::DOUBLE AS dice FROM qw, fw)
SELECT query_id, faq_id, dice, CASE WHEN same THEN 14.0 ELSE 12.0 END::DOUBLE AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dice DESC, faq_id) AS rank FROM m WHERE dice >= 0.62) WHERE rank <= 2""")
def faq_dice_match(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    asked = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).when(F.col("item_id") % 3 == 1, F.regexp_replace("text", F.lit("^(.*?)[^ ]+ [^ ]+ "), F.lit("$1"))).otherwise(F.concat("text", F.lit(" "), "text", F.lit(" again")))
    return R.faq_match(items.select(F.col("item_id").alias("query_id"), asked.alias("text")), items.select(F.col("item_id").alias("faq_id"), F.col("text").alias("question")))


@query(f"""WITH w AS (SELECT doc_id, source, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, source, len(list_filter(w, lambda t: t IN ('the', 'des', 'die'))) AS positive, len(list_filter(w, lambda t: t IN ('password', 'license'))) AS negative, len(list_intersect(list_distinct(w), ['of', 'and', 'und', 'et'])) / 4.0 AS overlap, CASE WHEN source IN ('src0', 'src1') THEN 1 ELSE 0 END AS host FROM w),
a AS (SELECT *, round(greatest(0.0, least(1.0, 0.45 * least(positive / 3, 1.0) + 0.35 * overlap + 0.2 * host - 0.15 * least(negative, 3))), 6)::DOUBLE AS answerability FROM c)
SELECT doc_id, answerability, CASE WHEN source = 'src9' THEN 'disallowed_host' WHEN negative > positive THEN 'negative_terms' WHEN answerability < 0.35 THEN 'low_answerability' ELSE 'kept' END AS decision FROM a""")
def intent_answerability_gate(spark, sf_dir):
    w = T.tokens(F.col("text"))
    count = lambda *terms: F.size(F.filter(w, lambda t: t.isin(*terms)))
    overlap = F.size(F.array_intersect(w, F.array(*[F.lit(t) for t in ("of", "and", "und", "et")]))) / 4.0
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", count("the", "des", "die").alias("positive"), count("password", "license").alias("negative"), overlap.alias("overlap"), F.col("source").isin("src0", "src1").cast("int").alias("host"))
    rows = rows.withColumn("answerability", F.round(R.answerability(F.col("positive"), F.col("overlap"), F.col("host"), F.col("negative")), 6))
    decision = F.when(F.col("source") == "src9", "disallowed_host").when(F.col("negative") > F.col("positive"), "negative_terms").when(F.col("answerability") < 0.35, "low_answerability").otherwise("kept")
    return rows.select("doc_id", "answerability", decision.alias("decision"))


@query("""WITH e AS (SELECT l_partkey % 40 AS query_id, l_orderkey AS id, max(l_quantity) AS score, 0 AS layer, true AS pinned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2
UNION ALL SELECT l_partkey % 40, l_orderkey, max(l_extendedprice), 1, false FROM lineitem GROUP BY 1, 2),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY layer) = 1)
SELECT query_id, id, score, layer, pinned, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, score DESC, layer, id) AS rank FROM f) WHERE rank <= 12""")
def pinned_layer_merge(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("query_id"), F.col("l_orderkey").alias("id"), "l_quantity", "l_extendedprice", "l_returnflag")
    returned = items.where("l_returnflag = 'R'").groupBy("query_id", "id").agg(F.max("l_quantity").alias("score"))
    return R.pinned_merge([(returned, True), (items.groupBy("query_id", "id").agg(F.max("l_extendedprice").alias("score")), False)], 12)


@query("""SELECT o_custkey AS query_id, CASE WHEN t >= 12 AND f >= 1 THEN 0.95 WHEN t >= 10 THEN 0.85 WHEN f >= 2 AND n >= 3 THEN 0.7 WHEN f >= 1 THEN 0.55 WHEN n >= 1 THEN 0.4 ELSE 0.2 END::DOUBLE AS confidence FROM (
SELECT c_custkey AS o_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS f, max(o_totalprice) / 30000 AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def retrieval_confidence(spark, sf_dir):
    met = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    found = met.groupBy(F.col("c_custkey").alias("query_id")).agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("official"), (F.max("o_totalprice") / 30000).alias("top"))
    return found.select("query_id", R.confidence_ladder(F.col("top"), F.col("official"), F.col("n")).alias("confidence"))


@query("""WITH t AS (SELECT item_id, unnest(['nation', 'supplier', 'customer']) AS kind, item_id % 25 AS k FROM benchmark),
c AS (SELECT item_id, 'nation' AS kind, n_name AS name, 'name: ' || n_name || '. region: ' || r_name AS card, 7 AS score FROM t JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey WHERE kind = 'nation'
UNION ALL SELECT item_id, 'supplier', s_name, 'name: ' || s_name || CASE WHEN s_acctbal > 0 THEN '. balance: ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) ELSE '' END, 10 FROM t JOIN supplier ON s_nationkey = k WHERE kind = 'supplier')
SELECT item_id, kind, name, card, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, kind, name) AS rank FROM c) WHERE rank <= 6""")
def entity_lookup_priority(spark, sf_dir):
    """Entity cards, attributes without a value left out, the best six for each query."""
    wanted = read(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 25).cast("int").alias("k"))
    nation, region, supplier = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    card = lambda **fields: F.concat_ws(". ", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()])
    nations = wanted.join(nation, F.col("n_nationkey") == F.col("k")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    nations = nations.select("item_id", F.lit("nation").alias("kind"), F.col("n_name").alias("name"), card(name=F.col("n_name"), region=F.col("r_name")).alias("card"), F.lit(7).alias("score"))
    balance = F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal").cast("string"))
    suppliers = wanted.join(supplier, F.col("s_nationkey") == F.col("k")).select("item_id", F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), card(name=F.col("s_name"), balance=balance).alias("card"), F.lit(10).alias("score"))
    return R.ranked(nations.unionByName(suppliers), ["item_id"], F.desc("score"), F.col("kind"), F.col("name")).where("rank <= 6")


@query("SELECT vec_id, label, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 9) AS p FROM embeddings")
def sigmoid_scores(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(S.sigmoid(F.col("embedding")[0].cast("double")), 9).alias("p"))
