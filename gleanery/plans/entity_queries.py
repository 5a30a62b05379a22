"""Queries of entities: regions, nations, articles, brands, types and segments, asked for by questions about orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import entities as E
from gleanery.operators import layers as L
from gleanery.plans.common import Family, read, sql_in, sql_list, sql_text

FAMILY = Family()
query = FAMILY.query

RULES = E.EntityRules(
    lookups=(
        E.Lookup("region", ("region", "in", "continent"), {"orient": "ASIA", "new world": "AMERICA"}, default=3),
        E.Lookup("nation", ("nation", "nations", "in", "price of"), default=4, quiet=("article",)),
        E.Lookup("article", ("price", "type", "price of")),
        E.Lookup("brand", ("brand", "brands"), {"house brand": "Brand#2"}, default=2),
        E.Lookup("type", ("type", "types", "price"), {"cheap": "ECONOMY"}, default=6, quiet=("article",)),
        E.Lookup("segment", ("segment", "customers"), {"cars": "AUTO", "industry": "IN"}, contains=True, default=5),
    ),
    guards=(("type", "article", ("types", "kind of")),),
    demotions=((("price",), ("article", "nation")), (("customers",), ("segment",))),
    orders=((("price of", "price"), ("article", "nation")), (("type",), ("type", "article"))),
    order=("segment", "region"),
)

_QUESTIONS = """q AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 9 WHEN 0 THEN 'Price of the ' || p_name || ' in ' || n_name WHEN 1 THEN 'which segment is ' || lower(c_mktsegment) || ', or cars?' WHEN 2 THEN 'brand list for ' || p_brand || ' and house brand'
WHEN 3 THEN 'the region ' || r_name || ' or orient, in short' WHEN 4 THEN 'cheap or ' || p_type || ' types' WHEN 5 THEN 'what nations are there' WHEN 6 THEN p_name || ' type ' || p_type WHEN 7 THEN 'kind of ' || p_name || ' types for customers of the new world' ELSE p_brand END AS text
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON p_partkey = l_partkey)"""


def _questions(spark, sf_dir):
    t = {n: read(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region", "lineitem", "part")}
    met = t["orders"].join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).join(t["nation"], F.col("n_nationkey") == F.col("c_nationkey")).join(t["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    met = met.join(t["lineitem"].where("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey")).join(t["part"], F.col("p_partkey") == F.col("l_partkey"))
    of, n = lambda *parts: F.concat(*[p if p in met.columns else F.lit(p) for p in parts]), F.col("o_orderkey") % 9
    texts = [of("Price of the ", "p_name", " in ", "n_name"), F.concat(F.lit("which segment is "), F.lower("c_mktsegment"), F.lit(", or cars?")), of("brand list for ", "p_brand", " and house brand"), of("the region ", "r_name", " or orient, in short")]
    texts += [of("cheap or ", "p_type", " types"), F.lit("what nations are there"), of("p_name", " type ", "p_type"), of("kind of ", "p_name", " types for customers of the new world"), F.col("p_brand")]
    return met.select(F.col("o_orderkey").alias("query_id"), F.coalesce(*[F.when(n == i, x) for i, x in enumerate(texts)]).alias("text"))


_ENTITIES = """e AS (SELECT 'region' AS kind, 'r' || r_regionkey AS entity_id, r_name AS name, 'Region: ' || r_name || '.' AS card, 0.9 AS confidence FROM region
UNION ALL SELECT 'nation', 'n' || n_nationkey, n_name, 'Nation: ' || n_name || CASE WHEN n_regionkey < 3 THEN '. Region: ' || r_name ELSE '' END || '.', CASE WHEN n_regionkey < 3 THEN 0.9 END FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'article', 'a' || p_name, p_name, 'Article: ' || p_name || '. Price: ' || CAST(min(floor(p_retailprice)) AS BIGINT) || '.', CASE WHEN count(*) > 40 THEN 0.8 ELSE 0.3 END FROM part GROUP BY p_name
UNION ALL SELECT 'brand', 'b' || p_brand, p_brand, 'Brand: ' || p_brand || '.', 0.5 FROM part GROUP BY p_brand
UNION ALL SELECT 'type', 't' || p_type, p_type, 'Type: ' || p_type || '.', 0.95 FROM part GROUP BY p_type
UNION ALL SELECT 'segment', 's' || c_mktsegment, c_mktsegment, 'Segment: ' || c_mktsegment || '. Customers: ' || count(*) || '.', 0.8 FROM customer GROUP BY c_mktsegment)"""


def _entities(spark, sf_dir):
    """All kinds as one union."""
    region, nation, part, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "part", "customer"))
    row = lambda f, kind, key, name, confidence, **fields: f.select(F.lit(kind).alias("kind"), F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("entity_id"), F.col(name).alias("name"), E.card(fields).alias("card"), confidence.cast("double").alias("confidence"))
    nations = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    near = F.col("n_regionkey") < 3
    articles = part.groupBy("p_name").agg(F.min(F.floor("p_retailprice")).alias("least"), F.count("*").alias("n"))
    segments = customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    out = row(region, "region", "r_regionkey", "r_name", F.lit(0.9), Region=F.col("r_name"))
    for more in (
        row(nations, "nation", "n_nationkey", "n_name", F.when(near, 0.9), Nation=F.col("n_name"), Region=F.when(near, F.col("r_name"))),
        row(articles, "article", "p_name", "p_name", F.when(F.col("n") > 40, 0.8).otherwise(0.3), Article=F.col("p_name"), Price=F.col("least").cast("string")),
        row(part.select("p_brand").distinct(), "brand", "p_brand", "p_brand", F.lit(0.5), Brand=F.col("p_brand")),
        row(part.select("p_type").distinct(), "type", "p_type", "p_type", F.lit(0.95), Type=F.col("p_type")),
        row(segments, "segment", "c_mktsegment", "c_mktsegment", F.lit(0.8), Segment=F.col("c_mktsegment"), Customers=F.col("n").cast("string")),
    ):
        out = out.unionByName(more)
    return out


_WORDS = lambda text: f"list_filter(regexp_extract_all(lower({text}), {sql_text(T.TOKENIZERS['hyphenated'])}), lambda t: length(t) > 1)"
_HAS = lambda words: "(" + " OR ".join(f"contains(' ' || plain || ' ', {sql_text(f' {w} ')})" for w in words) + ")"


def _sql(rules: E.EntityRules) -> str:
    """The same rules in SQL."""
    alias = ", ".join(f"('{x.kind}', '{a}', '{t}', {str(x.contains).lower()})" for x in rules.lookups for a, t in x.aliases.items())
    gates = "list_filter([" + ", ".join(f"CASE WHEN {_HAS(x.gate)} THEN '{x.kind}' END" for x in rules.lookups) + "], lambda x: x IS NOT NULL)"
    silent = "list_filter([" + ", ".join(f"CASE WHEN list_has_any(named, {sql_list([x.kind, *x.quiet])}) THEN '{x.kind}' END" for x in rules.lookups) + "], lambda x: x IS NOT NULL)"
    limits = "CASE kind " + " ".join(f"WHEN '{x.kind}' THEN {min(x.default, rules.most)}" for x in rules.lookups) + " END"
    guards = " AND ".join(f"(kind <> '{k}' OR NOT list_contains(named, '{o}') OR {_HAS(w)})" for k, o, w in rules.guards)
    demoted = "CASE " + " ".join(f"WHEN {_HAS(w)} THEN kind NOT IN {sql_in(fit)}" for w, fit in rules.demotions) + " ELSE false END"
    place = lambda order: "CASE kind " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(order)) + " ELSE 1000 END"
    first = "CASE " + " ".join(f"WHEN {_HAS(w)} THEN {place(o)}" for w, o in rules.orders) + f" ELSE {place(rules.order)} END"
    return f"""WITH {_QUESTIONS}, {_ENTITIES}, w AS (SELECT query_id, {_WORDS('text')} AS w, array_to_string({_WORDS('text')}, ' ') AS plain FROM q),
al(kind, alias, target, part) AS (VALUES {alias}),
p AS (SELECT e.kind, entity_id, alias AS phrase FROM e JOIN al ON al.kind = e.kind AND CASE WHEN part THEN contains(lower(name), lower(target)) ELSE lower(name) = lower(target) END UNION SELECT kind, entity_id, array_to_string({_WORDS('name')}, ' ') FROM e WHERE length(array_to_string({_WORDS('name')}, ' ')) >= 4),
r AS (SELECT query_id, s AS beg, s + n AS fin, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) + 1)) AS s FROM w), generate_series(1, 4) AS g(n) WHERE s + n - 1 <= len(w)),
m AS (SELECT query_id, beg, fin, kind, entity_id FROM r JOIN p USING (phrase)),
h AS (SELECT DISTINCT query_id, kind, entity_id FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.query_id = m.query_id AND o.beg <= m.beg AND o.fin >= m.fin AND o.fin - o.beg > m.fin - m.beg)),
a AS (SELECT *, {gates} AS open FROM w LEFT JOIN (SELECT query_id, list(DISTINCT kind) AS k FROM h GROUP BY 1) USING (query_id)), b AS (SELECT query_id, plain, open, coalesce(k, []) AS named FROM a),
sc AS (SELECT *, CASE WHEN coalesce(confidence, 0.5) >= 0.8 THEN 10.0 ELSE 7.0 END AS base FROM e), sh AS (SELECT kind, entity_id FROM sc QUALIFY row_number() OVER (PARTITION BY kind ORDER BY base DESC, name, entity_id) <= {limits}),
df AS (SELECT query_id, entity_id, kind FROM (SELECT query_id, unnest(list_filter(open, lambda o: NOT list_contains({silent}, o))) AS kind FROM b) JOIN sh USING (kind)),
x AS (SELECT u.query_id, plain, named, sc.* FROM (SELECT query_id, entity_id, kind FROM h UNION SELECT * FROM df) u JOIN b USING (query_id) JOIN sc USING (kind, entity_id) WHERE list_contains(open, kind)),
y AS (SELECT *, CASE WHEN {demoted} THEN least(base, 2.0) ELSE base END::DOUBLE AS score, {first} AS first FROM x WHERE {guards})
SELECT query_id, entity_id, kind, name, card, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, name, entity_id) AS rank FROM y) WHERE rank <= {rules.most}"""


@query(_sql(RULES))
def entity_search(spark, sf_dir):
    """Six lookups in one plan."""
    return E.entity_search(_questions(spark, sf_dir), _entities(spark, sf_dir), RULES)


# customers are the questions, by their segment; urgent orders, items, orders and what is left the layers
_LAYERS = """q AS (SELECT c_custkey AS query_id, c_mktsegment AS intent FROM customer), h(intent, label, allowed) AS (VALUES ('BUILDING', 'F', true), ('BUILDING', 'O', false), ('MACHINERY', 'P', true), ('FURNITURE', 'R', false)),
f AS (SELECT o_custkey AS query_id, 'o' || o_orderkey AS id, o_totalprice / 30000 AS score, o_orderstatus AS label, 0.9 AS authority, true AS fits, 0 AS layer FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000),
e AS (SELECT o_custkey AS query_id, 'a' || o_orderkey AS id, CASE WHEN l_linestatus = 'F' THEN l_quantity / 5 ELSE least(l_quantity / 5, 2.0) END AS score, l_returnflag AS label, CASE WHEN l_discount > 0.05 THEN 0.5 ELSE 0.2 END AS authority, l_linestatus = 'F' AS fits, 1 AS layer
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN q ON q.query_id = o_custkey WHERE l_tax > 0.05 AND intent IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, id) <= 2),
v AS (SELECT o_custkey AS query_id, 'o' || o_orderkey AS id, o_totalprice / 50000 AS score, o_orderstatus AS label, CASE WHEN o_orderpriority < '3' THEN 0.9 ELSE 0.2 END AS authority, true AS fits, 2 AS layer FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 50000),
w AS (SELECT o_custkey AS query_id, 'w' || o_orderkey AS id, 4.0 AS score, o_orderstatus AS label, 0.3 AS authority, true AS fits, 3 AS layer FROM orders WHERE o_orderpriority = '5-LOW'),
x AS (SELECT u.*, layer < 2 AND fits AS pinned, round(CASE WHEN layer < 2 AND fits THEN score ELSE score + CASE WHEN allowed THEN 3 WHEN NOT allowed THEN -6 ELSE 0 END END, 6)::DOUBLE AS final FROM (FROM f UNION ALL FROM e UNION ALL FROM v UNION ALL FROM w) u JOIN q USING (query_id) LEFT JOIN h USING (intent, label)),
m1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, final DESC, layer, id) AS rank FROM (SELECT * FROM x WHERE layer < 3 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY layer) = 1) QUALIFY rank <= 6)"""
_SUFFICIENT = "SELECT r.query_id, CASE WHEN layer < 2 AND fits THEN CASE WHEN final >= 12 THEN 0.95 ELSE 0.85 END WHEN authority >= 0.5 AND n >= 2 THEN 0.7 WHEN authority >= 0.5 THEN 0.55 WHEN n >= 1 THEN 0.4 ELSE 0.2 END::DOUBLE AS confidence FROM {0} r JOIN (SELECT query_id, count(*) FILTER (authority >= 0.5) AS n FROM {0} GROUP BY 1) USING (query_id) WHERE rank = 1"


@query(f"""WITH {_LAYERS}, s1 AS ({_SUFFICIENT.format('m1')}), y AS (SELECT * FROM x WHERE layer < 3 OR query_id NOT IN (SELECT query_id FROM s1 WHERE confidence >= 0.7)),
m2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, final DESC, layer, id) AS rank FROM (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY layer) = 1) QUALIFY rank <= 6), s2 AS ({_SUFFICIENT.format('m2')})
SELECT query_id, id, ['faq', 'entity', 'indexed', 'web'][layer + 1] AS source_type, final AS score, pinned, confidence, confidence >= 0.7 AS sufficient, CAST(rank AS INTEGER) AS rank FROM m2 JOIN s2 USING (query_id)""")
def orchestrated_layers(spark, sf_dir):
    """All layers of evidence, their gates, hosts and pins, and the last resort of questions with too little, in one plan."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    row = lambda f, letter, score, label, authority, fits=F.lit(None).cast("boolean"): f.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit(letter), F.col("o_orderkey").cast("string")).alias("id"), score.alias("score"), F.col(label).alias("label"), authority.alias("authority"), fits.alias("fits"))
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    urgent = row(orders.where((priority == "1-URGENT") & (price > 300_000)), "o", price / 30_000, "o_orderstatus", F.lit(0.9))
    of_items = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey")).where("l_tax > 0.05")
    entities = row(of_items, "a", F.col("l_quantity") / 5, "l_returnflag", F.when(F.col("l_discount") > 0.05, 0.5).otherwise(0.2), F.col("l_linestatus") == "F")
    indexed = row(orders.where((priority != "5-LOW") & (price > 50_000)), "o", price / 50_000, "o_orderstatus", F.when(priority < "3", 0.9).otherwise(0.2))
    web = row(orders.where(priority == "5-LOW"), "w", F.lit(4.0), "o_orderstatus", F.lit(0.3))
    hosts = spark.sql("SELECT * FROM VALUES ('BUILDING', 'F', true), ('BUILDING', 'O', false), ('MACHINERY', 'P', true), ('FURNITURE', 'R', false) AS t(intent, label, allowed)")
    layers = [L.Layer("faq", urgent, pinned=True, structured=True), L.Layer("entity", entities, pinned=True, structured=True, intents=("BUILDING", "MACHINERY", "AUTOMOBILE"), most=2), L.Layer("indexed", indexed)]
    questions = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("intent"))
    return L.orchestrated(questions, layers, hosts, 6, L.Layer("web", web))
