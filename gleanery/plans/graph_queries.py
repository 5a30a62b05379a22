"""Queries of graph operators. Entities of a document are its capitalised words of the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import graph as G
from gleanery.plans.common import Family, read

FAMILY = Family()
query = FAMILY.query

# brands are the entities, orders the documents
_M = "WITH m AS (SELECT DISTINCT p_brand AS entity, l_orderkey AS doc_id FROM lineitem JOIN part ON p_partkey = l_partkey), e AS (SELECT a.entity AS a, b.entity AS b, count(*) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2)"


def _mentions(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("entity"), F.col("l_orderkey").alias("doc_id")).distinct()


@query(f"{_M} SELECT * FROM e")
def graph_cooccurrence(spark, sf_dir):
    return G.cooccurrence(_mentions(spark, sf_dir))


@query(f"""{_M}, k AS (SELECT entity FROM m GROUP BY 1 HAVING count(DISTINCT doc_id) >= (SELECT count(*) FROM orders) / 7 OR entity = 'Brand#11')
SELECT * FROM e WHERE a IN (SELECT entity FROM k) AND b IN (SELECT entity FROM k)""")
def graph_prune(spark, sf_dir):
    mentions = _mentions(spark, sf_dir)
    least = -(-read(spark, sf_dir, "orders").count() // 7)
    return G.pruned(mentions, G.cooccurrence(mentions), least, ["Brand#11"])[1]


_ADJACENT = "d AS (SELECT a AS node, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e), t AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS rank FROM d)"


@query(f"{_M}, {_ADJACENT} SELECT node, other, weight, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3")
def graph_neighbours(spark, sf_dir):
    return G.top_neighbours(G.cooccurrence(_mentions(spark, sf_dir)), 3)


@query(f"""{_M}, {_ADJACENT}, q AS (SELECT DISTINCT n_nationkey AS query_id, p_brand AS entity FROM nation JOIN part ON p_partkey = n_nationkey + 1),
w AS (SELECT query_id, entity, max(w) AS w FROM (SELECT query_id, entity, 2 AS w FROM q UNION ALL SELECT query_id, other, 1 FROM q JOIN t ON node = entity AND rank <= 2) GROUP BY 1, 2)
SELECT query_id, doc_id, CAST(sum(w) AS BIGINT) AS score FROM w JOIN m USING (entity) GROUP BY 1, 2""")
def graph_expand(spark, sf_dir):
    mentions = _mentions(spark, sf_dir)
    wanted = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("n_nationkey") + 1).select(F.col("n_nationkey").alias("query_id"), F.col("p_brand").alias("entity")).distinct()
    return G.related_documents(wanted, mentions, G.cooccurrence(mentions), 2)


def typed_graph(spark, sf_dir):
    """(nodes, edges) of regions, nations, suppliers and customers."""
    region, nation, supplier, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    attr = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])
    none = F.array().cast("array<string>")
    node = lambda f, kind, key, name, attrs, aliases=none: f.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), attrs.alias("attrs"), aliases.alias("aliases"))
    parts = [
        node(region, "region", "r_regionkey", "r_name", attr(size=F.lit(None))),
        node(nation, "nation", "n_nationkey", "n_name", attr(region=F.col("n_regionkey")), F.array(F.lower("n_name"))),
        node(supplier, "supplier", "s_suppkey", "s_name", attr(balance=F.floor("s_acctbal"))),
        node(nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.min("n_name").alias("n_name"), F.count("*").alias("n")), "nation", "n_nationkey", "n_name", attr(suppliers=F.col("n")), F.array(F.upper("n_name"))),
    ]
    edge = lambda f, a, src, rel, b, dst: f.select(F.concat(F.lit(f"{a}:"), F.col(src).cast("string")).alias("src"), F.lit(rel).alias("rel"), F.concat(F.lit(f"{b}:"), F.col(dst).cast("string")).alias("dst"))
    edges = edge(nation, "nation", "n_nationkey", "part_of", "region", "n_regionkey").unionByName(edge(supplier, "supplier", "s_suppkey", "located_in", "nation", "s_nationkey"))
    edges = edges.unionByName(edge(customer, "customer", "c_custkey", "located_in", "nation", "c_nationkey"))
    return G.upsert_nodes(parts), edges


_N = """WITH k AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1),
n AS (SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS name, 0 AS aliases, NULL AS attrs FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, len(list_distinct([lower(n_name)] || CASE WHEN n IS NULL THEN [] ELSE [upper(n_name)] END)), '{region=' || n_regionkey || CASE WHEN n IS NULL THEN '' ELSE ', suppliers=' || n END || '}' FROM nation LEFT JOIN k ON s_nationkey = n_nationkey
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 0, '{balance=' || CAST(floor(s_acctbal) AS BIGINT) || '}' FROM supplier),
e AS (SELECT 'nation:' || n_nationkey AS src, 'part_of' AS rel, 'region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey FROM customer)"""


@query(f"{_N} SELECT id, type, name, aliases::INTEGER AS n_aliases, attrs FROM n")
def graph_typed_nodes(spark, sf_dir):
    nodes, _ = typed_graph(spark, sf_dir)
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit("}"))
    return nodes.select("id", "type", "name", F.size("aliases").alias("n_aliases"), shown.alias("attrs"))


@query(f"{_N} SELECT src, rel, dst FROM e SEMI JOIN n ON n.id = src WHERE dst IN (SELECT id FROM n)")
def graph_typed_edges(spark, sf_dir):
    nodes, edges = typed_graph(spark, sf_dir)
    return G.existing_edges(edges, nodes)


@query(f"""{_N}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n LEFT JOIN d USING (id) WHERE degree IS NULL) AS orphans, (SELECT max(degree) FROM n JOIN d USING (id)) AS top_degree,
(SELECT count(*) FROM (SELECT 1 FROM n GROUP BY type, name HAVING count(*) > 1)) AS repeated_names, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n)) AS dangling""")
def graph_audit(spark, sf_dir):
    return G.graph_audit(*typed_graph(spark, sf_dir))


@query("SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, array_to_string(list_sort(list(DISTINCT n_name)), ', ') AS summary, count(s_suppkey) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def graph_typed_summary(spark, sf_dir):
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    met = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return met.groupBy(F.col("r_name").alias("region")).agg(F.countDistinct("n_nationkey").alias("nations"), F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("summary"), F.count("s_suppkey").alias("suppliers"))


# every order is a link between customers; the pages of one nation are the seeds
_WALK = """WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS dst FROM orders), s AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7),
f(url, depth) AS (SELECT c_custkey, 0 FROM s UNION SELECT l.dst, depth + 1 FROM f JOIN l ON l.src = f.url WHERE depth < 3), w AS (SELECT url, min(depth)::INTEGER AS depth FROM f GROUP BY 1)"""


def _walk(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    links = orders.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % customer.count()).alias("dst")).distinct()
    return customer.where("c_nationkey = 7").select(F.col("c_custkey").alias("url")), links


@query(f"{_WALK} SELECT url, depth FROM w")
def crawl_frontier(spark, sf_dir):
    return G.frontier(*_walk(spark, sf_dir), 3)


@query(f"{_WALK} SELECT url, depth FROM w ORDER BY depth, url LIMIT 60")
def crawl_frontier_budget(spark, sf_dir):
    """The crawl's budget is the feature: sixty pages, nearest first."""
    return G.frontier(*_walk(spark, sf_dir), 3, 60)


@query(f"{_N}, held AS (SELECT src, rel, dst FROM e SEMI JOIN n ON n.id = src WHERE dst IN (SELECT id FROM n)) SELECT src AS node, rel, dst AS other FROM held WHERE rel = 'located_in' AND src LIKE 'supplier:%' UNION ALL SELECT dst, rel, src FROM held WHERE dst LIKE 'region:%'")
def graph_relation_neighbours(spark, sf_dir):
    nodes, edges = typed_graph(spark, sf_dir)
    kept = G.existing_edges(edges, nodes)
    return G.neighbours(kept, nodes.where("type = 'supplier'"), "located_in").unionByName(G.neighbours(kept, nodes.where("type = 'region'"), outward=False))


@query(f"{_N} SELECT DISTINCT name, id FROM (SELECT lower(trim(name)) AS name, id FROM n UNION SELECT lower(n_name), 'nation:' || n_nationkey FROM nation) WHERE name <> ''")
def graph_name_index(spark, sf_dir):
    return G.name_index(typed_graph(spark, sf_dir)[0])


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')"


@query(f"""WITH t AS (SELECT c_custkey AS text_id, ' ' || array_to_string({_WORDS.format("c_name || ' of ' || n_name || ' in ' || r_name")}, ' ') || ' ' AS line FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
n AS (SELECT lower(n_name) AS name, 'nation:' || n_nationkey AS id FROM nation UNION SELECT lower(r_name), 'region:' || r_regionkey FROM region),
m AS (SELECT text_id, id, name, row_number() OVER (PARTITION BY text_id ORDER BY length(name) DESC, name, id) AS i FROM t JOIN n ON contains(line, ' ' || array_to_string({_WORDS.format('name')}, ' ') || ' '))
SELECT text_id, id, name FROM m WHERE i = 1""")
def graph_longest_names(spark, sf_dir):
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    texts = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    nodes = typed_graph(spark, sf_dir)[0].where("type IN ('nation', 'region')")
    return G.longest_names(texts.select(F.col("c_custkey").alias("text_id"), F.concat("c_name", F.lit(" of "), "n_name", F.lit(" in "), "r_name").alias("text")), G.name_index(nodes))


@query(f"""{_M}, {_ADJACENT}, q AS (SELECT DISTINCT n_nationkey AS query_id, p_brand AS entity FROM nation JOIN part ON p_partkey = n_nationkey + 1),
w AS (SELECT query_id, entity, max(w) AS w FROM (SELECT query_id, entity, 2 AS w FROM q UNION ALL SELECT query_id, other, 1 FROM q JOIN t ON node = entity AND rank <= 2) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, sum(w) AS score FROM w JOIN m USING (entity) WHERE doc_id % 3 > 0 GROUP BY 1, 2), p AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS p FROM s)
SELECT query_id, doc_id, round(greatest(0.2, 0.5 - 0.03 * p), 6)::DOUBLE AS score FROM p WHERE p < 12""")
def graph_expansion_contexts(spark, sf_dir):
    facts = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3 > 0).alias("in_scope"))
    return G.expansion_contexts(graph_expand(spark, sf_dir), facts, 12)


@query("""SELECT 'nation' AS kind, n_name AS name, 'customers: ' || count(DISTINCT c_mktsegment) || '. segments: ' || array_to_string(list_sort(list(DISTINCT c_mktsegment)), ', ') AS summary FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT 'brand', p_brand, 'parts: ' || count(*) || '. sizes: ' || array_to_string(list_transform(list_sort(list(DISTINCT p_size)), lambda x: x::VARCHAR), ', ') FROM part GROUP BY p_brand
UNION ALL SELECT 'segment', c_mktsegment, 'customers: ' || count(*) || '. nations: ' || array_to_string(list_sort(list(DISTINCT n_name)), ', ') FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment""")
def graph_summaries(spark, sf_dir):
    """What is told of three kinds of nodes, from what hangs on them."""
    nation, customer, part = (read(spark, sf_dir, t) for t in ("nation", "customer", "part"))
    met = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    told = lambda n, head, of, what: F.concat(F.lit(f"{head}: "), n.cast("string"), F.lit(f". {what}: "), F.array_join(F.transform(F.array_sort(F.collect_set(of)), lambda x: x.cast("string")), ", ")).alias("summary")
    a = met.groupBy(F.lit("nation").alias("kind"), F.col("n_name").alias("name")).agg(told(F.countDistinct("c_mktsegment"), "customers", "c_mktsegment", "segments"))
    b = part.groupBy(F.lit("brand").alias("kind"), F.col("p_brand").alias("name")).agg(told(F.count("*"), "parts", "p_size", "sizes"))
    c = met.groupBy(F.lit("segment").alias("kind"), F.col("c_mktsegment").alias("name")).agg(told(F.count("*"), "customers", "n_name", "nations"))
    return a.unionByName(b).unionByName(c)
