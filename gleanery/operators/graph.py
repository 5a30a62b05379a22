"""Graphs as tables: co-occurrence graphs of entities, typed property graphs, and walks over links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import tokens
from gleanery.operators.steps import settled


def cooccurrence(mentions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(a, b, weight): in how many documents of mentions (entity, doc_id) two entities, a < b, occur together.

    Pairs are made inside a document's own set of entities, so a frequent entity does not gather its documents.
    """
    if entities is not None:
        mentions = mentions.join(entities, "entity", "left_semi")
    sets = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_set("entity")).alias("e")).where(F.size("e") > 1)
    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))


def pruned(mentions: DataFrame, edges: DataFrame, least: int, protected: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mentions of entities in ``least`` documents or more, or protected, and the edges between these."""
    kept = mentions.groupBy("entity").agg(F.countDistinct("doc_id").alias("n")).where((F.col("n") >= least) | F.col("entity").isin(protected)).select("entity")
    left = edges.join(kept.withColumnRenamed("entity", "a"), "a", "left_semi").join(kept.withColumnRenamed("entity", "b"), "b", "left_semi")
    return mentions.join(kept, "entity", "left_semi"), left


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b, weight) from both ends, as (node, other, weight)."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest neighbours of each node; ties by name."""
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    return adjacency(edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def related_documents(wanted: DataFrame, mentions: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): documents that mention a query's entities (2 each) or their k heaviest neighbours (1
    each). An entity that is both counts 2."""
    near = wanted.join(top_neighbours(edges, k), F.col("entity") == F.col("node")).select("query_id", F.col("other").alias("entity"), F.lit(1).alias("w"))
    weights = wanted.select("query_id", "entity", F.lit(2).alias("w")).unionByName(near).groupBy("query_id", "entity").agg(F.max("w").alias("w"))
    return weights.join(mentions.distinct(), "entity").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def upsert_nodes(parts: list[DataFrame]) -> DataFrame:
    """One node for each id of parts (id, type, name, attrs, aliases): the first part's type and name, all attributes
    that are not null (a later part wins), all aliases."""
    every = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    attrs = every.select("id", "part", F.explode("attrs")).where("value IS NOT NULL").groupBy("id", "key").agg(F.max_by("value", "part").alias("value"))
    attrs = attrs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    names = every.groupBy("id").agg(F.min_by("type", "part").alias("type"), F.min_by("name", "part").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    return names.join(attrs, "id", "left")


def existing_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (src, rel, dst) both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def graph_audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of nodes, edges, orphans, edges with an end that is no node, repeated names, the top degree."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    by_node = nodes.join(degree, "id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree").isNull()).alias("orphans"), F.coalesce(F.max("degree"), F.lit(0)).alias("top_degree"))
    twice = nodes.groupBy("type", "name").count().where("count > 1").agg(F.count("*").alias("repeated_names"))
    ids = nodes.select("id", F.lit(True).alias("known"))
    ended = edges.join(ids.toDF("src", "s"), "src", "left").join(ids.toDF("dst", "d"), "dst", "left").agg(F.count("*").alias("edges"), F.count_if(F.col("s").isNull() | F.col("d").isNull()).alias("dangling"))
    return by_node.crossJoin(twice).crossJoin(ended)  # three single rows


def frontier(seeds: DataFrame, links: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(url, depth): pages that links (src, dst) reach from seeds (url), each at its least depth, up to ``depth``; with
    ``most``, a crawl's budget, the first so many by depth and url. Every level is written before the next is sought,
    so that a level is one join, however many came before it."""
    new = seen = settled(seeds.select("url", F.lit(0).alias("depth")).distinct())
    for step in range(1, depth + 1):
        reached = new.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        new = settled(reached.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(new)
        if new.isEmpty():
            break
    return seen if most is None else seen.orderBy("depth", "url").limit(most)


def neighbours(edges: DataFrame, nodes: DataFrame, relation: str | None = None, outward: bool = True) -> DataFrame:
    """(node, rel, other) of nodes (id): what their edges (src, rel, dst) lead to, or come from, by one relation or
    any."""
    kept = edges if relation is None else edges.where(F.col("rel") == relation)
    near, far = ("src", "dst") if outward else ("dst", "src")
    return kept.join(nodes.select(F.col("id").alias(near)).distinct(), near, "left_semi").select(F.col(near).alias("node"), "rel", F.col(far).alias("other"))


def name_index(nodes: DataFrame) -> DataFrame:
    """(name, id): the lower-cased names and aliases of nodes (id, name, aliases)."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return nodes.select(F.explode(every).alias("name"), "id").select(F.lower(F.trim("name")).alias("name"), "id").where("name <> ''").distinct()


def longest_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, id, name): the node whose name is the longest of those that stand in a text (text_id, text), the first
    by name and id among equals. A name is met by its first word, so that no text meets all names."""
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    words = names.select("name", "id", tokens(F.col("name")).alias("w")).where(F.size("w") > 0)
    lines = texts.select("text_id", tokens(F.col("text")).alias("t"))
    met = lines.select("text_id", F.explode(F.array_distinct("t")).alias("first")).join(words.withColumn("first", F.col("w")[0]), "first")
    held = met.join(lines.select("text_id", spaced(F.col("t")).alias("line")), "text_id").where(F.contains("line", spaced(F.col("w"))))
    best = F.min_by(F.struct("id", "name"), F.struct(-F.char_length("name"), "name", "id"))
    return held.groupBy("text_id").agg(best.alias("b")).select("text_id", "b.*")


def expansion_contexts(related: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the k best related documents (query_id, doc_id, score) in scope (facts: doc_id,
    in_scope), scored anew by their place: .5, falling by .03 to .2."""
    kept = related.join(facts.where("in_scope"), "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")) - 1
    return kept.withColumn("_p", place).where(F.col("_p") < k).select("query_id", "doc_id", F.round(F.greatest(F.lit(0.2), 0.5 - 0.03 * F.col("_p")), 6).alias("score"))
