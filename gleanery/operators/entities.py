"""Entities that questions ask for: aliases by longest match over all kinds at once, lookups gated by words, cards.

All kinds of entities are one tagged union, and so are all names and aliases. Runs of a question's words meet these in
one join; a match inside a longer one, of whatever kind, is none. What is found, or what a kind shows where nothing is
named, is filtered, scored and ranked by rules that a corpus brings along.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import tokens
from gleanery.operators.retrieval import ranked
from gleanery.operators.steps import written


@dataclass(frozen=True)
class Lookup:
    """How entities of a kind are found by a question that has one of the words or phrases of ``gate``: by ``aliases``
    of their names (``contains``: of a part of them), by their whole ``names`` of four letters and more, or the
    ``default`` best ones where none is named and no entity of the kinds in ``quiet`` is."""

    kind: str
    gate: Sequence[str]
    aliases: Mapping[str, str] = field(default_factory=dict)
    contains: bool = False
    names: bool = True
    default: int = 0
    quiet: Sequence[str] = ()


@dataclass(frozen=True)
class EntityRules:
    """guards: (kind, other, words): of a question in which an entity of ``other`` is found, ``kind`` is left out unless
    it has one of the words. demotions: (words, kinds): with one of the words, other kinds score 2 at most; the first
    that applies counts. orders: (words, kinds): the order of kinds among equal scores, by the first that applies."""

    lookups: Sequence[Lookup]
    guards: Sequence[tuple[str, str, Sequence[str]]] = ()
    demotions: Sequence[tuple[Sequence[str], Sequence[str]]] = ()
    orders: Sequence[tuple[Sequence[str], Sequence[str]]] = ()
    order: Sequence[str] = ()
    most: int = 6
    sure: float = 0.8
    high: float = 10.0
    low: float = 7.0
    demoted: float = 2.0


def plain(text: Column) -> Column:
    """A text's words of two characters and more, hyphens in them, as names and questions are compared."""
    return F.array_join(tokens(text, "hyphenated", 1), " ")


def card(fields: Mapping[str, Column]) -> Column:
    """What an entity's card says: its fields that have a value, in order."""
    told = F.concat_ws(". ", *[F.concat(F.lit(f"{name}: "), F.nullif(F.trim(value), F.lit(""))) for name, value in fields.items()])
    return F.concat(told, F.lit("."))


def alias_table(rows: DataFrame) -> DataFrame:
    """(alias, id, phrase): the aliases of rows (id, aliases) in lower case, and whether they are several words; an alias
    that is null or blank is none."""
    each = rows.select("id", F.explode("aliases").alias("alias")).where(F.trim("alias") != "")
    return each.select(F.lower(F.trim("alias")).alias("alias"), "id", F.trim("alias").rlike(r"\s").alias("phrase")).distinct()


def _has(words: Sequence[str]) -> Column:
    """Whether the question (``plain``) has one of the words or phrases."""
    spaced = F.concat(F.lit(" "), F.col("plain"), F.lit(" "))
    return F.exists(F.array(*[F.lit(f" {w} ") for w in words]), lambda w: F.contains(spaced, w)) if words else F.lit(False)


def named_entities(questions: DataFrame, entities: DataFrame, rules: EntityRules) -> DataFrame:
    """(query_id, kind, entity_id): entities (kind, entity_id, name) that the words of questions (query_id, plain) name."""
    spark = questions.sparkSession
    alias = spark.createDataFrame([(x.kind, a, t, x.contains) for x in rules.lookups for a, t in x.aliases.items()], "kind string, alias string, target string, part boolean")
    meets = (F.col("e.kind") == F.col("a.kind")) & F.when(F.col("part"), F.contains(F.lower("name"), F.lower("target"))).otherwise(F.lower("name") == F.lower("target"))
    # aliases are rules, and few: they are broadcast
    by_alias = entities.alias("e").join(F.broadcast(alias).alias("a"), meets).select("e.kind", "entity_id", F.col("alias").alias("phrase"))
    whole = entities.where(F.col("kind").isin([x.kind for x in rules.lookups if x.names])).select("kind", "entity_id", plain(F.col("name")).alias("phrase"))
    every = by_alias.unionByName(whole.where(F.length("phrase") >= 4)).distinct()
    longest = every.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    words = F.split("plain", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.struct(i.alias("at"), (i + n).alias("end"), F.array_join(F.slice(words, i, n), " ").alias("phrase")))))
    met = questions.where(F.length("plain") > 0).select("query_id", F.explode(runs).alias("r")).select("query_id", "r.*").join(every, "phrase")
    # a question's runs are few, whatever the number of entities that they name
    spans = met.groupBy("query_id").agg(F.collect_set(F.struct("at", "end")).alias("spans"))
    inside = F.exists("spans", lambda o: (o["at"] <= F.col("at")) & (o["end"] >= F.col("end")) & (o["end"] - o["at"] > F.col("end") - F.col("at")))
    return met.join(spans, "query_id").where(~inside).select("query_id", "kind", "entity_id").distinct()


def entity_search(questions: DataFrame, entities: DataFrame, rules: EntityRules) -> DataFrame:
    """(query_id, entity_id, kind, name, card, score, rank): the best entities (entity_id, kind, name, card, confidence)
    for each question (query_id, text); ties by the order of kinds, then by name and id. An entity is told once."""
    asked = questions.select("query_id", plain(F.col("text")).alias("plain"))
    opened = F.filter(F.array(*[F.when(_has(x.gate), F.lit(x.kind)) for x in rules.lookups]), F.isnotnull)
    asked = written(asked.withColumn("open", opened), "questions")
    named = named_entities(asked, entities, rules)
    named = written(named, "named")
    kinds = named.groupBy("query_id").agg(F.collect_set("kind").alias("named"))
    asked = asked.join(kinds, "query_id", "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    score = F.when(F.coalesce("confidence", F.lit(0.5)) >= rules.sure, rules.high).otherwise(rules.low)
    scored = entities.withColumn("score", score)
    shown = ranked(scored, ["kind"], F.desc("score"), F.col("name"), F.col("entity_id"), name="place")
    limits = F.coalesce(*[F.when(F.col("kind") == x.kind, F.lit(min(x.default, rules.most))) for x in rules.lookups], F.lit(0))
    best = F.broadcast(shown.where(F.col("place") <= limits).select("kind", "entity_id"))  # at most ``most`` of a kind
    silent = F.filter(F.array(*[F.when(F.array_contains("named", x.kind) | (F.arrays_overlap("named", F.array(*[F.lit(q) for q in x.quiet])) if x.quiet else F.lit(False)), F.lit(x.kind)) for x in rules.lookups]), F.isnotnull)
    default = asked.select("query_id", F.explode(F.array_except("open", silent)).alias("kind")).join(best, "kind")
    rows = named.select("query_id", "entity_id", "kind").unionByName(default.select("query_id", "entity_id", "kind")).distinct().join(asked, "query_id").where(F.array_contains("open", F.col("kind")))
    for kind, other, words in rules.guards:
        rows = rows.where((F.col("kind") != kind) | ~F.array_contains("named", other) | _has(words))
    met = rows.join(scored, ["kind", "entity_id"])
    out = F.coalesce(*[F.when(_has(words), ~F.col("kind").isin(list(fit))) for words, fit in rules.demotions], F.lit(False))
    place = lambda order: F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind")) if order else F.lit(0)
    first = F.coalesce(*[F.when(_has(words), place(order)) for words, order in rules.orders], place(rules.order))
    met = met.withColumn("score", F.when(out, F.least(F.col("score"), F.lit(rules.demoted))).otherwise(F.col("score")))
    met = met.withColumn("first", F.when(first == 0, 1_000).otherwise(first))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "name", "entity_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= rules.most).select("query_id", "entity_id", "kind", "name", "card", "score", "rank")
