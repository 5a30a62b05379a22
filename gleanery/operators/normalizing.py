"""Questions in plain words: slang, misspelt words, acronyms and phrases, for a batch of questions.

Misspellings are found by a join, not by holding every word against the vocabulary. Two strings whose ratio of matching
blocks reaches a bound have as large a share of their characters, repeats counted, in common. So each is a set of
(character, which one), such sets meet by a prefix in an order that has rare characters first, and the ratio is taken
of what has met. No pair that reaches the bound is left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.fuzzy import block_ratio
from gleanery.operators.retrieval import ranked


@dataclass(frozen=True)
class Vocabulary:
    """Words that a corpus brings along. slang: what a word stands for. keep: words that stay as they are, as those of
    ``words`` do, to which others are corrected. phrases: names of which the best is added where none is there."""

    slang: Mapping[str, str] = field(default_factory=dict)
    keep: Sequence[str] = ()
    fillers: Sequence[str] = ()
    words: Sequence[str] = ()
    acronyms: Sequence[str] = ()
    phrases: Sequence[str] = ()
    least_word: float = 0.72
    least_acronym: float = 0.74
    least_phrase: float = 0.74


def _characters(of: Column) -> Column:
    """The characters of a string, each with which one of its kind it is."""
    each = F.split(of, "")
    return F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, 1, i), lambda x: x == c)).cast("string")))


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): distinct strings of left (a) and right (b), twice whose common characters, repeats counted, are at least
    ``least`` of all of theirs. Empty and null strings are like none."""
    sides = [f.select(F.col(c).alias("s")).where(F.length(c) > 0).distinct().select("s", _characters(F.col("s")).alias("c")) for f, c in ((left, "a"), (right, "b"))]
    often = sides[1].select(F.explode("c").alias("x")).groupBy("x").agg(F.count("*").alias("n"))

    def prefixes(frame: DataFrame, name: str) -> DataFrame:
        placed = frame.select("s", F.size("c").alias("size"), F.explode("c").alias("x")).join(often, "x", "left")
        order = Window.partitionBy("s").orderBy(F.coalesce("n", F.lit(0)), "x")
        # of n characters, so many are shared with any partner that one is among the first that are left
        first = F.col("size") - F.ceil(F.col("size") * (least / (2 - least)) - 1e-9) + 1
        return placed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= first).select("x", F.col("s").alias(name), F.col("size").alias(f"size_{name}"))

    a, b = prefixes(sides[0], "a"), prefixes(sides[1], "b")
    near = 2 * F.least("size_a", "size_b") >= least * (F.col("size_a") + F.col("size_b")) - 1e-9
    met = a.join(b, "x").where(near).select("a", "b").distinct()
    met = met.join(sides[0].toDF("a", "ca"), "a").join(sides[1].toDF("b", "cb"), "b")
    share = 2 * F.size(F.array_intersect("ca", "cb")) >= least * (F.size("ca") + F.size("cb")) - 1e-9
    return met.where(share).select("a", "b")


def corrections(words: DataFrame, vocabulary: DataFrame, least: float = 0.72) -> DataFrame:
    """(word, correction): for words (word) that have one, the word of the vocabulary (term) with the highest ratio to
    it, the greatest among equals, if that reaches ``least`` either way round, and the lengths differ by two, or by
    four tenths of the term's, at most."""
    met = alike(words.select(F.col("word").alias("a")), vocabulary.select(F.col("term").alias("b")), least)
    scored = met.withColumn("ratio", block_ratio(F.col("b"), F.col("a"))).where(F.col("ratio") >= least)
    best = ranked(scored, ["a"], F.desc("ratio"), F.desc("b")).where("rank = 1")
    apart = F.abs(F.length("b") - F.length("a")) <= F.greatest(F.lit(2), F.floor(0.4 * F.length("b")))
    return best.where(apart & (block_ratio(F.col("a"), F.col("b")) >= least)).select(F.col("a").alias("word"), F.col("b").alias("correction"))


def acronym_corrections(words: DataFrame, acronyms: DataFrame, least: float = 0.74) -> DataFrame:
    """(word, correction): the acronym (term) with the highest ratio to a word of 2 to 10 characters, the greatest among
    equals, among those whose length differs by two at most."""
    short = words.where(F.length("word").between(2, 10))
    met = alike(short.select(F.col("word").alias("a")), acronyms.select(F.col("term").alias("b")), least).where(F.abs(F.length("a") - F.length("b")) <= 2)
    scored = met.withColumn("ratio", block_ratio(F.col("b"), F.col("a"))).where(F.col("ratio") >= least)
    return ranked(scored, ["a"], F.desc("ratio"), F.desc("b")).where("rank = 1").select(F.col("a").alias("word"), F.col("b").alias("correction"))


def recovered_phrases(questions: DataFrame, phrases: DataFrame, least: float = 0.74) -> DataFrame:
    """(query_id, phrase): for questions (query_id, words) in which no phrase (phrase) stands, the one with the highest
    ratio to as many words in a row as it has, if that reaches ``least``; longer phrases first among equals, then by name."""
    named = phrases.withColumn("size", F.size(F.split("phrase", " ")))
    whole = F.array_join("words", " ")
    sizes = [r["size"] for r in named.select("size").distinct().collect()]  # the lengths of phrases, in words
    if not sizes:
        return questions.select("query_id").limit(0).withColumn("phrase", F.lit(""))
    parts = F.flatten(F.array(*[F.when(F.size("words") >= n, _windows(n)).otherwise(F.array().cast("array<string>")) for n in sizes]))
    windows = questions.where(F.size("words") > 0).select("query_id", whole.alias("whole"), F.explode(parts).alias("window"))
    clean = questions.select("query_id", whole.alias("whole")).join(named, F.contains("whole", "phrase")).select("query_id").distinct()
    open_ = windows.join(clean, "query_id", "left_anti").withColumn("size", F.size(F.split("window", " ")))
    met = alike(open_.select(F.col("window").alias("a")), named.select(F.col("phrase").alias("b")), least).join(named, F.col("b") == F.col("phrase")).where(F.size(F.split("a", " ")) == F.col("size"))
    scored = met.withColumn("ratio", block_ratio(F.col("b"), F.col("a"))).where(F.col("ratio") >= least).select("a", "phrase", "ratio")
    every = open_.select("query_id", F.col("window").alias("a")).join(scored, "a")
    return ranked(every, ["query_id"], F.desc("ratio"), F.desc(F.length("phrase")), F.col("phrase")).where("rank = 1").select("query_id", "phrase")


def _windows(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))


def normalized_queries(questions: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(query_id, normalized): questions (query_id, text) with slang in full, fillers and punctuation gone, words
    corrected, then acronyms, and a phrase added where none is there. A question of which nothing is left, and a blank
    or null one, stays as it is. A question's words are gathered, and no more than these."""
    spark = questions.sparkSession
    table = lambda column, of: spark.createDataFrame([(x,) for x in sorted(set(of))], f"{column} string")
    raw = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    tokens = F.filter(F.regexp_extract_all(F.lower(raw), F.lit(r"[A-Za-z0-9]+|\S"), F.lit(0)), lambda t: t.rlike(r"^[\p{L}\p{N}]+$") & ~t.isin(*vocabulary.fillers))
    placed = questions.select("query_id", F.posexplode(tokens).alias("at", "word"))
    slang = spark.createDataFrame([*vocabulary.slang.items()], "word string, full string")
    known = table("word", [*vocabulary.keep, *vocabulary.words])
    open_ = placed.select("word").distinct().where(~F.col("word").rlike(r"^\p{N}+$")).join(slang, "word", "left_anti").join(known, "word", "left_anti")
    corrected = corrections(open_.where(F.length("word") >= 4), table("term", vocabulary.words), vocabulary.least_word)
    short = acronym_corrections(open_.join(corrected, "word", "left_anti"), table("term", vocabulary.acronyms), vocabulary.least_acronym)
    told = slang.select("word", F.col("full").alias("as")).unionByName(corrected.unionByName(short).withColumnRenamed("correction", "as"))
    named = placed.join(told, "word", "left").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("as", "word").alias("w")))), lambda x: x["w"]), " ").alias("plain"))
    split = named.select("query_id", "plain", F.split("plain", " ").alias("words"))
    phrase = recovered_phrases(split, table("phrase", vocabulary.phrases), vocabulary.least_phrase)
    whole = questions.select("query_id", "text", raw.alias("raw")).join(split, "query_id", "left").join(phrase, "query_id", "left")
    return whole.select("query_id", F.coalesce(F.concat_ws(" ", F.nullif("plain", F.lit("")), F.when(F.col("plain") != "", F.col("phrase"))), F.lit("")).alias("n"), "raw", "text").select(
        "query_id", F.when(F.col("n") != "", F.col("n")).when(F.col("raw") != "", F.col("raw")).otherwise(F.col("text")).alias("normalized")
    )
