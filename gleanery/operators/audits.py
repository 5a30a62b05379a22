"""Evaluation and audits: benchmark aggregates, gates, claim checks, integrity of stores, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import normalized, tokens


def share(holds: Column, digits: int = 4) -> Column:
    """The share of rows for which something holds; 0 of none."""
    return F.round(F.coalesce(F.count_if(holds) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), digits)


def mean(value: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.avg(value), F.lit(0.0)), digits)


def target_ranks(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, target, noisy): the least rank at which a query's results (query_id, rank, host, url, text, kind)
    meet one of its labels (query_id, host, url, contains, kind), and whether the first result meets none. A label that
    is null asks for nothing; one of several is enough."""
    met = retrieved.join(expected.toDF(*[c if c == "query_id" else f"e_{c}" for c in expected.columns]), "query_id")
    hit = F.coalesce(F.col("host") == F.col("e_host"), F.lit(False)) | F.coalesce(F.col("url") == F.col("e_url"), F.lit(False)) | F.coalesce(F.contains(F.lower("text"), F.lower("e_contains")), F.lit(False)) | F.coalesce(F.col("kind") == F.col("e_kind"), F.lit(False))
    return met.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("target"), F.coalesce(~F.max(F.when(F.col("rank") == 1, hit)), F.lit(True)).alias("noisy"))


def retrieval_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., n, labelled, hit_rate, target_rate, hit_1, hit_3, mrr, noisy_1, not_found, median_ms, p95_ms,
    answered_right, answered_wrong, refused_right, refused_wrong) of questions (found, labelled, target, noisy,
    not_expected, ms): rates of retrieval, over the labelled ones where they ask for a target; latency by the middle and
    by the nearest rank; and of the questions of which it is known whether an answer is expected (not_expected: null is
    not known), how many got one and should have."""
    found, labelled, target = F.col("found"), F.coalesce("labelled", F.lit(False)), F.col("target")
    of = lambda holds, all_of: F.round(F.coalesce(F.count_if(holds & all_of) / F.nullif(F.count_if(all_of), F.lit(0)), F.lit(0.0)), 4)
    wanted, known = ~F.coalesce("not_expected", F.lit(False)), F.col("not_expected").isNotNull()
    mrr = F.round(F.coalesce(F.sum(F.when(labelled, F.coalesce(1.0 / target, F.lit(0.0)))) / F.nullif(F.count_if(labelled), F.lit(0)), F.lit(0.0)), 6)
    told = [
        F.count("*").alias("n"),
        F.count_if(labelled).alias("labelled"),
        of(found, wanted).alias("hit_rate"),
        of(target.isNotNull(), labelled).alias("target_rate"),
        of(target == 1, labelled).alias("hit_1"),
        of(target <= 3, labelled).alias("hit_3"),
        mrr.alias("mrr"),
        of(F.coalesce("noisy", F.lit(False)), labelled).alias("noisy_1"),
        share(~found).alias("not_found"),
        F.round(F.expr("percentile(ms, 0.5)"), 6).alias("median_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").cast("double").alias("p95_ms"),
        F.count_if(known & found & wanted).alias("answered_right"),
        F.count_if(known & found & ~wanted).alias("answered_wrong"),
        F.count_if(known & ~found & ~wanted).alias("refused_right"),
        F.count_if(known & ~found & wanted).alias("refused_wrong"),
    ]
    return rows.groupBy(*by).agg(*told) if by else rows.agg(*told)


def top_questions(messages: DataFrame, as_of: str, curated: Sequence[str] = (), days: int = 30, least: int = 12, k: int = 6) -> DataFrame:
    """(rank, question, n): the questions that users have asked most often in the last days (messages: role, text, at;
    ``least`` characters at least), shown as first asked; ties by the question. Where there are fewer than k, curated
    ones that are not among them follow in their order, with 0."""
    spark = messages.sparkSession
    since = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - days * 86400
    said = F.trim(F.coalesce("text", F.lit("")))
    asked = messages.where((F.col("role") == "user") & (F.char_length(said) >= least) & (F.unix_timestamp(F.col("at").cast("timestamp")) >= since))
    counted = asked.groupBy(normalized(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min_by(said, F.struct("at", said.alias("t"))).alias("question"))
    most = counted.orderBy(F.desc("n"), "key").limit(k)
    more = spark.createDataFrame([(i, q) for i, q in enumerate(curated)], "place int, question string").withColumn("key", normalized(F.col("question"))).groupBy("key").agg(F.min(F.struct("place", "question")).alias("c")).select("key", "c.*")
    every = most.select("key", "question", "n", F.lit(-1).alias("place")).unionByName(more.join(most.select("key"), "key", "left_anti").select("key", "question", F.lit(0).cast("long").alias("n"), "place"))
    # at most k and the curated ones
    return every.withColumn("rank", F.row_number().over(Window.orderBy("place", F.desc("n"), "key"))).where(F.col("rank") <= k).select("rank", "question", "n")


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """(category, layer, n, hit_rate, correct_intent, p95_ms, p99_ms) of runs (category, layer, rank, intent,
    wanted_intent, ms, control), control rows left out: overall, by category, and by category and layer."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms)")
    kept = runs.where(~F.coalesce("control", F.lit(False)))
    return kept.rollup("category", "layer").agg(F.count("*").alias("n"), share(F.col("rank").isNotNull()).alias("hit_rate"), share(F.col("intent") == F.col("wanted_intent")).alias("correct_intent"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"))


def intent_confusion(runs: DataFrame) -> DataFrame:
    """(wanted_intent, intent, n) of labelled runs."""
    return runs.where("wanted_intent IS NOT NULL").groupBy("wanted_intent", "intent").agg(F.count("*").alias("n"))


def retention(turns: DataFrame, by: str) -> DataFrame:
    """(by, n, retained, resolved, leaked, drifted) of turns (expected, carried, answered, foreign, topic,
    first_topic): shares of turns that keep the expected entity, are answered, name a foreign one, change the topic."""
    return turns.groupBy(by).agg(F.count("*").alias("n"), share(F.col("carried").eqNullSafe(F.col("expected"))).alias("retained"), share(F.col("answered")).alias("resolved"), share(F.col("foreign")).alias("leaked"), share(F.col("topic") != F.col("first_topic")).alias("drifted"))


def first_leaked(text: Column, terms: Sequence[str]) -> Column:
    """The first of the terms that stands in a text; null if none does."""
    return F.get(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t)), F.lit(0))


def load_levels(calls: DataFrame, by: str) -> DataFrame:
    """(by, n, p50, p95, p99, max, mean, throughput) of calls (ms, at): calls a second between the first and the last."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms)")
    seconds = F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))
    return calls.groupBy(by).agg(F.count("*").alias("n"), *[at(q).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.max("ms").alias("max"), mean(F.col("ms"), 3).alias("mean"), F.round(F.coalesce(F.count("*") / F.nullif(seconds, F.lit(0)), F.lit(0.0)), 6).alias("throughput"))


def gate(results: DataFrame, by: str, least: float) -> DataFrame:
    """(by, n, pass_rate, passed) of results (ok, error): rows of a harness error are left out."""
    kept = results.where("error IS NULL")
    return kept.groupBy(by).agg(F.count("*").alias("n"), share(F.col("ok")).alias("pass_rate")).withColumn("passed", F.col("pass_rate") >= least)


def certification(metrics: DataFrame, rules: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """(verdict, score, failed) of one row of metrics under rules (name, condition, weight): the weight of those that
    hold over all; certified from .9, conditional from .7."""
    total = sum(w for _, _, w in rules)
    held = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(0.0) for _, c, w in rules), F.lit(0.0)) / total
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c, _ in rules]), F.isnotnull)
    return metrics.select(F.when(held >= 0.9, "certified").when(held >= 0.7, "conditional").otherwise("failed").alias("verdict"), F.round(held, 6).alias("score"), F.array_join(failed, ",").alias("failed"))


def severities(alerts: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row: the number of alerts (severity) of each level."""
    return alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in levels])


def json_sizes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, largest, total): characters of each column as JSON; a null is written as one."""
    sized = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.char_length(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})).alias("n")) for c in columns])).alias("s")).select("s.*")
    return sized.groupBy("column").agg(F.count("*").alias("n"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("largest"), F.sum("n").alias("total"))


def coverage(rows: DataFrame, kinds: Mapping[str, Column], states: Mapping[str, Column], areas: Mapping[str, Sequence[str]], text: Column) -> DataFrame:
    """(kind, value, n): how many rows there are of each value of each of ``kinds`` (a null one is ``unknown``), in which
    of ``states`` (kind ``state``), and how many mention a marker of each area (kind ``area``). One scan: the groupings
    are grouping sets of one aggregation, whose row for all carries what is counted of the whole."""
    named = rows.select(*[F.coalesce(c.cast("string"), F.lit("unknown")).alias(f"k_{k}") for k, c in kinds.items()], *[F.coalesce(c, F.lit(False)).cast("int").alias(f"s_{k}") for k, c in states.items()], F.lower(text).alias("text"))
    met = lambda markers: F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains("text", m))
    named = named.select("*", *[F.coalesce(met(m), F.lit(False)).cast("int").alias(f"a_{k}") for k, m in areas.items()]).drop("text")
    columns = [f"k_{k}" for k in kinds]
    whole = [c for c in named.columns if c not in columns]
    by = named.groupingSets([[], *[[c] for c in columns]], *columns).agg(F.grouping_id(*columns).alias("set"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in whole])
    full = (1 << len(columns)) - 1
    own = [F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("value"), F.col("n").alias("n")) for k in kinds]
    total = [F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("value"), F.coalesce(f"{kind[0]}_{k}", F.lit(0)).cast("long").alias("n")) for kind, of in (("state", states), ("area", areas)) for k in of]
    every = F.array(F.struct(F.lit("all").alias("kind"), F.lit("all").alias("value"), F.col("n").alias("n")), *total)
    told = F.when(F.col("set") == full, every)
    for i, row in enumerate(own):  # the bit of a column that is grouped by is 0, the first one highest
        told = told.when(F.col("set") == full - (1 << (len(columns) - 1 - i)), F.array(row))
    return by.select(F.explode(told).alias("t")).select("t.*")


def missing_areas(found: DataFrame, areas: Sequence[str]) -> DataFrame:
    """One row: the areas of coverage() that nothing mentions, in their order."""
    met = found.where("kind = 'area' AND n > 0").agg(F.collect_set("value").alias("met"))
    return met.select(F.array_except(F.array(*[F.lit(a) for a in areas]), "met").alias("missing"))


def index_audit(rows: DataFrame, sample: int = 50) -> DataFrame:
    """(host, n, indexed, pending, failed, excluded, share, samples) of rows (url, host, state): counts by host, and of
    each the first failed URLs, ``sample`` at most."""
    place = F.row_number().over(Window.partitionBy("host").orderBy("url"))
    failed = rows.where("state = 'failed'").withColumn("p", place).where(F.col("p") <= sample).groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("samples"))
    by = rows.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.col("state") == s).alias(s) for s in ("indexed", "pending", "failed", "excluded")])
    return by.withColumn("share", F.round(F.col("indexed") / F.col("n"), 4)).join(failed, "host", "left")


def claim_gate(claims: DataFrame, least: float = 0.5, fewest: int = 1) -> DataFrame:
    """(answer_id, claims, kept, abstain, text) of claims (answer_id, claim, text, support): those supported well
    enough, in their order; an answer of fewer than ``fewest`` of them is withheld."""
    good = F.coalesce("support", F.lit(0.0)) >= least
    by = claims.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(good).alias("kept"), F.array_sort(F.collect_list(F.when(good, F.struct("claim", "text")))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    return by.select("answer_id", "claims", "kept", (F.col("kept") < fewest).alias("abstain"), F.when(F.col("kept") < fewest, "").otherwise(text).alias("text"))


def supported(claims: DataFrame, checkers: Sequence[Callable[[Column, Column], Column]]) -> DataFrame:
    """Adds ``support`` to claims (premise, text): that of the first checker which knows (is not null). A checker is a
    function of two columns: a lexical rule, or an Arrow function of a model."""
    return claims.withColumn("support", F.coalesce(*[check(F.col("premise"), F.col("text")) for check in checkers]))


def claim_contexts(claims: DataFrame, contexts: DataFrame) -> DataFrame:
    """(answer_id, claim, text, premise) of claims (answer_id, claim, text, cited: array of ids) with the texts of the
    contexts (answer_id, id, context) that they cite, in their order; no premise where none is known."""
    each = claims.select("answer_id", "claim", "text", F.posexplode_outer("cited").alias("pos", "id"))
    met = each.join(contexts, ["answer_id", "id"], "left").groupBy("answer_id", "claim", "text")
    return met.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("context").isNotNull(), F.struct("pos", "context")))), lambda x: x["context"]), "\n").alias("premise"))


def cross_lingual_penalty(question: Column, source: Column, weight: float = 0.15) -> Column:
    """What a source in another language costs; an unknown language (auto) costs nothing."""
    return F.when((question == "auto") | (source == "auto") | (question == source), 0.0).otherwise(weight)


def grounding_verdict(answers: DataFrame, least_score: float = 0.15, least_overlap: float = 0.08) -> DataFrame:
    """(answer_id, n, top, overlap, verdict) of answers' contexts (answer_id, answer, score, context): scores over 1.5
    are tenths; an answer is grounded if a context of enough score shares enough of its words."""
    scaled = F.when(F.col("score") > 1.5, F.col("score") / 10).otherwise(F.col("score"))
    words = F.array_distinct(tokens(F.col("answer"), "hyphenated", 2))
    shared = F.size(F.array_intersect(words, tokens(F.col("context"), "hyphenated", 2))) / F.greatest(F.size(words), F.lit(1))
    by = answers.withColumn("s", scaled).withColumn("o", shared).groupBy("answer_id").agg(F.count("context").alias("n"), F.round(F.max("s"), 6).alias("top"), F.round(F.max("o"), 6).alias("overlap"))
    verdict = F.when(F.col("n") == 0, "no_context").when(F.coalesce("top", F.lit(0.0)) < least_score, "weak_context").when(F.coalesce("overlap", F.lit(0.0)) < least_overlap, "ungrounded").otherwise("grounded")
    return by.withColumn("verdict", verdict)


def downgraded(confidence: Column, invalid: Column, total: Column) -> Column:
    """The confidence of an answer some of whose citations are invalid: half where all are, else less by their share."""
    return F.round(F.when(total == 0, confidence).when(invalid == total, confidence * 0.5).otherwise(confidence * (1 - 0.5 * invalid / total)), 6)


def worker_outcomes(passes: DataFrame) -> DataFrame:
    """(outcome, n) of a crawl's URLs (status, change): not_modified, gone, failed, or how the page has changed."""
    outcome = F.when(F.col("status") == 304, "not_modified").when(F.col("status").isin(404, 410), "gone").when((F.col("status") >= 400) | F.col("status").isNull(), "failed").otherwise(F.col("change"))
    return passes.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def golden_set(parts: Sequence[tuple[str, DataFrame]], templates: Sequence[str], target: int) -> DataFrame:
    """(question, origin, parent): the distinct questions of all parts (origin, (question)), the first part winning;
    then paraphrases by templates ({} is the question), in the order of templates and questions, up to ``target``."""
    every = None
    for i, (origin, part) in enumerate(parts):
        own = part.select(F.trim("question").alias("question"), F.lit(origin).alias("origin"), F.lit(i).alias("part"))
        every = own if every is None else every.unionByName(own)
    real = every.groupBy(F.lower("question").alias("key")).agg(F.min_by("question", F.struct("part", "question")).alias("question"), F.min_by("origin", F.struct("part", "question")).alias("origin"))
    real = real.select("question", "origin", F.lit(None).cast("string").alias("parent"), F.lit(-1).alias("t"))
    listed = F.posexplode(F.array(*[F.lit(t) for t in templates])).alias("t", "template")
    made = real.select(F.col("question").alias("parent"), listed).select(F.replace("template", F.lit("{}"), F.col("parent")).alias("question"), F.lit("synthetic").alias("origin"), "parent", "t")
    return real.unionByName(made).orderBy("t", F.coalesce("parent", "question")).limit(target).drop("t")


def assertion_results(answers: DataFrame, assertions: DataFrame) -> DataFrame:
    """(query_id, kind, value, passed) of answers (query_id, text, entity_type, host, supported) under assertions
    (query_id, kind, value): entity_type, contains, official (the host ends in the value), no_hallucination."""
    ok = (
        F.when(F.col("kind") == "entity_type", F.col("entity_type") == F.col("value"))
        .when(F.col("kind") == "contains", F.contains(F.lower("text"), F.lower("value")))
        .when(F.col("kind") == "official", F.endswith("host", F.col("value")))
        .when(F.col("kind") == "no_hallucination", F.col("supported"))
    )
    return assertions.join(answers, "query_id", "left").select("query_id", "kind", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def most_common(rows: DataFrame, arrays: Mapping[str, Column], n: int) -> DataFrame:
    """(kind, value, n, rank): the n most frequent values of each array column; ties by value."""

    def named(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    each = F.explode(F.flatten(F.array(*[F.transform(c, named(kind)) for kind, c in arrays.items()])))
    counted = rows.select(each.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    place = Window.partitionBy("kind").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def prune_impact(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: how many rows two texts of each are of, their characters before and after, the share saved, and how
    many a change detector by hash would call changed."""
    n = lambda c: F.char_length(F.coalesce(F.col(c), F.lit("")))
    saved = 1 - F.sum(n(after)) / F.nullif(F.sum(n(before)), F.lit(0))
    return rows.agg(F.count("*").alias("n"), F.sum(n(before)).alias("chars_before"), F.sum(n(after)).alias("chars_after"), F.round(F.coalesce(saved, F.lit(0.0)), 6).alias("saved"), F.count_if(F.sha2(F.coalesce(before, F.lit("")), 256) != F.sha2(F.coalesce(after, F.lit("")), 256)).alias("changed"))


def dataset_statistics(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share, mean_words, distinct_share): the distribution of a set of questions (question)."""
    words = F.size(tokens(F.col("question")))
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(words), 4).alias("mean_words"), F.round(F.countDistinct("question") / F.count("*"), 4).alias("distinct_share"))
    total = rows.agg(F.count("*").alias("_all"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("_all"), 4)).drop("_all")  # one row is broadcast


def deltas(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) of the keys that two runs (key, value) have both measured."""
    met = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    return met.withColumn("delta", F.col("after") - F.col("before"))
