"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's share p of all tokens becomes the weight p**a / sum of p**a. Bisection finds the smallest exponent a in
[0, 1], the flattest mixture, under which neither the entropy of the weights exceeds a target nor a source is repeated
more often than a limit. A source's part of the token budget is drawn epoch by epoch. Each epoch is a permutation of
the source's documents by a hash: blocks in their order, and documents in theirs within a block. Whole epochs are
taken, and of the last one the documents up to the budget.

Everything is DataFrame code. The cut of the last epoch is found digit by digit of the hash, so that no source, however
large, is sorted or gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.names import free
from gleanery.llm.scratch import Scratch

WHITE = r"[\x20\x09-\x0D]+"
#: Bits of a digit of the hash: 2 ** DIGIT blocks in an epoch. The cut is sought over DEPTH digits, then by document.
DIGIT, DEPTH, BITS = 10, 3, 63
#: Sources are broadcast up to so many (100 bytes each); beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


#: Columns that are added to what is drawn.
COLUMNS = ("mix_epoch", "mix_block", "mix_position", "mix_weight")


def word_count(text: Column) -> Column:
    """Words of a text as a count of its tokens; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")).cast("long")


def exponent(shares: DataFrame, fits: Callable[[Column, Column, Column], Column], rounds: int = 6, ways: int = 32) -> float:
    """The smallest a in [0, 1] that fits, if all larger ones do; 1 if none does.

    shares: p > 0. fits gets the columns a, entropy of the weights and the largest ratio of weight to share. A round
    evaluates ``ways`` points of the bracket in one aggregation and keeps the part where the answer changes.
    """
    low, high = 0.0, 1.0
    for _ in range(rounds):
        points = F.sequence(F.lit(0), F.lit(ways))
        at = shares.select("p", F.explode(points).alias("i")).select("p", "i", (low + (high - low) * F.col("i") / ways).alias("a"))
        x = F.pow("p", "a")
        sums = at.groupBy("i", "a").agg(F.sum(x).alias("z"), F.sum(x * F.ln("p")).alias("l"), F.max(F.pow("p", F.col("a") - 1)).alias("m"))
        bad = [r["i"] for r in sums.where(~F.coalesce(fits(F.col("a"), F.ln("z") - F.col("a") * F.col("l") / F.col("z"), F.col("m") / F.col("z")), F.lit(False))).select("i").collect()]  # at most ways + 1 rows
        last_bad = max(bad, default=-1)
        if last_bad < 0:
            return low
        if last_bad == ways:
            return high
        low, high = low + (high - low) * last_bad / ways, low + (high - low) * (last_bad + 1) / ways
    return high


def source_plan(sized: DataFrame, budget: int | None, repetition: float, entropy: float | None) -> DataFrame:
    """(source, tokens, weight, epochs, whole, rest): how often each source with tokens is drawn, in whole epochs and
    in tokens of one more."""
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    scratch = Scratch(sized.sparkSession, "mixing-totals")
    totals = scratch.keep(totals, "totals")
    everything, kinds = totals.agg(F.sum("tokens"), F.count("*")).first()
    everything = everything or 1
    budget = everything if budget is None else budget
    if budget > repetition * everything:
        raise ValueError("the budget needs more repetitions than the limit allows")
    shares = totals.select((F.col("tokens") / everything).alias("p"))
    if entropy is None:  # half-way from the natural mixture to the uniform one
        natural = shares.agg(-F.sum(F.col("p") * F.ln("p"))).first()[0] or 0.0
        entropy = (natural + math.log(max(1, kinds))) / 2
    a = exponent(shares, lambda a, h, ratio: (h <= entropy + 1e-12) & (ratio * budget / everything <= repetition + 1e-12))
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens") / everything, F.lit(a)) / z
    drawn = F.floor(weight * budget)
    plan = totals.select("source", "tokens", weight.alias("weight"), (drawn / F.col("tokens")).alias("epochs"), F.floor(drawn / F.col("tokens")).alias("whole"), drawn.alias("drawn"))
    return plan.withColumn("rest", F.col("drawn") - F.col("whole") * F.col("tokens")).drop("drawn")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def place(key: Column, epoch: Column, seed: int) -> Column:
    """A row's place in the permutation of an epoch: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), key), 64 - BITS)


def epoch_cuts(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(source, cut): of the epoch after the whole ones, the rows at places up to ``cut`` fit the rest of the budget.

    Rows at one place go together. Each level sums the rows under the prefix found so far by their next digit, and
    finds the digit within which the budget ends: at most 2 ** DIGIT sums a source.
    """
    scratch = Scratch(sized.sparkSession, "mixing-cuts")
    known = plan.select(F.col("source").alias("s"), "whole", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    placed = sized.join(_bounded(known.select("s", "whole")), _same("source", "s")).select("source", "n_tokens", place(F.col("key"), F.col("whole"), seed).alias("at"))
    cuts = scratch.keep(known.drop("whole"), "level0")
    for level in range(1, DEPTH + 1):
        shift = BITS - DIGIT * level
        under = placed.join(_bounded(cuts), _same("source", "s")).where(F.shiftright("at", shift + DIGIT) == F.col("prefix"))
        sums = under.groupBy("s", "left", F.shiftright("at", shift).alias("digit")).agg(F.sum("n_tokens").alias("n"))
        running = sums.withColumn("to", F.sum("n").over(Window.partitionBy("s").orderBy("digit")))
        ends = running.where(F.col("to") > F.col("left")).groupBy("s").agg(F.min_by(F.struct("digit", (F.col("left") - F.col("to") + F.col("n")).alias("left")), "digit").alias("e"))
        cuts = scratch.keep(ends.select("s", F.col("e.left").alias("left"), F.col("e.digit").alias("prefix")), f"level{level}")
    last = placed.join(_bounded(cuts), _same("source", "s")).where(F.shiftright("at", BITS - DIGIT * DEPTH) == F.col("prefix"))
    last = last.groupBy("s", "left", "prefix", "at").agg(F.sum("n_tokens").alias("n")).withColumn("to", F.sum("n").over(Window.partitionBy("s").orderBy("at")))
    ends = last.groupBy("s", "prefix").agg(F.max(F.when(F.col("to") <= F.col("left"), F.col("at"))).alias("at"))
    return scratch.keep(ends.select(F.col("s").alias("source"), F.coalesce("at", F.shiftleft("prefix", BITS - DIGIT * DEPTH) - 1).alias("cut")), "cuts")


def _bounded(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def mixture(docs: DataFrame, budget: int | None = None, repetition: float = 4.0, entropy: float | None = None, seed: int = 0, tokens: Callable[[Column], Column] = word_count) -> DataFrame:
    """Rows of docs (doc_id, text, source and any others), drawn to the weights of their sources.

    budget: tokens to draw, those of docs by default. repetition: epochs of a source at most. entropy: of the weights
    at most, in nats; half-way between the natural and the uniform mixture by default. tokens: the token count of a
    text column. A row drawn in n epochs comes n times, with mix_epoch, mix_block (its block in that epoch's
    permutation), mix_position (0 to 1; in its order all sources are interleaved by their weights) and mix_weight (of
    its source); clashing columns are replaced. No source gets more tokens than its part of the budget, and it falls
    short by less than the document that no longer fits. A null source is a source; null and empty texts have no
    tokens and go with the documents at their places; sources without tokens are not drawn. Repeated rows go together.
    An empty table gives no rows.
    """
    docs = docs.drop(*COLUMNS)
    own = docs.columns
    key_name, plan_name, source_name = (free([*own, *COLUMNS], n) for n in ("key", "plan", "of_source"))
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.xxhash64("doc_id", "text")
    sized = scratch.keep(docs.select("source", key.alias("key"), tokens(F.col("text")).alias("n_tokens")), "sized")
    plan = scratch.keep(source_plan(sized, budget, repetition, entropy), "plan")
    cuts = epoch_cuts(sized, plan, seed)
    told = plan.select(F.col("source").alias(source_name), "weight", "epochs", "whole").join(_bounded(cuts), _same(source_name, "source"), "left")
    told = scratch.keep(told.select(source_name, F.struct("weight", "epochs", "whole", "cut").alias(plan_name)), "told")
    scratch.drop("sized")
    of = F.col(plan_name)
    in_last = F.coalesce(place(F.col(key_name), of["whole"], seed) <= of["cut"], F.lit(False))
    copies = of["whole"] + in_last.cast("long")
    met = docs.withColumn(key_name, key).join(_bounded(told), _same("source", source_name))
    met = met.where(copies > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    at = place(F.col(key_name), F.col("mix_epoch"), seed)
    met = met.withColumn("mix_block", F.shiftright(at, BITS - DIGIT)).withColumn("mix_position", (F.col("mix_epoch") + at / F.lit(float(1 << BITS))) / of["epochs"])
    return met.select(*own, F.col("mix_epoch").cast("int"), F.col("mix_block").cast("int"), F.least("mix_position", F.lit(1.0)).alias("mix_position"), of["weight"].alias("mix_weight"))


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows dealt over tasks by a hash and each task's in the order of the mixture, without the columns of it."""
    return mixed.repartition(F.xxhash64("mix_epoch", "doc_id")).sortWithinPartitions("mix_position").drop(*COLUMNS)
