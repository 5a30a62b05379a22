"""Document fingerprints by consistent weighted sampling.

A document is its words, weighted by how often they occur. For sample k, each word draws r and c from Gamma(2, 1) and b
from U(0, 1), all fixed by a hash of the word and k; with t = floor(ln w / r + b) the word's value is
ln c - r (t - b) - r, and the word of the smallest value is sampled, together with its t. Two documents draw the same
sample with a probability that equals their generalised Jaccard similarity, sum of min over sum of max of weights.

Everything is DataFrame code. Gamma draws are looked up in quantiles of the distribution, which one query computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.scratch import Scratch

SAMPLES = 64
#: Quantiles of the Gamma table: 2 to this power.
TABLE_BITS = 14
#: Hexadecimal digits of a sample in a fingerprint.
DIGITS = 6
WHITE = r"[\x20\x09-\x0D]+"
_MASK = (1 << (4 * DIGITS)) - 1


def gamma_table(spark: SparkSession) -> DataFrame:
    """Two equal rows, for even and odd words: mid-quantiles of Gamma(2, 1), by bisection of 1 - (1 + x) exp(-x), and
    their logarithms."""
    n = 1 << TABLE_BITS
    half = lambda s: (s["lo"] + s["hi"]) / 2
    below = lambda s: 1 - (1 + half(s)) * F.exp(-half(s)) < (F.col("id") + 0.5) / n
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(64.0).alias("hi"))
    step = lambda s, _: F.struct(F.when(below(s), half(s)).otherwise(s["lo"]).alias("lo"), F.when(below(s), s["hi"]).otherwise(half(s)).alias("hi"))
    x = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, half)
    listed = spark.range(0, n, 1, 1).select(x.alias("x")).agg(F.sort_array(F.collect_list("x")).alias("r"))
    return listed.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("odd"), "r", F.transform("r", lambda x: F.ln(x)).alias("ln_c"))


def sampled(weighted: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """Adds ``samples`` (array of numbers below 2 ** (4 * DIGITS)) to each group of ``keys``: weighted has a column h,
    the hash of a term (null: the group has none), and w, its weight. A group without terms has the largest number."""
    table = F.broadcast(gamma_table(weighted.sparkSession))  # two rows of 2**TABLE_BITS numbers
    places = (1 << TABLE_BITS) - 1

    def value(k: int) -> str:
        """The word's value, in fixed point and moved to be positive, above the bits that name the sample."""
        drawn = f"xxhash64(h, {k})"
        r = f"get(r, int({drawn} & {places}))"
        ln_c = f"get(ln_c, int(shiftright({drawn}, {TABLE_BITS}) & {places}))"
        b = f"(shiftrightunsigned({drawn}, 44) / {float(1 << 20)}D)"
        t = f"floor(ln_w / {r} + {b})"
        name = f"((shiftright({drawn}, {2 * TABLE_BITS}) ^ ({t} * 40503)) & {_MASK})"
        return f"min(shiftleft(bigint(({ln_c} - {r} * ({t} - {b} + 1) + 96) * {float(1 << 31)}D), {4 * DIGITS}) | {name}) AS s{k}"

    looked_up = weighted.select(*keys, "h", F.ln("w").alias("ln_w"), F.col("h").bitwiseAND(1).cast("int").alias("odd")).join(table, "odd", "left")
    lows = looked_up.groupBy(*keys).agg(*[F.expr(value(k)) for k in range(samples)])
    return lows.select(*keys, F.expr(f"array({', '.join(f'coalesce(s{k} & {_MASK}, {_MASK}L)' for k in range(samples))})").alias("samples"))


def as_text(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s)), DIGITS, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples: an estimate of the generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def document_key(doc_id: Column) -> Column:
    """A key that is never null, for joins and groups that null ids take part in. Plain equality of one column keeps
    rows where the first join has dealt them."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def neighbours(ids: DataFrame) -> DataFrame:
    """(key, doc_id, next_key, n_chars) of documents (doc_id, n_chars) with different ids: the next by descending doc_id;
    after the last comes the first.

    The ids are sorted over all tasks; a row's place is its place in its part and the number of rows before that part.
    """
    scratch = Scratch(ids.sparkSession, "neighbours")
    placed = ids.orderBy(F.col("doc_id").desc_nulls_last()).select(document_key(F.col("doc_id")).alias("key"), "doc_id", "n_chars", F.monotonically_increasing_id().alias("m"))
    placed = scratch.keep(placed, "placed").withColumn("part", F.shiftright("m", 33))
    # one row for each part of the sort
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.sum("n").over(Window.orderBy("part")).alias("to"), F.sum("n").over(Window.partitionBy()).alias("all")).join(parts, "part").select("part", (F.col("to") - F.col("n")).alias("before"), "all")
    numbered = scratch.keep(placed.join(F.broadcast(parts), "part").select("key", "doc_id", "n_chars", "all", (F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("place")), "numbered")
    scratch.drop("placed")
    after = numbered.select(F.col("key").alias("next_key"), F.when(F.col("place") == 0, F.col("all")).otherwise(F.col("place")).alias("at"))
    return numbered.join(after, F.col("place") + 1 == F.col("at")).select("key", "doc_id", "next_key", "n_chars")


def edited_texts(docs: DataFrame, follows: DataFrame) -> DataFrame:
    """(key, text, edited) of docs (key, text) with different ids, by neighbours(): the last floor(n_chars / 3)
    characters are replaced by the first as many, or all, of the next document's. Texts are shuffled once, by key."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    heads = docs.join(follows.select(F.col("key").alias("of"), "next_key", "n_chars"), F.col("key") == F.col("next_key"))
    heads = heads.select("of", F.col("n_chars").cast("int").alias("n"), F.substr("text", F.lit(1), third).alias("head"))
    met = docs.join(heads, F.col("key") == F.col("of"))
    return met.select("key", "text", F.concat(F.substr("text", F.lit(1), F.col("n") - F.floor(F.col("n") / 3).cast("int")), "head").alias("edited"))


def weighted_words(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` without ``text``, one row for each word of it: h, the word's hash (null: no words), and w, how often
    it occurs. Words are counted within the row, as runs of its sorted hashes."""
    rest = [c for c in texts.columns if c != text]
    hashed = texts.select(*rest, F.sort_array(F.transform(F.array_remove(F.split(text, WHITE), ""), lambda w: F.xxhash64(w))).alias("a"))
    begins = hashed.select(*rest, "a", F.when(F.size("a") > 0, F.expr("filter(sequence(0, size(a) - 1), i -> i = 0 OR a[i] != a[i - 1])")).alias("s"))
    runs = begins.select(*rest, F.explode_outer(F.expr("transform(s, (p, i) -> struct(a[p] AS h, coalesce(get(s, i + 1), size(a)) - p AS w))")).alias("r"))
    return runs.select(*rest, "r.h", "r.w")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of documents, of an edited text of each, and how alike they and the next document are.

    docs: doc_id, text; further columns are ignored. Edited texts are those of edited_texts(), the next document the
    one of neighbours(). Returns one row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null is an empty text; texts without words have one common
    fingerprint. Rows that repeat a doc_id count as one document, that of the greatest text, and give the same row
    each; null ids are one document, the last. A single document is its own next. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _fingerprints(docs, samples)
    one = _fingerprints(docs.groupBy("doc_id").agg(F.max("text").alias("text")), samples).withColumnRenamed("doc_id", "_one")
    return docs.select("doc_id").join(one, F.col("doc_id").eqNullSafe(F.col("_one"))).drop("_one")


def _fingerprints(docs: DataFrame, samples: int) -> DataFrame:
    """fingerprints() of documents with different ids."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    follows = scratch.keep(neighbours(docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"))), "follows")
    own = edited_texts(docs.select(document_key(F.col("doc_id")).alias("key"), "text"), follows)
    sides = own.select("key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s"))
    # rows are dealt by key since the join, so the minima don't move them
    lows = sampled(weighted_words(sides.select("key", "s.side", "s.t"), "t"), ["key", "side"], samples)
    of_side = lambda n: F.max(F.when(F.col("side") == n, F.col("samples")))
    both = lows.groupBy("key").agg(of_side(0).alias("own"), of_side(1).alias("edit"))
    facts = own.select("key", F.sha2("edited", 256).alias("edited_sha256")).join(follows, "key")
    prints = scratch.keep(facts.join(both, "key"), "prints")
    scratch.drop("follows")
    after = prints.select(F.col("key").alias("next_key"), F.col("own").alias("next_own"))
    met = prints.join(after, "next_key")
    return met.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
