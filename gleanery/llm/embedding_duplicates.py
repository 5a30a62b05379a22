"""Near-duplicate embeddings: codes by iterative quantisation, multi-index Hamming tables, rerank on the vectors.

A rotation is learned so that the signs of rotated vectors lose as little as can be; several, from different starts,
give a long binary code. The code's bits are dealt into tables of a few bits each. Vectors that agree on all bits of a
table meet there; those whose codes are within a Hamming distance go on, and their cosines, from the original vectors
in double precision, decide. Two vectors at the threshold disagree in a bit with probability angle / pi, whatever the
others are, so the number of tables that finds them follows from the number of bits of a table; it is measured on
vectors turned by just that angle. Codes are of the vectors as they are, not of what is left when their mean is taken
away: in a table of one close group that would be noise.

Dense groups are not compared pair by pair. Vectors that share a much longer key hang on the smallest of them if they
are within half the angle of the threshold: a ball, all of whose members are linked with each other. Balls take part in
the tables in place of their members, and where two meet, the triangle inequality tells whether all members are linked,
or none; else it is asked again for each member of one and the whole other, and only what is open then is compared
vector by vector.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.components import components
from gleanery.llm.scratch import Scratch
from gleanery.llm.text_units import mix
from gleanery.llm.vectors import is_finite, matrices, one_row_an_id, units

THRESHOLD = 0.9
#: Vectors that rotations are learned from, and the steps of learning.
SAMPLE, STEPS = 4_096, 20
#: Bits of the code whose Hamming distance is measured; the tables may take more.
BITS = 256
#: Vectors of a table's bucket on average, and the share of pairs at the threshold that the tables are to find.
OCCUPANCY, FOUND = 128, 0.98
#: Rows of a bucket that one task compares with each other; larger buckets are compared block by block.
BLOCK = 512
#: Keys that find dense groups: their number, how many bits longer than a table's they are, and rows that make one.
DENSE_KEYS, DENSE_BITS, DENSE = 6, 12, 8
#: Large buckets are broadcast up to so many (20 bytes each); beyond, the join shuffles.
BROADCAST_BUCKETS = 200_000


def quantised(sample: np.ndarray, seed: int, steps: int = STEPS) -> np.ndarray:
    """A rotation (d x d) by which the signs of the rotated sample are as close to it as iteration brings them."""
    width = sample.shape[1]
    _, main = np.linalg.eigh(sample.T @ sample)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]
    projected = sample @ main
    for _ in range(steps if len(sample) else 0):
        signs = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(projected.T @ signs)
        turn = u @ v
    return main @ turn


class Codes:
    """The projections of one width: column i gives bit i; the tables' bits, and the Hamming distance that is let through."""

    def __init__(self, sample: np.ndarray, bits: int, angle: float):
        width = sample.shape[1]
        self.bits = bits
        own = max(BITS, bits, DENSE_KEYS * DENSE_BITS)
        tables = min(512, 2 * math.ceil(math.log(1 - FOUND) / math.log(1 - (1 - angle / math.pi) ** bits))) if bits else 1
        own = max(own, tables * bits)
        self.projections = np.hstack([quantised(sample, seed) for seed in range(-(-own // width))])[:, :own]
        # vectors at just the angle of the threshold: how many tables find them, and how far apart their codes are
        rng = np.random.default_rng(7)
        at = sample[:2048] if len(sample) else units(rng.standard_normal((2048, width)))
        aside = rng.standard_normal(at.shape)
        aside -= (aside * at).sum(axis=1, keepdims=True) * at
        aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-12)
        unlike = self.signs(at) != self.signs(math.cos(angle) * at + math.sin(angle) * aside)
        met = ~unlike[:, : tables * bits].reshape(len(at), tables, -1).any(axis=2) if bits else np.ones((len(at), 1), bool)
        share = np.logical_or.accumulate(met, axis=1).mean(axis=0)
        self.tables = int(np.argmax(share >= FOUND)) + 1 if (share >= FOUND).any() else tables
        self.excess = max(0.0, float(unlike[:, :BITS].sum(axis=1).max()) - _let_through(angle))

    def signs(self, of: np.ndarray) -> np.ndarray:
        return of @ self.projections >= 0

    def keys(self, signs: np.ndarray, bits: int, tables: int) -> Iterator[np.ndarray]:
        """The key of each row in each of ``tables`` tables."""
        for t in range(tables):
            packed = np.packbits(np.take(signs, np.arange(t * bits, (t + 1) * bits), axis=1, mode="wrap"), axis=1)
            whole = np.zeros(len(signs), np.uint64)
            for byte in packed.T:
                whole = mix((whole << np.uint64(8)) + byte.astype(np.uint64)) if bits > 56 else (whole << np.uint64(8)) + byte
            yield whole.astype(np.int64)


def _let_through(angle: np.ndarray | float) -> np.ndarray | float:
    """A Hamming distance over BITS that vectors at ``angle`` exceed by chance in some 1 of 10**5 cases."""
    p = np.minimum(angle / math.pi, 1.0)
    return BITS * p + 4.5 * np.sqrt(BITS * p * (1 - p))


def _columns(batch: pa.RecordBatch, of: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each width, with their unit vectors."""
    for rows, found in matrices(batch.column(of)):
        yield batch.take(pa.array(rows)), units(found)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (vec_id, same: a digest of the vector, embedding)."""
    for batch in batches:
        same: list[bytes | None] = [None] * len(batch)
        for rows, found in matrices(batch.column("embedding")):
            for i, v in zip(rows, found + 0.0, strict=True):  # -0.0 is 0.0
                same[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "same": pa.array(same, pa.binary()), "embedding": batch.column("embedding")})


def _coded(models: dict[int, Codes]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(ball, embedding) -> (ball, width, code)."""
        for batch in batches:
            for own, unit in _columns(batch, "embedding"):
                signs = models[unit.shape[1]].signs(unit)[:, :BITS]
                yield pa.RecordBatch.from_pydict({"ball": own.column("ball"), "width": pa.array(np.full(len(own), unit.shape[1], np.int32)), "code": pa.array([c.tobytes() for c in np.packbits(signs, axis=1)], pa.binary())})

    return task


def _dense(models: dict[int, Codes]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, embedding) -> (width, place, key, rep) for each of the long keys."""
        for batch in batches:
            for own, unit in _columns(batch, "embedding"):
                model = models[unit.shape[1]]
                for place, key in enumerate(model.keys(model.signs(unit), model.bits + DENSE_BITS, DENSE_KEYS)):
                    yield pa.RecordBatch.from_pydict({"width": pa.array(np.full(len(own), unit.shape[1], np.int32)), "place": pa.array(np.full(len(own), place, np.int32)), "key": pa.array(key), "rep": own.column("rep")})

    return task


def _dealt(models: dict[int, Codes]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(embedding, ball, alpha, code: null if the vector is its ball) -> (width, place, key, ball, alpha, code) for
        each table. Of a ball's members in a bucket, a batch sends one."""
        for batch in batches:
            for own, unit in _columns(batch, "embedding"):
                model, width = models[unit.shape[1]], unit.shape[1]
                signs = model.signs(unit)
                codes = pa.array([c.tobytes() for c in np.packbits(signs[:, :BITS], axis=1)], pa.binary())
                codes, ball = pc.coalesce(own.column("code"), codes), own.column("ball").to_numpy()
                for place, key in enumerate(model.keys(signs, model.bits, model.tables)):
                    rows = pa.array(np.unique(np.column_stack((key, ball)), axis=0, return_index=True)[1])
                    constant = (pa.array(np.full(len(rows), x, np.int32)) for x in (width, place))
                    yield pa.RecordBatch.from_arrays([*constant, pa.array(key).take(rows), *(own.column(c).take(rows) for c in ("ball", "alpha")), codes.take(rows)], ["width", "place", "key", "ball", "alpha", "code"])

    return task


_DEALT = "width int, place int, key long, ball long, alpha double, code binary"


def _compared(angle: float, excess: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (width, place, key, low, high, own, ball, alpha, code) -> (a, b): balls of one group (the first five)
        whose codes are close enough; if low and high are two blocks, one of each."""
        names, kept = ("width", "place", "key", "low", "high", "own", "ball", "alpha"), None
        for batch in batches:
            if not len(batch):
                continue
            now = {c: batch.column(c).to_numpy() for c in names} | {"code": np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(len(batch), -1)}
            fresh = len(batch)
            rows = now if kept is None else {c: np.concatenate((kept[c], now[c])) for c in now}
            n = len(rows["ball"])
            starts = np.append(True, np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in names[:5]]))
            group = np.cumsum(starts) - 1
            later = np.arange(n - fresh, n)  # pairs whose later member is new in this batch
            for gap in range(1, n):
                later = later[later >= gap]
                later = later[group[later] == group[later - gap]]
                if not len(later):
                    break
                i, j = later - gap, later
                fit = (rows["ball"][i] != rows["ball"][j]) & ((rows["low"][j] == rows["high"][j]) | (rows["own"][i] != rows["own"][j]))
                i, j = i[fit], j[fit]
                far = np.bitwise_count(rows["code"][i] ^ rows["code"][j]).sum(axis=1, dtype=np.int64)
                near = far <= _let_through(angle + rows["alpha"][i] + rows["alpha"][j]) + excess
                a, b = rows["ball"][i[near]], rows["ball"][j[near]]
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
            last = int(np.flatnonzero(starts)[-1])
            kept = {c: v[last:] for c, v in rows.items()}

    return task


def _angles(batch: pa.RecordBatch, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and angles of the vectors of two columns, -1 where their widths differ."""
    cosine = np.full(len(batch), -1.0)
    alike = np.flatnonzero(batch.column(a).value_lengths().to_numpy(zero_copy_only=False) == batch.column(b).value_lengths().to_numpy(zero_copy_only=False))
    rows = batch.take(pa.array(alike))
    for at, mine in matrices(rows.column(a)):
        other = next(iter(matrices(rows.column(b).take(pa.array(at)))))[1]
        cosine[alike[at]] = (units(mine) * units(other)).sum(axis=1)
    return cosine, np.arccos(np.clip(cosine, -1.0, 1.0))


def _with_angle(a: str, b: str, name: str, most: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the angle of two columns in place of them; rows above ``most`` go."""
        for batch in batches:
            _, angle = _angles(batch, a, b)
            rest = [c for c in batch.schema.names if c not in (a, b)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(angle)], [*rest, name]).filter(pa.array(angle <= most))

    return task


def _decided(threshold: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(..., embedding_a, alpha_a, embedding_b, alpha_b) -> what stands before, and all: whether all members of the
        two balls are linked (true), or some may be (false); pairs without a link go."""
        limit, slack = math.acos(threshold), 1e-7
        for batch in batches:
            cosine, angle = _angles(batch, "embedding_a", "embedding_b")
            reach = batch.column("alpha_a").to_numpy() + batch.column("alpha_b").to_numpy()
            single = reach == 0
            all_of = np.where(single, cosine >= threshold, angle + reach <= limit - slack)
            kept = np.where(single, all_of, angle - reach <= limit + slack)
            rest = [c for c in batch.schema.names if c[:-2] not in ("embedding", "alpha")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(all_of.astype(bool))], [*rest, "all"]).filter(pa.array(kept.astype(bool)))

    return task


def _models(classes: DataFrame, angle: float) -> dict[int, Codes]:
    """Codes for each width, learned from about SAMPLE vectors, which are taken by a hash."""
    counted = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()}
    n = sum(counted.values())
    if not n:
        return {}
    share = int(min(1.0, SAMPLE / n) * (1 << 30))
    taken = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) <= share).select("embedding").limit(2 * SAMPLE).toArrow()
    found = {x.shape[1]: units(x) for _, x in matrices(taken.column("embedding").combine_chunks())} if len(taken) else {}
    bits = max(0, math.ceil(math.log2(n / OCCUPANCY)))
    return {w: Codes(found.get(w, np.zeros((0, w))), bits, angle) for w in counted}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Groups of vectors linked by a cosine of ``threshold`` (above 0, below 1) or more.

    vectors: vec_id, embedding; further columns are ignored. Returns one row per input row: vec_id, n_links (other
    vectors linked directly), component_id (the smallest vec_id reachable over links), kept (vec_id is its
    component's). Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and those
    of different widths not with each other. Rows that repeat a vec_id count as one vector, the greatest, and give the
    same row each. A null vec_id is linked with nothing: its component_id is null and it is kept. An empty table gives
    no rows.

    Equal vectors are one class, and only classes enter the tables. All links that are told hold on the vectors. Links
    are found by buckets that hold both ends; of those at the threshold itself FOUND are, of closer ones more. No bucket
    is cut: large ones are compared block by block.
    """
    spark, angle = vectors.sparkSession, math.acos(threshold)
    scratch = Scratch(spark, "embedding-duplicates")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = every.where("vec_id IS NOT NULL").where(is_finite(F.col("embedding"))).where(F.exists("embedding", lambda x: x != 0))
    signed = scratch.keep(one_row_an_id(usable).mapInArrow(_digests, f"vec_id long, same binary, embedding {every.schema['embedding'].dataType.simpleString()}"), "signed")
    classes = signed.groupBy("same").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = scratch.keep(classes.withColumn("width", F.size("embedding")), "classes")
    models = _models(classes, angle)
    excess = max((m.excess for m in models.values()), default=0.0)

    # dense groups: vectors near the smallest of those with which they share a long key
    keyed = classes.select("rep", "embedding").mapInArrow(_dense(models), "width int, place int, key long, rep long")
    crowd = keyed.groupBy("width", "place", "key").agg(F.min("rep").alias("ball"), F.count("*").alias("rows")).where(F.col("rows") >= DENSE).drop("rows")
    hung = scratch.keep(keyed.join(crowd, ["width", "place", "key"]).select("rep", "ball").distinct(), "hung")
    hung = hung.join(classes.select("rep", F.col("embedding").alias("embedding_a")), "rep").join(classes.select(F.col("rep").alias("ball"), F.col("embedding").alias("embedding_b")), "ball")
    half = angle / 2 - 1e-7
    hung = hung.select("rep", "ball", "embedding_a", "embedding_b").mapInArrow(_with_angle("embedding_a", "embedding_b", "angle", half), "rep long, ball long, angle double")
    hung = scratch.keep(hung.groupBy("rep").agg(F.min(F.struct("ball", "angle")).alias("to")).select("rep", "to.*"), "hung_on")
    members = classes.drop("same").join(hung, "rep", "left").withColumn("ball", F.coalesce("ball", "rep"))
    members = scratch.keep(members.select("rep", "n", "embedding", "ball", F.coalesce("angle", F.lit(0.0)).alias("angle")), "members")
    balls = members.groupBy("ball").agg(F.max("angle").alias("alpha"), F.sum("n").alias("size"))
    balls = scratch.keep(balls.join(classes.select(F.col("rep").alias("ball"), "embedding"), "ball"), "balls")

    # the tables
    wide = balls.where("alpha > 0").select("ball", "embedding").mapInArrow(_coded(models), "ball long, width int, code binary")
    # what members are joined with is written before, so that a ball of many members can be split over tasks
    wide = scratch.keep(wide.join(balls.select("ball", "alpha"), "ball").select("ball", "alpha", "code"), "wide")
    dealt = members.select("embedding", "ball").join(wide, "ball", "left").select("embedding", "ball", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), "code")
    dealt = scratch.keep(dealt.mapInArrow(_dealt(models), _DEALT), "dealt")
    dealt = dealt.where("alpha = 0").union(dealt.where("alpha > 0").dropDuplicates(["width", "place", "key", "ball"]))
    large = dealt.groupBy("width", "place", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK).withColumn("blocks", F.ceil(F.col("rows") / BLOCK)).drop("rows")
    large = scratch.keep(large, "large")
    large = F.broadcast(large) if large.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS else large
    split = dealt.join(large, ["width", "place", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
    split = split.withColumn("own", F.pmod(F.xxhash64("ball"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    keys = ["width", "place", "key", "low", "high"]
    split = split.select("width", "place", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "ball", "alpha", "code")
    pairs = split.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(_compared(angle, excess), "a long, b long")
    pairs = scratch.keep(pairs.distinct(), "pairs")
    scratch.drop("dealt", "large")

    # rerank: balls, then members against balls, then members
    side = lambda end: balls.select(F.col("ball").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("embedding", "alpha", "size")])
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "embedding_a", "alpha_a", "embedding_b", "alpha_b")
    met = scratch.keep(met.mapInArrow(_decided(threshold), "a long, b long, size_a long, size_b long, all boolean"), "met")
    member = members.select(F.col("ball").alias("a"), "rep", "n", F.col("embedding").alias("embedding_a"))
    single = met.where("NOT all").select("a", "b").join(member, "a").join(side("b"), "b")
    single = single.select("a", "b", "rep", "n", "size_b", "embedding_a", F.lit(0.0).alias("alpha_a"), "embedding_b", "alpha_b")
    single = scratch.keep(single.mapInArrow(_decided(threshold), "a long, b long, rep long, n long, size_b long, all boolean"), "single")
    other = members.select(F.col("ball").alias("b"), F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("embedding").alias("embedding_b"))
    last = single.where("NOT all").select("a", "b", "rep", "n").join(members.select("rep", F.col("embedding").alias("embedding_a")), "rep").join(other, "b")
    last = last.select("a", "b", "rep", "n", "rep_b", "n_b", "embedding_a", F.lit(0.0).alias("alpha_a"), "embedding_b", F.lit(0.0).alias("alpha_b"))
    last = scratch.keep(last.mapInArrow(_decided(threshold), "a long, b long, rep long, n long, rep_b long, n_b long, all boolean"), "last")

    to_ball = met.where("all").select(F.col("a").alias("ball"), F.col("size_b").alias("more")).union(met.where("all").select("b", "size_a")).union(single.where("all").select("b", "n"))
    to_ball = to_ball.groupBy("ball").agg(F.sum("more").alias("more"))
    to_one = single.where("all").select("rep", F.col("size_b").alias("more")).union(last.select("rep", "n_b")).union(last.select("rep_b", "n"))
    to_one = to_one.groupBy("rep").agg(F.sum("more").alias("more_one"))
    homes = members.where("ball != rep").select(F.col("rep").alias("a"), F.col("ball").alias("b"))  # a ball's centre may hang on another
    links = met.where("all").select("a", "b").union(single.where("all").select("a", "b")).union(last.select("a", "b")).union(homes.join(balls.select(F.col("ball").alias("a")), "a", "left_semi"))
    groups = scratch.keep(components(links), "groups")

    none = F.lit(0).cast("long")
    facts = balls.select("ball", "size").join(to_ball, "ball", "left").join(groups.withColumnRenamed("node", "ball"), "ball", "left")
    facts = scratch.keep(facts.select("ball", (F.col("size") - 1 + F.coalesce("more", none)).alias("of_ball"), F.coalesce("component", "ball").alias("component_id")), "facts")
    # one join by ball, whose largest partitions Spark can split
    told = members.select("rep", "ball").join(facts, "ball").join(to_one, "rep", "left")
    told = told.select("rep", (F.col("of_ball") + F.coalesce("more_one", none)).alias("n_links"), "component_id")
    told = signed.select("vec_id", "same").join(classes.select("same", "rep"), "same").join(told, "rep").select("vec_id", "n_links", "component_id")
    found = every.select("vec_id").join(told, "vec_id", "left").select("vec_id", F.coalesce("n_links", none).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
