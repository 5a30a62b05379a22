"""Near-duplicate documents by MinHash signatures in an LSH forest.

Each document's set of word shingles gives a signature of independent minima. The forest is a number of trees; a tree
is the documents in the order of a part of their signatures. Two documents with similarity s agree on the first d
values of one order with probability s**d, so close documents stand beside each other in some of the orders. All
documents that share the first LEAST_DEPTH values of an order, a run, are to meet. Neighbours in the orders, by their
longest common prefixes, are candidates, confirmed on the full shingle sets, and give groups; a short run is met whole
that way. Where a region is too crowded for that, a longer run that holds several groups, signatures tell too little:
its documents go down to the shingles themselves, and meet by their rarest ones, which is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.components import components
from gleanery.llm.names import free
from gleanery.llm.scratch import Scratch
from gleanery.llm.text_units import Words, constants, mix, slices

WIDTH = 5
TREES, DEPTH = 32, 8
#: Similarity 0.75 is met at this depth in one tree with probability 0.42, in none of 32 with 2e-8.
LEAST_DEPTH = 3
#: Neighbours on each side in an order, which meet first; in longer runs, rare shingles are then compared.
NEIGHBOURS = 4
#: Sums of the tally that orders shingles by how often they occur, a power of two: 4 bytes each in every task.
SLOTS = 1 << 20
#: Rows whose shingles a task holds at once, and of a batch of whole texts.
ROWS, BATCH = 256, 1024
#: Ids of candidates are broadcast up to so many (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000

_PLACE = constants(WIDTH + 1, 21)
_FACTOR, _FLIP = constants(TREES * 4, 22), constants(TREES * 4, 23)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all WIDTH-word shingles of a slice, and where those of each text begin (one entry more than texts).

    A text of fewer words is one shingle, a text without words none. Repeats are kept.
    """
    hashes, counts = words.hashes(fold=True), words.counts()
    begins = np.concatenate(([0], np.cumsum(counts)))
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    first = np.repeat(begins[:-1] - edges[:-1], sizes) + np.arange(edges[-1])
    padded = np.concatenate((hashes, np.zeros(WIDTH, np.uint64)))
    length = np.repeat(np.minimum(counts, WIDTH), sizes)
    total = np.zeros(len(first), np.uint64)
    for j in range(WIDTH):
        total += np.where(length > j, padded[first + j] * _PLACE[j], np.uint64(0))
    return mix(total + length.astype(np.uint64) * _PLACE[WIDTH]), edges


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for words in slices(texts):
        all_of, edges = shingles(words)
        for i in range(words.n):
            yield np.unique(all_of[edges[i] : edges[i + 1]])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows at most, for tasks that hold the shingles of all texts of one."""
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            yield batch.slice(i, ROWS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n_shingles, same: digest of the set, signature)."""
    for batch in batches:
        for words in slices(batch.column("text")):
            every, edges = shingles(words)
            full = np.flatnonzero(np.diff(edges))
            low = np.zeros((words.n, len(_FACTOR)), np.uint64)
            if len(full):
                for k, (a, b) in enumerate(zip(_FACTOR, _FLIP, strict=True)):
                    low[full, k] = np.minimum.reduceat((every ^ b) * a, edges[full])
            # the top bits, as bytes whose order is the order of the values
            signs = (low >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(words.n, -1, 4)[:, :, 1:]
            sets = [np.unique(every[edges[i] : edges[i + 1]]) for i in range(words.n)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(words.first, words.n),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "same": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    "signature": pa.array([signs[i].tobytes() if len(s) else None for i, s in enumerate(sets)], pa.binary()),
                }
            )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, signature) -> (tree, prefix, doc_id) for each tree: DEPTH values from the tree's own place on, around."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(n, TREES * 4, 3)
        for tree in range(TREES):
            part = signs[:, (4 * tree + np.arange(DEPTH)) % (TREES * 4)].reshape(n, -1)
            yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(n, tree, np.int32)), "prefix": pa.array([p.tobytes() for p in part], pa.binary()), "doc_id": batch.column("doc_id")})


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, prefix, doc_id) -> (a, b, depth) for neighbours whose common prefix has LEAST_DEPTH values or more.

    Rows without b tell, with depth -1, the documents of long runs, prefix being what the run shares; and without
    depth, the NEIGHBOURS rows at either end of the partition, which have neighbours in others.
    """
    kept, told, crowd = None, 0, _Crowds()
    for batch in batches:
        if not len(batch):
            continue
        rows = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint8).reshape(len(batch), DEPTH, 3)
        now = (batch.column("tree").to_numpy(), rows, batch.column("doc_id").to_numpy())
        fresh = len(batch)
        yield from crowd.told(*now)
        if told < NEIGHBOURS:
            yield _marked(*(v[: NEIGHBOURS - told] for v in now), None)
            told += fresh
        tree, rows, ids = now if kept is None else (np.concatenate(x) for x in zip(kept, now, strict=True))
        for gap in range(1, NEIGHBOURS + 1):
            # pairs whose later member is new in this batch
            from_ = max(0, len(ids) - fresh - gap)
            a, b = slice(from_, max(from_, len(ids) - gap)), slice(from_ + gap, None)
            equal = (rows[a] == rows[b]).all(axis=2) & (tree[a] == tree[b])[:, None]
            depth = np.minimum.accumulate(equal, axis=1).sum(axis=1)
            near = depth >= LEAST_DEPTH
            x, y = ids[a][near], ids[b][near]
            yield _met(np.minimum(x, y), np.maximum(x, y), depth[near])
        kept = tuple(v[-NEIGHBOURS:] for v in (tree, rows, ids))
    if kept is not None:
        yield _marked(*kept, None)


_MET = "a long, b long, depth long, tree int, prefix binary"


def _met(a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "depth": pa.array(depth.astype(np.int64)), "tree": pa.nulls(len(a), pa.int32()), "prefix": pa.nulls(len(a), pa.binary())})


def _marked(tree: np.ndarray, rows: np.ndarray, ids: np.ndarray, depth: int | None) -> pa.RecordBatch:
    """Rows without b."""
    depths = pa.nulls(len(ids), pa.int64()) if depth is None else pa.array(np.full(len(ids), depth, np.int64))
    return pa.RecordBatch.from_pydict({"a": pa.array(ids, pa.int64()), "b": pa.nulls(len(ids), pa.int64()), "depth": depths, "tree": pa.array(tree, pa.int32()), "prefix": pa.array([r.tobytes() for r in rows], pa.binary())})


class _Crowds:
    """Tells the documents of runs (a tree and LEAST_DEPTH values) of more than NEIGHBOURS rows of a sorted partition.

    A run that is cut by a partition's edge stands in the rows of either end, or is long enough on one side of it.
    """

    def __init__(self):
        self.long, self.tree, self.rows, self.ids = False, np.zeros(0, np.int32), np.zeros((0, LEAST_DEPTH, 3), np.uint8), np.zeros(0, np.int64)

    def told(self, tree: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        # the last run of the batches before comes first: whole while it is short, its last row if it is told already
        held = len(self.ids)
        tree, rows, ids = np.concatenate((self.tree, tree)), np.concatenate((self.rows, rows[:, :LEAST_DEPTH])), np.concatenate((self.ids, ids))
        starts = np.append(True, (rows[1:] != rows[:-1]).any(axis=(1, 2)) | (tree[1:] != tree[:-1]))
        run = np.cumsum(starts) - 1
        long = np.bincount(run) > NEIGHBOURS
        long[0] |= self.long
        chosen = long[run]
        if self.long:
            chosen[:held] = False
        if chosen.any():
            yield _marked(tree[chosen], rows[chosen], ids[chosen], -1)
        self.long = bool(long[-1])
        last = np.flatnonzero(run == run[-1])[-1 if self.long else 0 :]
        self.tree, self.rows, self.ids = tree[last], rows[last], ids[last]


def _shares(n: int, share: int) -> tuple[int, int]:
    """How many of the first of n shingles, in any one order, hold one of each partner's that are smaller or as large
    (which are met from the larger side), and of each partner's that are as large or larger."""
    return n - -(-share * n // 100) + 1, n - -(-2 * share * n // (100 + share)) + 1


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (slot, n): how many distinct shingles of all texts of a task fall into each slot."""
    n = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for own in shingle_sets(batch.column("text")):
            np.add.at(n, (own & np.uint64(SLOTS - 1)).astype(np.int64), 1)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})


def _rarest(shared, share: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, component, text) -> (shingle, doc_id, component, n, at, early): the rarest shingles of each text, by
        the tally, as many as _shares() says; at: the place in that order; early: whether a larger one may meet it."""
        tally = shared.value
        for batch in _pieces(batches):
            out = []
            for i, own in enumerate(shingle_sets(batch.column("text"))):
                some, few = _shares(len(own), share)
                order = np.lexsort((own, tally[(own & np.uint64(SLOTS - 1)).astype(np.int64)]))[:some] if len(own) else np.zeros(0, np.int64)
                out.append((np.full(len(order), i), own[order], np.full(len(order), len(own)), np.arange(len(order)), np.arange(len(order)) < few))
            row, shingle, n, at, early = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
            ids, groups = (batch.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "component"))
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(shingle.astype(np.uint64).view(np.int64)), "doc_id": ids, "component": groups, "n": pa.array(n, pa.int32()), "at": pa.array(at, pa.int32()), "early": pa.array(early.astype(bool))})

    return task


def _crowded(crowds: DataFrame, groups: DataFrame, docs: DataFrame, share: int, scratch: Scratch) -> DataFrame:
    """(a, b, depth): all pairs in different groups that may be linked, of documents whose runs are longer than the
    window and hold several groups. crowds: (tree, prefix, doc_id) of long runs.

    Any order of shingles finds all of them: of two sets that meet ``share``, the first shingles in that order have one
    in common, which stands so early in both that enough others can follow. The order is by a tally of SLOTS sums, so
    that shingles of templates come last. Of a shingle's documents, those outside its main group are held against all.
    """
    spark = docs.sparkSession
    named = crowds.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = named.groupBy("tree", "prefix").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    members = scratch.keep(named.join(mixed, ["tree", "prefix"], "left_semi").select("doc_id", "component").distinct(), "members")
    some = F.broadcast(members) if members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else members
    texts = docs.select("doc_id", "text").join(some, "doc_id").select("doc_id", "component", "text")
    tally = np.zeros(SLOTS, np.float32)
    sums = texts.select("text").mapInArrow(_tallied, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    tally[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    rare = texts.mapInArrow(_rarest(spark.sparkContext.broadcast(tally), share), "shingle long, doc_id long, component long, n int, at int, early boolean")
    by, of = Window.partitionBy("shingle"), Window.partitionBy("shingle", "component")
    told = rare.repartition("shingle").withColumn("c", F.count("*").over(of)).withColumn("main", F.max(F.struct("c", "component")).over(by)["component"])
    told = scratch.keep(told.withColumn("low", F.min("component").over(by)).withColumn("high", F.max("component").over(by)).where("low != high").drop("c", "low", "high"), "rare", BATCH)
    small, large = (told.select("shingle", "main", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "component", "n", "at", "early")]) for side in ("a", "b"))
    small = small.where("early_a")
    need = F.ceil(share * (F.col("n_a") + F.col("n_b")) / (100 + share))
    held = (F.col("component_a") != F.col("component_b")) & (F.struct("n_a", "doc_id_a") < F.struct("n_b", "doc_id_b")) & (100 * F.col("n_a") >= share * F.col("n_b"))
    held &= F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need
    met = small.where("component_a != main").drop("main").join(large.drop("main"), "shingle").where(held)
    met = met.unionByName(small.where("component_a = main").drop("main").join(large.where("component_b != main").drop("main"), "shingle").where(held))
    return met.groupBy(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).agg(F.count("*").alias("depth"))


def _confirm(share: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, text_a, b, text_b), by a -> the pairs whose sets meet 100 * intersection >= share * union."""
        last, mine = None, None
        for batch in _pieces(batches):
            ids, out = batch.column("a").to_pylist(), []
            change = [i for i, x in enumerate(ids) if i == 0 or x != ids[i - 1]]
            owned = dict(zip(change, shingle_sets(batch.column("text_a").take(pa.array(change, pa.int64()))), strict=True))
            for i, other in enumerate(shingle_sets(batch.column("text_b"))):
                if i in owned and ids[i] != last:
                    last, mine = ids[i], owned[i]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                out.append(both > 0 and 100 * both >= share * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(out, pa.bool_()))

    return task


def _agree(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, sign_a, sign_b) -> the pairs whose signatures agree in ``least`` values or more."""
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1, 3) for c in ("sign_a", "sign_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).all(axis=2).sum(axis=1) >= least))

    return task


def _confirmed(pairs: DataFrame, docs: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) that hold on the full sets; the texts of their members alone are shuffled."""
    used = pairs.select("a").union(pairs.select("b")).distinct()
    used = F.broadcast(used) if used.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else used
    texts = docs.join(used.withColumnRenamed("a", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    met = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    met = met.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return met.select("a", "text_a", "b", "text_b").sortWithinPartitions("a").mapInArrow(_confirm(share), "a long, b long")


def near_duplicates(docs: DataFrame, share: int = 75) -> DataFrame:
    """Groups of documents linked by ``100 * intersection >= share * union`` of their 5-word shingle sets.

    docs: doc_id, text; further columns are ignored. Returns one row per input row: doc_id, n_shingles, component_id
    (the smallest doc_id reachable over links), kept (doc_id is its component's). A null or empty text has an empty
    set and is its own group. Rows that repeat a doc_id count as one document, that of the greatest text, and give the
    same row each. A null doc_id is linked with nothing: its component_id is null and it is kept. An empty table gives
    no rows.

    Documents of equal sets are one class, represented by the smallest doc_id; only representatives enter the forest.
    Candidates are first taken two per document, best prefixes first, and confirmed; all others whose ends are not in
    one group by then are confirmed next, where their signatures do not rule them out (agreement six standard
    deviations below the mean at the threshold). Crowded regions come last, by rare shingles, in the same two steps. So
    no two documents of one run that are in different groups and may be linked are left unconfirmed.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if _repeats(docs):
        ids = docs.select("doc_id")
        docs = docs.where("doc_id IS NULL").union(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text")))
        one = _groups(docs, share)
        return ids.where("doc_id IS NOT NULL").join(one, "doc_id").union(one.where("doc_id IS NULL"))
    return _groups(docs, share)


def _groups(docs: DataFrame, share: int) -> DataFrame:
    """near_duplicates() of documents with different ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    signed = scratch.keep(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, same binary, signature binary"), "signed", BATCH)
    known = signed.where("doc_id IS NOT NULL AND same IS NOT NULL")
    classes = scratch.keep(known.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.min_by("signature", "doc_id").alias("signature")), "classes")
    ones = classes.select("doc_id", "signature")

    order = scratch.keep(ones.mapInArrow(_orders, "tree int, prefix binary, doc_id long"), "orders")
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = order.repartitionByRange(spread, "tree", "prefix", "doc_id").sortWithinPartitions("tree", "prefix", "doc_id")
    met = scratch.keep(ordered.mapInArrow(_neighbours, _MET), "met")
    scratch.drop("orders")
    # NEIGHBOURS rows at either end of each partition
    ends = met.where("b IS NULL AND depth IS NULL").select("tree", "prefix", F.col("a").alias("doc_id")).distinct().coalesce(1).sortWithinPartitions("tree", "prefix", "doc_id")
    found = met.union(scratch.keep(ends.mapInArrow(_neighbours, _MET), "ends"))
    pairs = scratch.keep(found.where("a != b").groupBy("a", "b").agg(F.sum("depth").alias("depth")), "pairs")
    crowds = found.where("depth = -1").select("tree", "prefix", F.col("a").alias("doc_id"))

    chosen = scratch.keep(_best(pairs), "chosen")
    links = scratch.keep(_confirmed(chosen, docs, share), "links", BATCH)
    groups = scratch.keep(components(links), "groups")

    rest = _between(pairs, groups).join(chosen, ["a", "b"], "left_anti")
    rest = rest.join(ones.select(F.col("doc_id").alias("a"), F.col("signature").alias("sign_a")), "a").join(ones.select(F.col("doc_id").alias("b"), F.col("signature").alias("sign_b")), "b")
    n = TREES * 4
    least = int(n * share / 100 - 6 * (n * share / 100 * (1 - share / 100)) ** 0.5)
    rest = scratch.keep(rest.select("a", "b", "sign_a", "sign_b").mapInArrow(_agree(least), "a long, b long"), "rest")
    scratch.drop("pairs")

    def confirmed(pairs: DataFrame, name: str) -> None:
        nonlocal groups
        if pairs.isEmpty():
            return
        fresh = scratch.keep(_confirmed(pairs, docs, share), f"links_{name}", BATCH)
        if not fresh.isEmpty():
            stars = groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            groups = scratch.keep(components(stars.union(fresh)), f"groups_{name}")

    confirmed(rest, "rest")
    late = scratch.keep(_crowded(crowds, groups, docs, share, scratch), "late")
    scratch.drop("chosen", "rest", "met", "ends", "members", "rare")
    first = scratch.keep(_best(late), "first")
    confirmed(first, "first")
    last = scratch.keep(_between(late, groups).join(first, ["a", "b"], "left_anti"), "last")
    confirmed(last, "last")
    scratch.drop("late", "first", "last")

    member = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")).join(classes.select("same", F.col("doc_id").alias("rep")), "same", "left")
    labelled = member.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return labelled.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _best(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are among the two deepest of either end."""
    ends = pairs.select(F.col("a").alias("n"), F.col("b").alias("m"), "depth").union(pairs.select("b", "a", "depth"))
    best = ends.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("depth"), "m"))).where("r <= 2")
    return best.select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b")).distinct()


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different groups."""

    def grouped(frame: DataFrame, end: str) -> DataFrame:
        return frame.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))

    return grouped(grouped(pairs.select("a", "b"), "a"), "b").where("of_a != of_b").select("a", "b")


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id stands in several rows."""
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def drop_near_duplicates(docs: DataFrame, share: int = 75) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their group; of rows that repeat a doc_id, the one of the
    greatest text, which was judged. All rows with a null doc_id stay."""
    found = near_duplicates(docs, share)
    gone, row = free(docs.columns, "gone"), free(docs.columns, "row")
    out = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(out, F.col("doc_id") == F.col(gone), "left_anti")
    if not _repeats(docs):
        return left
    # a struct, as texts that are null are to be ordered too
    judged = left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), F.struct("text")).alias(row)).select(f"{row}.*")
    return left.where("doc_id IS NULL").union(judged)
