"""Operators on embeddings against brute force, with every odd case."""

import hashlib
import itertools
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import clustering, embedding_duplicates, hard_negatives, vector_sql

ROWS = "vec_id long, embedding array<double>, label int, source string"
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.5] * 6, [float("nan")] + [0.5] * 7, [float("inf")] + [0.5] * 7]


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def turned(rng, at, angle):
    """Vectors at ``angle`` (each its own) from ``at``, in any direction."""
    aside = rng.standard_normal((len(angle), len(at)))
    aside = unit(aside - (aside @ at)[:, None] * at)
    return np.cos(angle)[:, None] * at + np.sin(angle)[:, None] * aside


def planted(width=64):
    rng = np.random.default_rng(5)
    rows = list(unit(rng.standard_normal((1200, width))))
    for at in rows[:400]:  # pairs about the threshold
        rows += list(turned(rng, at, np.arccos(rng.uniform(0.885, 0.93, 1))))
    rows += list(turned(rng, rows[500], rng.uniform(0.0, 0.16, 700)))  # close copies
    rows += list(turned(rng, rows[501], np.full(60, 0.28)))  # all linked with each other, none near another
    chain = [rows[502]]
    for _ in range(12):
        chain.append(turned(rng, chain[-1], np.array([0.4]))[0])
    rows += chain[1:] + [rows[500]] * 40  # and copies
    order = rng.permutation(len(rows))
    return np.array(rows)[order] * rng.uniform(0.5, 3.0, len(rows))[:, None]


def brute(x, threshold=0.9):
    u = unit(x)
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], len(x)).min(axis=1))
        if (new == low).all():
            return linked, low
        low = new


@pytest.fixture(scope="module")
def found_planted(spark):
    x = planted()
    frame = spark.createDataFrame([(i, list(map(float, v)), None, "s") for i, v in enumerate(x)], ROWS)
    return x, sorted(embedding_duplicates.near_duplicates(frame).collect())


def test_embedding_duplicates_find_what_brute_force_finds(found_planted):
    x, got = found_planted
    linked, low = brute(x)
    true, told = linked.sum(axis=1), np.array([r["n_links"] for r in got])
    assert [r["vec_id"] for r in got] == list(range(len(x)))
    assert (told <= true).all() and told.sum() >= 0.99 * true.sum()
    few = (true > 0) & (true < 5)  # most are pairs about the threshold
    assert told[few].sum() >= 0.95 * true[few].sum()
    assert (told[true >= 100] >= 0.99 * true[true >= 100]).all()


def test_embedding_duplicates_components(found_planted):
    x, got = found_planted
    linked, low = brute(x)
    same = np.array([r["component_id"] for r in got]) == low
    assert same.mean() > 0.97 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert all(r["component_id"] == r["vec_id"] for r in got if r["n_links"] == 0)


def test_embedding_duplicates_of_close_copies_are_exact(spark):
    rng = np.random.default_rng(2)
    at = unit(rng.standard_normal(64))
    x = np.vstack([turned(rng, at, rng.uniform(0.0, 0.1, 300)), unit(rng.standard_normal((300, 64)))])
    frame = spark.createDataFrame([(i, list(map(float, v)), 1, "s") for i, v in enumerate(x)], ROWS)
    linked, low = brute(x)
    assert [tuple(r) for r in sorted(embedding_duplicates.near_duplicates(frame).collect())] == [(i, n, c, i == c) for i, (n, c) in enumerate(zip(linked.sum(axis=1).tolist(), low.tolist(), strict=True))]


def test_embedding_duplicates_odd_rows(spark):
    v, w = [1.0, 2.0, -1.0, 0.5, 0.0, 3.0, 1.0, 1.0], [1.0, 2.0, -1.0, 0.6, 0.0, 3.0, 1.0, 1.1]
    rows = [(i, e, None, None) for i, e in enumerate(ODD)] + [(10, v, 1, "a"), (11, w, 2, "b"), (11, w, 2, "b"), (12, v, None, None), (13, [-c for c in v], 1, "c"), (14, [1.0, 2.0], 1, "d"), (15, [2.0, 4.0], 1, "d"), (None, v, 1, "e"), (16, [5.0], 1, "f"), (17, [1e-300] * 8, 1, "g"), (18, [1e300] * 8, 1, "g")]
    got = sorted(map(tuple, embedding_duplicates.near_duplicates(spark.createDataFrame(rows, ROWS).withColumn("component_id", F.lit("x")).withColumn("rep", F.lit(1))).collect()), key=str)
    wanted = [(i, 0, i, True) for i in range(6)] + [(10, 2, 10, True), (11, 2, 10, False), (11, 2, 10, False), (12, 2, 10, False), (13, 0, 13, True), (14, 1, 14, True), (15, 1, 14, False), (None, 0, None, True), (16, 0, 16, True), (17, 1, 17, True), (18, 1, 17, False)]
    assert got == sorted(wanted, key=str)
    assert embedding_duplicates.near_duplicates(spark.createDataFrame([], ROWS)).collect() == []


def test_a_rotation_is_one_and_lowers_the_loss():
    rng = np.random.default_rng(3)
    x = unit(rng.standard_normal((500, 12)) * np.linspace(3, 0.2, 12))
    loss = lambda r: ((np.where(x @ r >= 0, 1, -1) - x @ r) ** 2).sum()
    start, end = embedding_duplicates.quantised(x, 4, 0), embedding_duplicates.quantised(x, 4)
    assert np.allclose(end @ end.T, np.eye(12)) and loss(end) < loss(start)


def negatives_table(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.integers(-6, 7, 8) / 8], int(rng.integers(3)), "s") for i in range(420)]
    rows += [(500 + i, rows[i % 3][1], i % 3, "copy") for i in range(60)]
    return spark.createDataFrame(rows + [(700 + i, e, 1, None) for i, e in enumerate(ODD)] + [(800, [1.0] * 8, None, "s"), (None, [1.0] * 8, 1, "s"), (900, [1.0, 2.0], 1, "s"), (1000, [1.0, 3.0], 2, "s"), (1001, [1.0, 2.5], 2, "t"), (1100, [3e9] * 8, 1, "t")], ROWS)


def test_hard_negatives_equal_sql(spark, monkeypatch):
    """In many parts and blocks, with ties; -- the SQL is the query's, which moves the label of each seventh row."""
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 70)
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    rows = negatives_table(spark)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(rows.withColumn("label", moved).withColumn("width", F.lit("x")).withColumn("score", F.lit(1)), F.col("vec_id") % 100 == 0)
    con = duckdb.connect()
    con.register("embeddings", pa.Table.from_pylist([r.asDict() for r in rows.where("vec_id IS NOT NULL AND vec_id < 1100").collect()], schema=pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("label", pa.int32()), ("source", pa.string())])))
    wanted = con.sql(vector_sql.OP12_SQL)
    at = [wanted.columns.index(c) for c in got.columns]
    told = sorted(map(tuple, got.collect()))
    assert told == sorted(tuple(r[i] for i in at) for r in wanted.fetchall()) and len(told) > 20
    assert {r[0] for r in told} >= {0, 100, 200}


def test_hard_negatives_of_few_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert hard_negatives.hard_negatives(empty, F.lit(True)).collect() == []
    rows = [(0, [1.0, 1.0], 1, "s"), (1, [1.0, 0.0], 1, "s"), (1, [1.0, 0.0], 1, "s"), (2, [0.9, 0.0], 2, "s"), (3, [0.7, 0.0], 2, "s")]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("vec_id") == 0).collect()
    assert list(map(tuple, got)) == [(0, 1, 1, 2, 65536, 58880)]
    assert hard_negatives.hard_negatives(spark.createDataFrame(rows, ROWS), F.lit(None).cast("boolean")).collect() == []


def test_a_tree_prunes_nothing_that_counts():
    rng = np.random.default_rng(1)
    points = np.round(np.vstack([rng.standard_normal((500, 6)) * 9, np.repeat(rng.standard_normal((3, 6)) * 9, 80, axis=0)]))
    ids, labels, queries = rng.permutation(740), rng.integers(0, 3, 740), np.round(rng.standard_normal((40, 6)) * 9)
    low, high, of = rng.integers(-200, 0, 40), rng.integers(0, 300, 40), rng.integers(0, 3, 40)
    for same in (True, False):
        score, best = hard_negatives.search(hard_negatives.BallTree(points), ids, labels, queries, ids[:40], of, same, low, high, 4)
        for q in range(40):
            fit = sorted((-int(points[i] @ queries[q]), int(ids[i])) for i in range(740) if (labels[i] == of[q]) == same and ids[i] != ids[q] and low[q] <= points[i] @ queries[q] <= high[q])[:4]
            assert [(-int(s), int(b)) for s, b in zip(score[q], best[q], strict=True) if s != hard_negatives._NONE] == fit


def lloyd(rows, k, rounds, width, scale):
    kept = [(i, [math.floor(scale * c) for c in e]) for i, e in rows if e is not None and len(e) == width and all(c is not None and math.isfinite(c) for c in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[0]))
    centroids = [list(v) for _, v in order[:k]]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in itertools.count():
        own = [min((squared(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn == rounds:
            inertia = {j: sum(d for d, c in own if c == j) for j in range(k)}
            return sorted((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True))
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else centroids[j]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_a_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(c) for c in rng.integers(-3, 4, 4) * (0.5 + (i % 3))]) for i in range(300)] + [(300 + i, e[:4] if e else e) for i, e in enumerate(ODD)] + [(400, [0.0] * 4), (401, [1.0] * 3), (402, [0.1, -0.1, 1e-9, 7.0])]
    rows += [(500, [3e6, -2e5, 1.0, 0.25])] if seed == 3 else []  # beyond 64-bit squares once scaled
    frame = spark.createDataFrame([(i, e, 1, "s") for i, e in rows], ROWS).withColumn("cluster", F.lit("x"))
    first = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    assert sorted(map(tuple, clustering.clusters(frame, first, 8, 4, 4, 1024).collect())) == lloyd(rows, 8, 4, 4, 1024)


def test_clusters_of_few_rows(spark):
    first = F.col("vec_id").cast("string")
    assert clustering.clusters(spark.createDataFrame([], ROWS), first).collect() == []
    rows = [(1, [1.0, 1.0], 1, "s"), (1, [1.0, 1.0], 1, "s"), (None, [5.0, 5.0], 1, "s")]
    got = clustering.clusters(spark.createDataFrame(rows, ROWS), first, 8, 2, 2, 1).collect()
    assert sorted([(r["vec_id"] or -1, r["cluster"], r["distance"]) for r in got]) == [(-1, 2, 0), (1, 0, 0), (1, 0, 0)]


def test_nearest_tells_ties_at_the_edge_of_the_annulus():
    centroids = np.array([[4, 0], [0, 2], [2, 0], [-2, 0], [0, 0]])
    cluster, distance = clustering.nearest(np.array([[3, 0], [0, 0], [0, 1], [-1, 0], [100, 1]]), centroids)
    assert cluster.tolist() == [0, 4, 1, 3, 0] and distance.tolist() == [1, 0, 1, 1, 9217]
