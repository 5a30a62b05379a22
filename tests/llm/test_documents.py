"""Decontamination, near-duplicates, fingerprints and mixing against brute force, on small texts with every odd case."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, fingerprint, mixing, near_duplicates
from gleanery.llm.components import components

DOCS = "doc_id long, text string, source string"
VOCABULARY = ["alpha", "Beta", "gamma", "delta", "é", "ÉTÉ", "zeta", "x1", "the", "of"]


def corpus(n=60, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(VOCABULARY) + (str(r.randrange(40)) if r.random() < 0.7 else "") for _ in range(r.randrange(60))]
        if rows and r.random() < 0.5:
            words = (r.choice(rows)[1] or "").split()
            for _ in range(r.randrange(4)):
                if words:
                    words[r.randrange(len(words))] = r.choice(VOCABULARY)
        rows.append((i, r.choice([" ", "\n", "  "]).join(words), f"s{r.randrange(3)}"))
    return rows + [(n, None, None), (n + 1, "", "s0"), (n + 2, " \n ", "s0"), (n + 3, "one", "s1"), (n + 4, "one", "s1"), (n + 5, "a b c d", "s1"), (n + 6, "long word " * 3000, "s2")]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def window_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def brute_contamination(docs, items, width):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = window_words(text), set(), set()
        for item_id, item in items:
            v = window_words(item)
            for s in range(max(1, len(v) - width + 1)) if v else ():
                g = v[s : s + width]
                for at in range(len(w) - len(g) + 1):
                    if w[at : at + len(g)] == g:
                        hit |= set(range(at, at + len(g)))
                        found.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination(spark):
    docs = corpus()
    r = random.Random(4)
    items = [(i, " ".join(window_words(docs[i * 3][1])[: r.randrange(3, 30)]).upper()) for i in range(15)] + [(50, None), (51, ""), (52, "ONE"), (52, "one"), (None, "b c"), (53, "not in any of the documents at all")]
    own = docs + [docs[3], (None, docs[3][1], None)]
    d = spark.createDataFrame(own, DOCS).withColumns({"key": F.lit(1), "w": F.lit("x"), "spans": F.lit(0), "term": F.lit(2)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    for width, lists in ((5, 2), (13, 1), (3, 3)):
        got = decontaminate.contamination(d, b, width=width, lists=lists).collect()
        assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], list(x["items"]), x["contaminated"]) for x in got), key=str) == brute_contamination(own, items, width)
    clean = decontaminate.drop_contaminated(d, b, width=5)
    assert clean.columns == d.columns
    assert clean.count() == sum(not x[-1] for x in brute_contamination(own, items, 5))


def test_contamination_of_empty_tables(spark):
    d, b = spark.createDataFrame(corpus(5), DOCS), spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(d, b.limit(0)).collect())


def test_spans_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text)] * 5 + [(2, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(text.split()[3:16]))], "item_id long, text string")
    found = decontaminate.contamination(docs, items).collect()
    assert len(found) == 6 and all([s["start"] for s in r["spans"]] == [3] and r["n_hit"] == 13 for r in found)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red x blue y green"), (2, "green red blue"), (3, "red a b c d e blue green"), (4, "red red blue")], "doc_id long, text string")
    windows = decontaminate.test_windows(spark.createDataFrame([(1, "red blue green")], "item_id long, text string"), 13)
    index = decontaminate.build_index(d, windows.select(F.explode("window").alias("term")))
    keys = {r["key"]: r["doc_id"] for r in d.select("doc_id", decontaminate.document_key(F.col("doc_id"), F.col("text")).alias("key")).collect()}
    assert {keys[r["key"]] for r in decontaminate.near_matches(index, windows, 4).collect()} == {1, 2}
    assert {keys[r["key"]] for r in decontaminate.near_matches(index, windows, 8).collect()} == {1, 2, 3}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(docs):
    sets, parent = {d[0]: shingle_set(d[1]) for d in docs}, {d[0]: d[0] for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


def test_near_duplicates(spark):
    docs = corpus(150, 3)
    d = spark.createDataFrame(docs, DOCS).withColumns({"a": F.lit(1), "component": F.lit(2), "signature": F.lit(3)})
    assert sorted(map(tuple, near_duplicates.near_duplicates(d).collect())) == brute_groups(docs)
    left = near_duplicates.drop_near_duplicates(d)
    assert left.columns == d.columns
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == [x[0] for x in brute_groups(docs) if x[3]]


def test_near_duplicates_of_odd_tables(spark):
    d = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "A B C D E F")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True)], key=str)
    assert near_duplicates.near_duplicates(d.limit(0)).count() == 0


def test_drop_near_duplicates_of_odd_tables(spark):
    rows = [(1, "a b c d e f", "x"), (1, None, "y"), (1, "z y x w v u", "z"), (2, "q w e r t y", "x"), (3, None, "n"), (3, None, "n"), (4, "Z Y X W V U", "x"), (None, "a b c d e f", "x"), (None, "k l m n o p", "y"), (None, None, "z")]
    left = near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert left.columns == ["doc_id", "text", "source"]
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[2], rows[3], rows[4], *rows[7:]], key=str)


def test_large_group_of_near_copies(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(400):
        words = list(base)
        for _ in range(r.randrange(1, 5)):
            words[r.randrange(200)] = f"e{r.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    assert sorted(map(tuple, near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == brute_groups(docs)


def test_borderline_members_of_a_crowd(spark):
    """Each of some documents is linked with one of 1000 near copies only, which the orders don't put beside it."""
    r = random.Random(11)

    def edited(words, places):
        words = list(words)
        for p in places:
            words[p] = f"e{r.randrange(10**9)}"
        return words

    base = [f"w{i}" for i in range(304)]
    copies = [edited(base, r.sample(range(5, 150, 6), 4)) for _ in range(1000)]
    border = [edited(copies[37 * i], r.sample(range(160, 300, 6), 8)) for i in range(20)]
    docs = [(i, " ".join(w)) for i, w in enumerate(copies + border)]
    wanted = brute_groups(docs)
    assert sum(x[3] for x in wanted) == 1
    assert sorted(map(tuple, near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == wanted


def of_one_template(n, planted, seed=1):
    """n texts that share 200 of 238 shingles, strangers by .725, and near copies of some, which share 204 and more."""
    r, head = random.Random(seed), [f"w{i}" for i in range(204)]
    fresh = lambda k: [f"x{r.getrandbits(40):x}" for _ in range(k)]
    rows = [(i, " ".join(head + fresh(38))) for i in range(n)]
    for k in range(planted):
        more = 4 + k % 9  # similarity .75 to .806
        rows.append((n + k, " ".join(rows[k * (n // planted)][1].split()[: 204 + more] + fresh(38 - more))))
    return rows


@pytest.mark.parametrize(("n", "planted"), [(5000, 200)])
def test_no_link_is_lost_among_strangers_just_below_the_threshold(spark, n, planted):
    rows = of_one_template(n, planted)
    sets = {i: shingle_set(t) for i, t in rows}
    pairs = [(k * (n // planted), n + k) for k in range(planted)]
    likeness = [100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs]
    assert min(likeness) == 75 and max(likeness) < 81
    r = random.Random(2)
    assert all(100 * len(sets[a] & sets[b]) < 75 * len(sets[a] | sets[b]) for a, b in (r.sample(range(n), 2) for _ in range(3000)))
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i for i in range(n)} | {b: a for a, b in pairs}


def test_first_shingles_of_linked_sets_meet():
    """What _shares() takes of either set, in any one order, has one in common, if the sets meet the share."""
    r = random.Random(3)
    for _ in range(3000):
        share, every = r.choice([60, 75, 90]), list(range(60))
        a = set(r.sample(every, r.randrange(1, 50)))
        b = set(r.sample(sorted(a), r.randrange(len(a) // 2, len(a) + 1))) | set(r.sample(every, r.randrange(6)))
        if not b or 100 * len(a & b) < share * len(a | b):
            continue
        small, large = sorted((a, b), key=len)
        few, some = sorted(small)[: near_duplicates._shares(len(small), share)[1]], sorted(large)[: near_duplicates._shares(len(large), share)[0]]
        assert set(few) & set(some)


def test_neighbours_over_partition_boundaries(spark):
    """Two documents that stand beside each other in an order meet though they are in different partitions."""
    docs = [(i, f"a{i // 2} b c d e f g h i j k l m n o{i // 2} p{i % 2}") for i in range(8)]
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert sorted(map(tuple, near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == brute_groups(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    wanted = sorted((n, root(n)) for n in {x for a, b in links if a != b for x in (a, b)})
    assert sorted(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def generalised(a, b):
    a, b = Counter((a or "").split()), Counter((b or "").split())
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints(spark):
    docs = corpus(40, 5)
    d = spark.createDataFrame(docs, DOCS).withColumns({"h": F.lit(1), "w": F.lit(2), "side": F.lit(3), "place": F.lit(4)})
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(d).collect()}
    order, errors = sorted(docs, key=lambda x: -x[0]), []
    prints = {}
    for i, (doc_id, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"] == r["edited_fingerprint"]) >= (text == edited) and 0 <= r["near_next"] <= 1
        errors += [r["near_edited"] - generalised(text, edited), r["near_next"] - generalised(text, after)]
        prints.setdefault(text, set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.35


def test_fingerprints_of_odd_tables(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "z")], "doc_id long, text string")
    assert [r["near_edited"] <= 1 for r in fingerprint.fingerprints(d, 8).collect()] == [True] * 3
    alone = fingerprint.fingerprints(d.limit(1), 8).first()
    assert alone["near_next"] == 1.0
    assert fingerprint.fingerprints(d.limit(0), 8).count() == 0


def test_mixture(spark):
    r = random.Random(9)
    docs = [(i, " ".join(["w"] * r.randrange(1, 40)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)] + [(900, None, "hot"), (901, "", None), (902, "a b", None), (903, "", "void")]
    d = spark.createDataFrame(docs, DOCS).withColumns({"mix_block": F.lit("clash"), "at": F.lit(1), "whole": F.lit(2)})
    drawn = mixing.mixture(d, repetition=3.0)
    assert drawn.columns == [c for c in d.columns if c != "mix_block"] + ["mix_epoch", "mix_block", "mix_position", "mix_weight"]
    rows, size = drawn.collect(), {x[0]: len((x[1] or "").split()) for x in docs}
    tokens = Counter()
    for x in docs:
        tokens[x[2]] += size[x[0]]
    total, got = sum(tokens.values()), Counter()
    for x in rows:
        got[x["source"]] += size[x["doc_id"]]
    weight = {x["source"]: x["mix_weight"] for x in rows}
    assert sum(weight.values()) == pytest.approx(1) and "void" not in weight
    natural = -sum(t / total * math.log(t / total) for t in tokens.values() if t)
    target = (natural + math.log(len(weight))) / 2
    entropy = -sum(w * math.log(w) for w in weight.values())
    repeats = max(weight[s] * total / tokens[s] for s in weight)
    assert entropy <= target + 1e-6 and repeats <= 3 + 1e-6 and (abs(entropy - target) < 1e-4 or abs(repeats - 3) < 1e-4)
    for s, w in weight.items():
        largest = max(size[x[0]] for x in docs if x[2] == s)
        assert w * total - largest - 1 <= got[s] <= w * total
        copies = Counter(x["doc_id"] for x in rows if x["source"] == s)
        assert max(copies.values()) - min([copies.get(x[0], 0) for x in docs if x[2] == s]) <= 1
    assert all(0 <= x["mix_position"] <= 1.1 for x in rows)
    assert sorted(map(tuple, mixing.mixture(d, repetition=3.0).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.in_mixed_order(drawn).columns == [c for c in d.columns if c != "mix_block"]
    assert mixing.mixture(d.limit(0)).count() == 0
    with pytest.raises(ValueError, match="repetitions"):
        mixing.mixture(d, budget=4 * total, repetition=3.0)


def test_tables_between_steps_are_freed(spark):
    from gleanery.llm.scratch import freed, shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with freed(spark):
        found = near_duplicates.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
        assert set(os.listdir(folder)) > before
    assert len(found) == 2 and set(os.listdir(folder)) == before
