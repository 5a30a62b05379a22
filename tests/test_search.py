"""Search by parts of words, by many terms, by misspelt words and by vectors, against plain versions."""

import random
import re
import tracemalloc
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from gleanery import plans
from gleanery.operators import inverted, normalizing, patterns, retrieval, search, substrings, trust
from gleanery.operators.steps import freed, shared_folder

CHUNKS = "id long, text string, title string, url string, path string, host string, status string, source_type string"


def plain_count(text, term):
    """By one expression a term: white space in a term stands for any, and no character of a word is beside it."""
    escaped = r"\s+".join(re.escape(p) for p in re.split(r"\s+", term.strip().lower()))
    before, after = (r"(?<!\w)" if re.match(r"[\w\W]", escaped) else ""), r"(?!\w)"
    return len(re.findall(before + escaped + after, text.lower()))


TEXT = st.lists(st.sampled_from(["e", "mail", "e-mail", "-", " ", "\n", "kp", "é", "a_b", ".", "é-mail", "Mail"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(TEXT.filter(str.strip), min_size=1, max_size=5, unique=True))
def test_trie_counts_as_one_expression_a_term_does(text, terms):
    found = patterns.Trie(terms).found(text)
    assert {t: n for t, (n, _) in found.items()} == {t: n for t in terms if (n := plain_count(text, t))}


def test_occurrences_in_shares(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The e-mail of E-MAIL"), (2, None), (3, ""), (4, "no such")], "id long, text string")
    terms = spark.createDataFrame([("e-mail",), ("the",), ("the",), (None,), ("",), ("such",), ("mail of",)], "term string")
    wanted = [(1, "e-mail", 2, 2), (1, "mail of", 1, 4), (1, "the", 1, 0), (4, "such", 1, 2)]
    assert sorted(map(tuple, patterns.occurrences(texts, terms).collect())) == wanted
    monkeypatch.setattr(patterns, "TRIE_BYTES", 20)
    assert sorted(map(tuple, patterns.occurrences(texts, terms).collect())) == wanted


def test_entities_come_in_the_order_of_the_gazetteer_then_as_met(spark):
    texts = spark.createDataFrame([(1, "PDF of the sia and LPPM-X, FT; Sia again, then LPPM-X"), (2, "nothing"), (3, None)], "id long, text string")
    names = spark.createDataFrame([(0, "Teknik"), (1, "SIA"), (2, "The SIA")], "place int, term string")
    got = {r["id"]: r["entities"] for r in patterns.entities(texts, names, ["PDF"]).collect()}
    assert got == {1: ["SIA", "The SIA", "LPPM-X", "FT"], 2: [], 3: []}
    assert {r["id"]: r["entities"] for r in patterns.entities(texts, names, ["PDF"], most=1).collect()}[1] == ["SIA"]


def test_substrings_are_all_found(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abA é\n-") for _ in range(r.randrange(30))), r.choice([None, "", "ab", "É a"])) for i in range(120)] + [(200, None, None), (201, "x" * 5000 + "needle", "a")]
    terms = sorted({"".join(r.choice("abé -") for _ in range(r.randrange(1, 6))) for _ in range(60)}) + ["needle", "xxxn", "zzz"]
    frame, asked = spark.createDataFrame(rows, "id long, text string, title string"), spark.createDataFrame([(t,) for t in [*terms, *terms[:3]]] + [(None,), ("",)], "term string")
    index = substrings.gram_index(frame, ["text", "title"])
    wanted = {(t, c, i) for t in terms for i, *of in rows for c, v in zip(("text", "title"), of, strict=True) if v is not None and t.lower() in v.lower()}
    found = substrings.holding(asked, index, frame, ["text", "title"]).collect()
    assert len(found) == len(wanted) and set(map(tuple, found)) == wanted
    some = frame.where("id % 2 = 0")
    assert {tuple(x) for x in substrings.holding(asked, index, some, ["text", "title"]).collect()} == {x for x in wanted if x[2] % 2 == 0}


def test_substrings_are_scanned_without_an_index(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i % 90, "".join(r.choice("abA é\n-") for _ in range(r.randrange(30))), r.choice([None, "", "ab", "É a"])) for i in range(120)] + [(None, "a needle", None)]
    terms = sorted({"".join(r.choice("abAé -") for _ in range(r.randrange(1, 6))) for _ in range(60)}) + ["needle", "NEEDLE", "zzz"]
    frame, asked = spark.createDataFrame(rows, "id long, text string, title string"), spark.createDataFrame([(t,) for t in [*terms, *terms[:3]]] + [(None,), ("",)], "term string")
    wanted = sorted((t, c, str(i)) for t in terms for i, *of in rows for c, v in zip(("text", "title"), of, strict=True) if v is not None and t.lower() in v.lower())
    monkeypatch.setattr(substrings, "written", None)
    for block in (7, 4096):
        monkeypatch.setattr(substrings, "TERM_BLOCK", block)
        monkeypatch.setattr(substrings, "ROW_BLOCK", block)
        assert sorted((t, c, str(i)) for t, c, i in substrings.scanned(asked, frame, ["text", "title"]).collect()) == wanted


def test_substring_search_writes_no_index(spark, monkeypatch):
    monkeypatch.setattr(substrings, "written", None)
    found = plans.queries()["substring_search"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len({(r["query_id"], r["kind"], r["place"]) for r in found}) > 0


def test_tables_are_freed(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    listed = lambda: {str(f.getPath()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}
    before = listed()
    with freed(spark):
        substrings.gram_index(spark.createDataFrame([(1, "abc")], "id long, text string"), ["text"])
        assert listed() > before
    assert listed() == before


def test_keyword_search_counts_each_term_by_one_rule(spark):
    rows = [
        (1, "about e-mail", None, "u", "/p", "h", "indexed", "html"),
        (2, "about e mail", None, "u", "/p", "h", "indexed", "html"),
        (3, "the kp and KP of emails", None, "u", "/p", "h", "indexed", "html"),
        (4, "about e-mail", None, "u", "/p", "h", "failed", "html"),
        (5, "about e-mail", None, "u", "/p", "h", "indexed", "image"),
        (6, "nothing", "e-mail", "u", "/p/kp", "h", "indexed", "html"),
        (7, "about e-mail", None, "u/view/years/7", "/p", "h", "indexed", "html"),
        (8, "pre-e-mail reads e-mails", None, None, None, None, "indexed", "html"),
        (9, None, None, None, None, None, "indexed", "html"),
    ]
    rules = search.SearchRules(expansions={"post": ["e-mail", "kp"]}, listing="/view/years/")
    asked = spark.createDataFrame([(1, "post"), (2, None), (3, "")], "query_id int, text string")
    got = [(r["id"], r["score"]) for r in search.keyword_search(asked, spark.createDataFrame(rows, CHUNKS), rules, 9, types=["html"]).orderBy("rank").collect()]
    assert got == [(6, 6.0), (3, 2.0), (1, 1.0), (8, 1.0)]
    few = search.SearchRules(expansions={"post": ["e-mail", "kp"]}, most_terms=2)
    assert 3 not in [r["id"] for r in search.keyword_search(asked, spark.createDataFrame(rows, CHUNKS), few, 9).collect()]  # kp scores, but finds none


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def plain_normalized(text, v):
    """Word by word, against the whole vocabulary."""
    if text is None or not text.strip():
        return text
    out = []
    for word in re.findall(r"[A-Za-z0-9]+|\S", text.strip().lower()):
        if not word.isalnum() or word in v.fillers:
            continue
        if word in v.slang:
            out.append(v.slang[word])
            continue
        if word in v.keep or word in v.words or word.isdigit():
            out.append(word)
            continue
        near = max(((ratio(w, word), w) for w in v.words), default=(0, "")) if len(word) >= 4 else (0, "")
        if near[0] >= v.least_word and ratio(word, near[1]) >= v.least_word and abs(len(near[1]) - len(word)) <= max(2, int(0.4 * len(near[1]))):
            out.append(near[1])
            continue
        short = max(((ratio(a, word), a) for a in v.acronyms if abs(len(a) - len(word)) <= 2), default=(0, "")) if 2 <= len(word) <= 10 else (0, "")
        out.append(short[1] if short[0] >= v.least_acronym else word)
    plain = " ".join(out)
    words = plain.split(" ")
    if plain and not any(p in plain for p in v.phrases):
        tried = [(ratio(p, " ".join(words[i : i + len(p.split())])), len(p), p) for p in v.phrases for i in range(len(words) - len(p.split()) + 1)]
        best = max(tried, key=lambda x: (x[0], x[1], [-ord(c) for c in x[2]]), default=(0, 0, ""))
        plain += f" {best[2]}" if best[0] >= v.least_phrase else ""
    return plain or text.strip()


VOCABULARY = normalizing.Vocabulary(
    slang={"gmn": "bagaimana", "ti": "teknik informatika", "brp": "berapa"},
    keep=("feb", "sia"),
    fillers=("ya", "dong"),
    words=("dekan", "akreditasi", "biaya", "kuliah", "jadwal", "siapa", "informasi", "sistem", "teknik", "informatika", "wisuda"),
    acronyms=("feb", "ft", "fikom", "fpsi", "sia", "krs"),
    phrases=("sistem informasi", "teknik informatika", "fakultas teknik", "manajemen"),
)


def test_questions_are_normalised_as_word_by_word(spark):
    r = random.Random(8)
    pool = [*VOCABULARY.words, *VOCABULARY.slang, *VOCABULARY.acronyms, *VOCABULARY.fillers, "managemen", "fakultas", "tekniik", "2024", "é", "?", "xyz"]

    def typo(w):
        i = r.randrange(len(w))
        return r.choice([w, w, w[:i] + w[i + 1 :], w[:i] + r.choice("aeiou") + w[i:], w[:i] + w[i:][::-1]])

    texts = [" ".join(typo(r.choice(pool)) for _ in range(r.randrange(1, 7))) for _ in range(150)] + ["akreditsi sistem informasi?", "sipa dekan FEBB ya", "ftt fikoom", "", "  ", None, "ya dong", "sistm infrmasi", "!!!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {x["query_id"]: x["normalized"] for x in normalizing.normalized_queries(rows, VOCABULARY).collect()}
    assert got == {i: plain_normalized(t, VOCABULARY) for i, t in enumerate(texts)}


def test_alike_loses_no_pair(spark):
    r = random.Random(4)
    a, b = ({"".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(150)} for _ in range(2))
    found = normalizing.alike(spark.createDataFrame([(x,) for x in [*a, None, ""]], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), 0.72)
    wanted = {(x, y) for x in a for y in b if 2 * sum(min(x.count(c), y.count(c)) for c in set(x)) >= 0.72 * (len(x) + len(y)) - 1e-9}
    assert {tuple(p) for p in found.collect()} == wanted


def test_hamming_pairs_are_all_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    hashes = [b ^ sum(1 << i for i in r.sample(range(64), r.randrange(20))) for b in base for _ in range(6)] + base[:3]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    first = {}
    for i, h in enumerate(signed):
        first.setdefault(h, i)
    wanted = {(a, b, ((g ^ h) & (2**64 - 1)).bit_count()) for g, a in first.items() for h, b in first.items() if a < b and ((g ^ h) & (2**64 - 1)).bit_count() <= 14}
    frame = spark.createDataFrame(list(enumerate(signed)), "doc_id long, simhash long")
    assert {tuple(x) for x in trust.hamming_pairs(frame, 14).collect()} == wanted and len(wanted) > 30


def test_simhash64_votes(spark):
    import hashlib

    texts = ["the quick brown fox the", "", None, "É été é", "one"]
    wanted = []
    for t in texts:
        words = re.findall(r"\w+", (t or "").lower())
        votes = [sum(1 if int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") >> b & 1 else -1 for w in words) for b in range(64)]
        whole = sum(1 << b for b in range(64) if votes[b] > 0)
        wanted.append(whole - (1 << 64) if whole >> 63 else whole)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["simhash"] for r in trust.simhash64(docs).orderBy("doc_id").collect()] == wanted


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    return np.vstack([centres[i % 12] + 0.7 * rng.standard_normal(16) for i in range(900)])


def frame_of(spark, rows, name="vec_id", extra=""):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v)), i % 3) for i, v in rows], f"{name} long, embedding array<double>, label int")


def test_inverted_file_recalls_most_neighbours_and_all_within_a_threshold(spark, vectors):
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 3), (2003, [float("nan")] * 16)]
    table = frame_of(spark, [*enumerate(vectors), *odd])
    file = inverted.inverted_file(table, inverted.fit_centroids(table, 24))
    asked = frame_of(spark, [(i, vectors[i]) for i in range(0, 900, 9)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 3)], "query_id").drop("label")
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = u[::9] @ u.T
    near[np.arange(100), np.arange(0, 900, 9)] = -2
    best = {(q * 9, int(v)) for q in range(100) for v in np.argsort(-near[q], kind="stable")[:10]}
    for probes, least in ((4, 0.9), (24, 1.0)):
        got = {(r["query_id"], r["vec_id"]) for r in inverted.nearest(asked, file, 10, probes).collect()}
        assert len(got & best) >= least * len(best) and len(got) == 1000
    label = F.col("label") == 1
    got = {(r["query_id"], r["vec_id"]) for r in inverted.within(asked, file, 0.8, label).collect()}
    assert got == {(q * 9, v) for q, v in zip(*map(np.ndarray.tolist, np.nonzero(near >= 0.8)), strict=True) if v % 3 == 1}
    hits = {r["query_id"]: r["vec_id"] for r in inverted.cached(asked, file, 0.9).collect()}
    assert hits == {q * 9: int(np.argmax(near[q])) for q in range(100) if near[q].max() >= 0.9}


def test_inverted_file_of_nothing(spark):
    empty = frame_of(spark, [])
    file = inverted.inverted_file(empty, inverted.fit_centroids(empty, 4))
    assert inverted.nearest(frame_of(spark, [(1, [1.0, 2.0])], "query_id").drop("label"), file, 3, 2).collect() == []


def test_knn_leaves_out_vectors_that_are_none(spark):
    table = frame_of(spark, [(1, [1.0, 0.0]), (2, None), (3, [1.0, float("nan")]), (4, [2.0, 0.1]), (5, [])])
    asked = table.withColumnRenamed("vec_id", "query_id").drop("label")
    assert {(r["query_id"], r["vec_id"]) for r in retrieval.knn(asked, table.drop("label"), 3).collect()} == {(1, 4), (4, 1)}
    with pytest.raises(ValueError, match=r"different dimensions: \[2, 3\]"):
        retrieval.knn(asked, frame_of(spark, [(9, [1.0, 2.0, 3.0])]).drop("label"), 3)


def test_reverify(spark):
    rows = spark.createDataFrame([(0.9, 0.2, 5), (0.9, 0.8, 1), (0.9, 0.8, 2), (0.5, 0.1, 0), (0.7, None, None), (0.7, None, 2)], "v double, f double, c int")
    assert [r[0] for r in rows.select(trust.reverify(F.col("v"), F.col("f"), F.col("c"))).collect()] == [True, True, False, False, True, False]


def test_parts_are_those_that_a_text_holds():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé \n-,") for _ in range(n))
    terms = sorted({word(r.randrange(1, 6)) for _ in range(200)})
    parts = substrings.Parts(terms)
    for text in ["", *[word(r.randrange(60)) for _ in range(300)], "b" * 5000 + "é-a,"]:
        assert parts.found(text) == {t for t in terms if t in text}


def plain_search(asked, rows, k):
    """Scores of chunks without boosts and topics, by one expression a term."""
    out = []
    for q, text in asked:
        terms, best = list(dict.fromkeys(t for t in re.findall(r"[\w-]+", text) if len(t) > 2)), []
        for i, body, title, url, path, host, _, kind in rows:
            meta = " ".join(x for x in (title, url, host, path, kind) if x is not None)
            places = [x.lower() for x in (body, title, url, path) if x is not None]
            if any(t in p for t in terms[:12] for p in places):
                best.append((-float(sum(min(plain_count(body or "", t), 5) + 3 * bool(plain_count(meta, t)) for t in terms)), i))
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(x for x in best if x[0] <= -0.1)[:k], 1)]
    return set(out)


def test_keyword_search_reads_chunks_once_and_writes_no_index(spark, monkeypatch):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "alp", "lph", "e-mail", "mail", "delta", "pha"]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(n)))
    rows = [(i, text(30), r.choice([None, "beta"]), f"u/{text(3)}", "/p", "h", "indexed", "html") for i in range(700)]
    asked = [(q, text(6)) for q in range(40)]
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(substrings, "written", None)
    got = search.keyword_search(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(rows, CHUNKS), search.SearchRules(), 5).collect()
    assert {tuple(x) for x in got} == plain_search(asked, rows, 5) and len(got) > 150
    monkeypatch.undo()
    frame = spark.createDataFrame(rows, CHUNKS)
    with freed(spark):
        again = search.keyword_search(spark.createDataFrame(asked, "query_id int, text string"), frame, search.SearchRules(), 5, grams=search.chunk_grams(frame)).collect()
    assert {tuple(x) for x in again} == {tuple(x) for x in got}


def test_hamming_pairs_hold_two_blocks_at_once(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, r.getrandbits(20)) for i in range(500)] + [(500 + i, i) for i in range(40)] + [(900, 3), (901, None)]
    first = {}
    for i, h in rows[:-1]:
        first.setdefault(h, i)
    wanted = {(a, b, (g ^ h).bit_count()) for g, a in first.items() for h, b in first.items() if a < b and (g ^ h).bit_count() <= 9}
    monkeypatch.setattr(trust, "HASH_BLOCK", 100)
    found = trust.hamming_pairs(spark.createDataFrame(rows, "doc_id long, simhash long"), 9)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_simhash64_holds_the_words_of_one_text():
    words = [f"w{i}" for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(2000), pa.int64()), "words": pa.array([words] * 2000, pa.list_(pa.string()))})
    tracemalloc.start()
    told = list(trust._voted(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(told[0].column("simhash").to_pylist())) == 1 and len(told[0]) == 2000 and peak < 5_000_000


def test_hamming_pairs_take_two_bytes_a_row(spark, tmp_path):
    """All pairs are many rows: told by distance, and by the first of a few documents, two columns repeat themselves."""
    r = random.Random(7)
    hashes = spark.createDataFrame([(i, r.getrandbits(24)) for i in range(5000)], "doc_id long, simhash long")
    trust.hamming_pairs(hashes, 9).write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 1_500_000 and sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 2 * n


def test_hamming_pairs_of_more_blocks_than_tasks(spark, monkeypatch):
    r = random.Random(8)
    rows = [(r.getrandbits(40), r.getrandbits(62) - 2**61) for _ in range(300)]
    bits = lambda g, h: ((g ^ h) & (2**64 - 1)).bit_count()
    monkeypatch.setattr(trust, "HASH_BLOCK", 25)
    monkeypatch.setattr(trust, "HASH_PRODUCTS", 60)
    monkeypatch.setattr(trust, "PAIR_TASKS", 5)
    got = [tuple(x) for x in trust.hamming_pairs(spark.createDataFrame([*rows, (None, 5)], "doc_id long, simhash long"), 24).collect()]
    wanted = {(a, b, bits(g, h)) for a, g in rows for b, h in rows if a < b and bits(g, h) <= 24}
    assert len(got) == len(wanted) > 300 and set(got) == wanted


def most_held(monkeypatch, made):
    """Peak bytes of the task that ``made`` hands to a cogroup, as it meets 1,024 queries and 16,384 vectors."""
    taken, own = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, task, schema: taken.append(task) or own(self, task, schema))
    made()
    of = lambda n: pa.FixedSizeListArray.from_arrays(pa.array(np.random.default_rng(n).normal(size=n * 8)), 8).cast(pa.list_(pa.float64()))
    asked, known = pa.table({"query_id": np.arange(1024), "wanted": of(1024)}), pa.table({"vec_id": np.arange(16384), "known": of(16384)})
    tracemalloc.start()
    told = taken[-1](asked, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, told


def test_knn_holds_the_products_of_a_few_queries(spark, monkeypatch):
    table = frame_of(spark, [(i, [float(i), 1.0, *[0.0] * 6]) for i in range(9)])
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    peak, told = most_held(monkeypatch, lambda: retrieval.knn(asked, table.drop("label"), 10))
    assert peak < 60_000_000 and len(told) == 10240


@pytest.mark.parametrize("of", ["within", "nearest"])
def test_inverted_file_holds_the_products_of_a_few_queries(spark, monkeypatch, of):
    table = frame_of(spark, [(i, [float(i), 1.0, *[0.0] * 6]) for i in range(9)])
    file = inverted.inverted_file(table, inverted.fit_centroids(table, 2))
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    peak, told = most_held(monkeypatch, lambda: inverted.within(asked, file, 0.9) if of == "within" else inverted.nearest(asked, file, 10, 2))
    assert peak < 60_000_000 and len(told) > 1000


def test_a_query_leaves_python_once_whatever_its_lists():
    class Taken:
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, task, _):  # noqa: N802
            raise StopIteration(task)

    file = inverted.InvertedFile(np.eye(8), None, {i: (40, 1.5) for i in range(8)})
    with pytest.raises(StopIteration) as taken:
        inverted._probed(Taken(), file, None, 0.1)
    asked = pa.RecordBatch.from_pydict({"query_id": list(range(500)), "embedding": np.random.default_rng(1).normal(size=(500, 8)).tolist()})
    assert [len(b) for b in taken.value.value(iter([asked]))] == [500]
