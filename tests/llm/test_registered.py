"""The registered queries of the subpackage, over whole tables: against their SQL, a library, or a plain version."""

import hashlib
import math
import os
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import language_id, mixing, packing, queries, toxicity

sys.path.insert(0, os.path.dirname(__file__))
from test_documents import brute_groups, generalised  # noqa: E402
from test_models import lm_by_definition  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "embeddings"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


def held_out(doc_id, of, rest):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % of == rest


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame, wanted = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in frame.columns]
    assert sorted(map(tuple, frame.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in wanted.fetchall()), key=str)


MASK = (1 << 64) - 1


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x ^ (x >> 31)


def plain_hash(codes, factors):
    return plain_mix((sum(c * int(f) for c, f in zip(codes, factors, strict=False)) + len(codes)) & MASK)


def plain_grams(text):
    codes = [ord(c) for c in text.lower()]
    return Counter((plain_hash(codes[i : i + n], language_id._FACTOR) >> 48) & (language_id.BUCKETS - 1) for n in (1, 2, 3) for i in range(len(codes) - n + 1))


def test_language_scores_equal_their_definition(spark, docs):
    """Inverse document frequencies of all training texts, and each text's softmax of weights on its TF-IDF n-grams."""
    frame = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language_id.is_held_out(F.col("doc_id"), 5, 0))
    model = language_id.train(frame.where("NOT held_out"))
    taught, df = [t for i, t, lang, _ in docs if lang and t is not None and not held_out(i, 5, 0)], Counter()
    for t in taught:
        df.update(plain_grams(t).keys())
    for b in [*list(df)[:500], 7, 65_535]:
        assert model.table[b, -1] == pytest.approx(math.log((1 + len(taught)) / (1 + df[b])) + 1)
    got = {r["doc_id"]: r for r in language_id.predict(frame, model).collect()}
    for i, text, _, _ in docs[:60]:
        if not any(map(str.isalpha, text or "")):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        counts = plain_grams(text)
        x = {b: n * (math.log((1 + len(taught)) / (1 + df[b])) + 1) for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        scores = [sum(v / norm * model.table[b, k] / model.table[b, -1] for b, v in x.items()) / model.divisor for k in range(len(model.languages))]
        total = sum(math.exp(v - max(scores)) for v in scores)
        best = max(range(len(scores)), key=lambda k: scores[k])
        assert got[i]["lang_pred"] == model.languages[best] and got[i]["score"] == pytest.approx(1 / total, abs=1e-9)


def plain_toxicity(text, model, known):
    """A word's log-ratio, character by character from the longest n-gram that is known; then the features' logistic."""
    words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or "")
    ratios = []
    for w in words:
        codes, total = [ord(c) for c in toxicity._PAD * (toxicity.ORDER - 1) + w.lower() + toxicity._END], 0.0
        for end in range(toxicity.ORDER, len(codes) + 1):
            r = 0.0
            for n, grams, rests in known:
                own = codes[end - n : end]
                key = plain_hash(own, toxicity._FACTOR)
                r = grams[key] if key in grams else r + rests.get(plain_hash(own[:-1], toxicity._FACTOR), 0.0)
            total += r
        ratios.append((total, len(w) + 1))
    x = sorted((t / n for t, n in ratios), reverse=True)[: toxicity.STRONGEST]
    x += [0.0] * (toxicity.STRONGEST - len(x))
    x += [sum(t for t, _ in ratios) / sum(n for _, n in ratios), math.log1p(len(words))] if words else [0.0, 0.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip([*x, 1.0], model.weights, strict=True))))


def toxicity_by_definition(spark, rows, labels):
    """{doc_id: score} of rows (doc_id, text), from the model's tables."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(frame.where(~toxicity.is_held_out(F.col("doc_id"), 4, 2)), labels)
    known = [(n, dict(zip(grams.tolist(), ratios.tolist(), strict=True)), dict(zip(contexts.tolist(), rests.tolist(), strict=True))) for n, grams, ratios, contexts, rests in model.levels]
    return {i: plain_toxicity(t, model, known) for i, t in rows}


def test_toxicity_scores_equal_their_definition(spark, docs):
    some = [(i, t) for i, t, _, _ in docs] + [(10_001, None), (10_002, ""), (10_003, "ÉTÉ you Fool-fool")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wanted = toxicity_by_definition(spark, some, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark.createDataFrame(some, "doc_id long, text string"), labels).collect()}
    assert {i: pytest.approx(v, abs=1e-6) for i, v in wanted.items()} == got


def test_language_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, SF).collect()}
    assert len(got) == len(docs) and all(r["held_out"] == held_out(i, 5, 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    judged = [(lang, got[i]["lang_pred"]) for i, text, lang, _ in docs if lang and held_out(i, 5, 0) and any(map(str.isalpha, text or ""))]
    assert np.mean([a == b for a, b in judged]) > 0.85


def test_toxicity_query(spark, duck, docs):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SF).collect()}
    assert len(got) == len(docs) and all(r["held_out"] == held_out(i, 4, 2) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    labels = {i: t for i, t in duck.sql("SELECT doc_id, max(toxic) FROM labels WHERE toxic IS NOT NULL GROUP BY 1").fetchall() if held_out(i, 4, 2) and i in got}
    assert np.mean([got[i]["predicted"] == t for i, t in labels.items()]) > 0.8


def test_lm_query(spark, duck, docs):
    target = {i for (i,) in duck.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    got = {r["doc_id"]: r for r in queries.op5_lm_score(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, n, a, b in lm_by_definition([(i, t) for i, t, _, _ in docs], target):
        assert got[i]["n_words"] == n and np.allclose([got[i]["loss_target"], got[i]["loss_background"]], [a, b])


def test_fingerprint_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op6_fingerprint(spark, SF).collect()}
    order, errors = sorted(docs, key=lambda d: -d[0]), []
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert (got[doc_id]["n_chars"], got[doc_id]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(got[doc_id]["near_edited"] - generalised(text, edited))
    assert abs(np.mean(errors)) < 0.03


def test_token_query(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    wanted = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in docs}
    for r in queries.op7_token_count(spark, SF).collect():
        assert (r["n_bytes"], r["n_tokens"]) == wanted[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 2048)


def test_pack_query(spark, docs):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(packing.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = {}
    for r in packing.unpacked(queries.op9_pack(spark, SF)).collect():
        parts.setdefault(r["doc_id"], {})[r["part"]] = r["ids"]
    joined = {i: [x for p in sorted(own) for x in own[p]] for i, own in parts.items()}
    assert joined == {i: [*library.encode_ordinary(t), packing.END] for i, t, _, _ in docs if t}


def drawn_by_definition(spark, rows):
    """{doc_id: times} of rows (doc_id, text, source): weights by a power of the sources' shares that brings their
    entropy half-way to the uniform one, whole epochs of every document, and of the next one those first in its
    permutation that still fit."""
    size, total = {i: len((t or "").split()) for i, t, _ in rows}, Counter()
    for i, _, s in rows:
        total[s] += size[i]
    total = {s: n for s, n in total.items() if n}
    share = {s: n / sum(total.values()) for s, n in total.items()}
    entropy = lambda w: -sum(p * math.log(p) for p in w.values())
    power = lambda a: {s: p**a / sum(q**a for q in share.values()) for s, p in share.items()}
    wanted = (entropy(share) + math.log(len(share))) / 2
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        w = power(a)
        fits = entropy(w) <= wanted and all(w[s] * sum(total.values()) <= 4.0 * total[s] for s in w)
        low, high = (low, a) if fits else (a, high)
    weight, out = power(high), Counter()
    key = F.xxhash64("doc_id", "text")
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for s, n in total.items():
        drawn = math.floor(weight[s] * sum(total.values()) + 1e-9)
        whole, left, own = drawn // n, drawn % n, [i for i, _, t in rows if t == s]
        for i in own:
            out[i] += whole
        at = {r["doc_id"]: r["p"] for r in frame.select("doc_id", mixing.place(key, F.lit(whole), 0).alias("p")).collect()}
        for i in sorted(own, key=at.get):
            left -= size[i]
            if left < 0:
                break
            out[i] += 1
    return +out


def test_mixing_query(spark, docs):
    rows = queries.op10_mix_sources(spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == drawn_by_definition(spark, [(i, t, s) for i, t, _, s in docs])


def test_pipeline_stages(spark, duck):
    """Each stage against a plain version of it on what the stage before has kept."""
    before = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-duplicates", "decontamination", "mixing", "packing"]
    clean = stages["toxicity"](spark, before, SF).cache()
    scored = toxicity_by_definition(spark, [tuple(r) for r in before.select("doc_id", "text").collect()], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [r for r in clean.collect()]
    assert clean.columns == before.columns and {r["doc_id"] for r in kept} == {i for i, s in scored.items() if s < toxicity.THRESHOLD}
    single = stages["near-duplicates"](spark, clean, SF).cache()
    assert {r["doc_id"] for r in single.collect()} == {g[0] for g in brute_groups([(r["doc_id"], r["text"]) for r in kept]) if g[3]}
    pure = stages["decontamination"](spark, single, SF).cache()
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    connection.register("documents", single.select("doc_id", "text").toPandas())
    assert {r["doc_id"] for r in pure.collect()} == {i for (i,) in connection.sql(f"SELECT doc_id FROM ({queries.OP1_SQL}) WHERE NOT contaminated").fetchall()}
    mixed = stages["mixing"](spark, pure, SF).cache()
    assert mixed.columns == before.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == drawn_by_definition(spark, [tuple(r) for r in pure.select("doc_id", "text", "source").collect()])
    packed = packing.unpacked(stages["packing"](spark, mixed, SF)).where("part = 0").collect()
    assert Counter(r["doc_id"] for r in packed) == Counter(r["doc_id"] for r in mixed.where("text <> ''").collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
