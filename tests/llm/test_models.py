"""Language identification, toxicity and language-model scores on made-up languages; chat formatting."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.llm import chat_format, language_id, lm_score, toxicity

SYLLABLES = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["schl", "ung", "ver", "ß"], "cc": ["eau", "oi", "é", "que"]}
ODD = [(5000, None, None), (5001, "", "aa"), (5002, "123 !?", "bb"), (5003, "kamo " * 30000, "aa")]


def documents(n, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60))), lang))
    return rows


def test_language_id(spark):
    rows = documents(400)
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = language_id.is_held_out(F.col("doc_id"), 5, 0)
    model = language_id.train(docs.where(~out), rows=100)
    got = {r["doc_id"]: r for r in language_id.predict(docs.withColumn("h", out), model).collect()}
    held = [x for x in rows if got[x[0]]["h"]]
    assert held and np.mean([got[i]["lang_pred"] == lang for i, _, lang in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (5000, 5001, 5002, 5003)] == ["und", "und", "und", "aa"]
    assert (model.table[:, :-1] == 0).mean() > 0.5  # the penalty leaves most weights zero
    empty = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_language_id_needs_a_letter(spark):
    model = language_id.train(spark.createDataFrame(documents(60), "doc_id long, text string, lang string"), rows=20)
    said = spark.createDataFrame([(1, "² ½ Ⅷ"), (2, "12_3"), (3, "²x"), (3, "²x")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language_id.predict(said, model).orderBy("doc_id").collect()] == [True, True, False, False]


def test_language_id_is_the_same_for_any_order_of_rows(spark):
    rows = documents(120)
    a, b = (language_id.train(spark.createDataFrame(x, "doc_id long, text string, lang string"), rows=30) for x in (rows, rows[::-1]))
    assert (a.table == b.table).all() and a.divisor == b.divisor


def test_ftrl_equals_definition():
    """Follow-the-regularised-leader, one weight at a time: the minimum of the sum of past gradients, of proximal terms
    and of the elastic net is soft-thresholded in closed form."""
    r, classes, how = np.random.default_rng(4), 3, {"alpha": 0.5, "beta": 1.0, "l1": 0.05, "l2": 0.05}
    rows = [(np.sort(r.choice(12, 4, replace=False)), r.random(4), int(r.integers(classes))) for _ in range(30)]
    z, n = {}, {}

    def weight(i, k):
        a = z.get((i, k), 0.0)
        return 0.0 if abs(a) <= how["l1"] else -(a - math.copysign(how["l1"], a)) / ((how["beta"] + math.sqrt(n.get((i, k), 0.0))) / how["alpha"] + how["l2"])

    for _ in range(2):
        for at, x, label in rows:
            w = {(i, k): weight(i, k) for i in at for k in range(classes)}
            e = [math.exp(sum(v * w[i, k] for i, v in zip(at, x, strict=True))) for k in range(classes)]
            for i, v in zip(at, x, strict=True):
                for k in range(classes):
                    g = v * (e[k] / sum(e) - (k == label))
                    step = (math.sqrt(n.get((i, k), 0.0) + g * g) - math.sqrt(n.get((i, k), 0.0))) / how["alpha"]
                    z[i, k] = z.get((i, k), 0.0) + g - step * w[i, k]
                    n[i, k] = n.get((i, k), 0.0) + g * g
    got = language_id.ftrl(rows, classes, 2, **how)
    assert np.allclose(got[:12], [[weight(i, k) for k in range(classes)] for i in range(12)]) and not got[12:].any()


def test_temperature_is_the_likeliest():
    r = np.random.default_rng(5)
    scores = r.normal(size=(400, 3)) * 8
    p = np.exp(scores / 4 - (scores / 4).max(axis=1, keepdims=True))
    labels = np.array([r.choice(3, p=x / x.sum()) for x in p])
    assert 2.5 < language_id.temperature(scores, labels) < 6  # drawn at 4


def test_features_of_parts_equal_whole(monkeypatch):
    text = "Straße éè " * 50
    whole = language_id.counted(text)
    monkeypatch.setattr(language_id, "_PART", 7)
    parts = language_id.counted(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_toxicity(spark):
    r = random.Random(3)
    rows, labels = documents(600, 5), []
    for i, (doc_id, text, lang) in enumerate(rows):
        toxic = i % 5 == 0
        if toxic:
            words = text.split()
            for _ in range(2):
                words.insert(r.randrange(len(words) + 1), r.choice(["grumpf", "Blarg!", "grumpfy", "blargo"]))
            rows[i] = (doc_id, " ".join(words), lang)
        if i % 3 != 1:
            labels.append((doc_id, int(toxic)))
    labels += [(labels[0][0], labels[0][1]), (None, 1), (7, None), (99999, 1)]
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string, lang string").withColumn("toxic", F.lit("clash"))
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x["doc_id"]: x["score"] for x in found.collect()}
    wrong = [x for i, x in enumerate(rows) if (got[x[0]] >= toxicity.THRESHOLD) != (i % 5 == 0)]
    assert len(wrong) <= 12 and all(0 <= s <= 1 for s in got.values())
    assert got[5000] == got[5001] < 0.3 and got[5002] < 0.3
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] for x in none.collect()} == {0.0} or max(x["score"] for x in none.collect()) < 1e-100
    assert toxicity.score(docs.limit(0), toxicity.ToxicityModel([], np.zeros(toxicity.STRONGEST + 3))).count() == 0


def test_toxicity_keeps_the_prior_of_all_labels(spark):
    """Where the text tells nothing, the score is the share of toxic labels, however few rows of each class are drawn."""
    r = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["kamo", "tiru", "moti", "ruka"]) for _ in range(20))) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(3000)], "doc_id long, toxic int")
    for how in ({}, {"toxic_rows": 200, "ordinary_rows": 200}):
        scores = [x["score"] for x in toxicity.score(docs, toxicity.train(docs, labels, **how)).collect()]
        assert abs(np.mean(scores) - 0.1) < 0.06


def test_toxicity_counts_all_grams_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 10, raising=False)
    rows = [(i, f"kamo tiru{chr(97 + i)} moti{chr(97 + i)}{chr(98 + i)}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    learnt = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(toxicity.CALIBRATE)) != 0).collect()
    padded = {f"{toxicity._PAD * (toxicity.ORDER - 1)}{w}{toxicity._END}" for x in learnt for w in x["text"].split()}
    wanted = {w[i : i + toxicity.ORDER] for w in padded for i in range(len(w) - toxicity.ORDER + 1)}
    n, grams, *_ = toxicity.train(docs, labels).levels[-1]
    assert (n, len(grams)) == (toxicity.ORDER, len(wanted)) and len(wanted) > 10


def kneser_ney(grams):
    """p(class, context, character) by the definition, class 1 or 0; a character never met is None."""
    order, shared, d = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT
    counts = {order: {g: (c1, c0) for g, c1, c0 in grams}}
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for g, (c1, c0) in counts[n + 1].items():
            a, b = counts[n].get(g[1:], (0, 0))
            counts[n][g[1:]] = (a + (c1 > 0), b + (c0 > 0)) if n >= shared else (a + 1, b + 1)

    def p(c, context, char):
        if not context:
            k, every = len(counts[1]), sum(v[0] for v in counts[1].values())
            return (max(counts[1].get(char, (0, 0))[0] - d, 0) + d * k / (k + 1)) / every
        n = len(context) + 1
        met = [v[1 - c] for g, v in counts[n].items() if g[:-1] == context]
        own, whole, kinds = counts[n].get(context + (char or "?"), (0, 0))[1 - c], sum(met), sum(v > 0 for v in met)
        return (max(own - d, 0) / whole if whole else 0.0) + (d * kinds / whole if whole else 1.0) * p(c, context[1:], char)

    return p


def test_kneser_ney_equals_definition_and_sums_to_one(spark):
    from gleanery.llm.scratch import Scratch

    r = random.Random(9)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(60)]
    counts = {}
    for w in words:
        padded = f"{toxicity._PAD * (toxicity.ORDER - 1)}{w}{toxicity._END}"
        for i in range(len(padded) - toxicity.ORDER + 1):
            a = counts.setdefault(padded[i : i + toxicity.ORDER], [0, 0])
            a[r.randrange(2)] += 1
    rows = [(g, *c) for g, c in counts.items()]
    p, symbols, seen_contexts = kneser_ney(rows), sorted({g[-1] for g in counts}), 0
    for n, seen, rests in toxicity._probabilities(spark.createDataFrame(rows, "gram string, c1 long, c0 long"), Scratch(spark, "test")):
        for x in seen.collect():
            assert np.allclose([x["p1"], x["p0"]], [p(1, x["gram"][:-1], x["gram"][-1]), p(0, x["gram"][:-1], x["gram"][-1])])
        for x in rests.collect():
            seen_contexts += 1
            for c in (1, 0):
                assert np.isclose(sum(p(c, x["ctx"], s) for s in symbols) + p(c, x["ctx"], None), 1.0)
        assert n <= toxicity.ORDER
    assert seen_contexts > 50


def said_words(text):
    """Words between ASCII white space, A-Z as a-z."""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def lm_by_definition(rows, target):
    """(doc_id, n_words, loss_target, loss_background) of each row, counted and smoothed by the definition."""
    single, pair = [Counter(), Counter()], [Counter(), Counter()]
    for i, text in rows:
        said = said_words(text)
        for c in (0, 1):
            if said and (c or i in target):
                single[c].update([*said, "</s>"])
                pair[c].update(zip(["<s>", *said], [*said, "</s>"], strict=True))
    n, words, out = [s.total() for s in single], len(single[1]), []
    scale = [1, n[0] / n[1]]
    for i, text in rows:
        said, loss = said_words(text), []
        for c in (0, 1):
            alone = lambda w: (single[c][w] * scale[c] + 0.5) / (n[c] * scale[c] + 0.5 * (words + 1))  # noqa: B023, E731
            after = lambda a: single[c]["</s>" if a == "<s>" else a] * scale[c]  # noqa: B023, E731
            p = [(pair[c][a, b] * scale[c] + 200 * alone(b)) / (after(a) + 200) for a, b in zip(["<s>", *said], [*said, "</s>"], strict=True)]
            loss.append(-sum(map(math.log, p)) / len(p) if said else 0.0)
        out.append((i, len(said), *loss))
    return out


@pytest.mark.parametrize("block", [1 << 24, 100])
def test_lm_score_equals_definition(spark, monkeypatch, block):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefg") for _ in range(r.randrange(12)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "a b"), (52, "e f g " * 300)] + [(60, "A b c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "extra": F.lit("y")})
    target = spark.createDataFrame([(1,), (2,), (3,), (60,), (60,), (None,), (999,)], "doc_id long")
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    found = lm_score.cross_entropy_difference(docs, target)
    assert found.columns == ["doc_id", "text", "extra", "n_words", "loss_target", "loss_background", "score"]
    plain = sorted((tuple(x[c] for c in ("doc_id", "n_words", "loss_target", "loss_background")) for x in found.collect()), key=str)
    for x, y in zip(plain, sorted(lm_by_definition(rows, {1, 2, 3, 60}), key=str), strict=True):
        assert x[:2] == y[:2] and np.allclose(x[2:], y[2:])
    assert all(np.isclose(x["score"], x["loss_target"] - x["loss_background"]) for x in found.collect())
    assert lm_score.cross_entropy_difference(docs.limit(0), target).count() == 0
    assert {x["score"] for x in lm_score.cross_entropy_difference(docs, target.limit(0)).collect()} == {0.0}


def test_lm_score_tells_like_from_unlike(spark):
    rows = [(i, " ".join(random.Random(i).choice(["sun moon", "red blue"] if i % 2 else ["tax law", "court fee"]) for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (102, "unseen words only")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in range(1, 20, 2)], "doc_id long"), F.col("doc_id") < 100).collect()}
    assert all(got[i]["score"] < got[j]["score"] for i in range(1, 60, 2) for j in range(0, 60, 2))
    assert got[0]["n_words"] == 60 and np.isfinite(got[102]["score"])
    # a word that was never counted has what each word has beside its count
    counted, words = [10 * 61, 60 * 61], len({w for _, t in rows for w in t.split()}) + 1
    alone = lambda n: 0.5 / (n + 0.5 * (words + 1))
    ends = lambda n, e: (e + 0.5) / (n + 0.5 * (words + 1))
    first = 200 * alone(counted[0]) / (10 + 200)
    last = 200 * ends(counted[0], 10) / 200
    assert np.isclose(got[102]["loss_target"], -(np.log(first) + 2 * np.log(alone(counted[0])) + np.log(last)) / 4)


TEXT = st.lists(st.sampled_from(["\\", "<", "|", ">", "</s>", "[INST]", "[/INST]", "<|end|>", "<<SYS>>", "a", "\n", "é", "𝄞"]), max_size=12).map("".join)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_format_round_trip(turns):
    text = "".join(f"{chat_format.TURN}{chat_format.escape(r)}{chat_format.SAYS}{chat_format.escape(t)}{chat_format.END}" for r, t in turns)
    assert chat_format.read_turns(text) == turns
    assert not any(c in chat_format.escape(t) for _, t in turns for c in ("</s>", "[INST]", "[/INST]", "<|", "<<SYS>>"))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_escaped_column_equals_escape(spark, texts):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", chat_format.escaped(F.col("t")).alias("e")).collect()
    assert [r["e"] for r in sorted(got)] == [chat_format.escape(t) for t in texts]


def test_formatted(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok"), (1, 0, "user", None), (1, None, "system", "𝄞"), (None, 0, None, "x"), (2, 5, "assistant", "a\\b"), (2, 5, "assistant", "a\\b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted(chat_format.canonical_turns(turns))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == (3, sha("system\n𝄞\nuser\n\nassistant\n</s>[INST] ok\n"))
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (13, sha("</s>[INST] ok"))
    assert got[None]["turns_sha256"] == sha("\nx\n") and got[2]["loss_sha256"] == sha("a\\ba\\b")
    assert chat_format.formatted(chat_format.canonical_turns(turns.limit(0))).count() == 0


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], "id": 7},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "", "output": "done"},
        {"prompt": "p", "completion": "c", "meta": {"x": [1]}},
        {"what": 1},
        [1],
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, None), (7, "{")]
    got = chat_format.turns_from_json(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    said = {}
    for r in got:
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert said[0] == [("user", "hi"), ("assistant", "")] and said[1] == [("user", "q"), ("assistant", "a")]
    assert said[2] == [("user", "do"), ("assistant", "done")] and said[3] == [("user", "p"), ("assistant", "c")]
    assert {r["conv_id"] for r in got if r["layout"] == "unknown"} == {4, 5, 6, 7}
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from: string, value: string>>")
    assert [(r["role"], r["text"]) for r in chat_format.canonical_turns(nested).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.canonical_turns(nested.select("conv_id"))
