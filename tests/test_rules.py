"""Ordered rules, follow-ups, reranking, metrics of retrieval, frames of pages, against plain versions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import intents, mining, text, urls
from gleanery.operators import audits, conversation, entities, ingest, layers, retrieval, search, stores

R = intents.Rule
RULES = (R("fee", any_of=("biaya", "uang kuliah"), none_of=("gratis",), confidence=0.9), R("kip", any_of=("kip-k",), priority=4), R("hello", equal=("Hi  there",), confidence=0.8), R("short", most_words=1), R("map", url=("/MAP",), no_url=("old",)))


def test_the_first_rule_that_holds_decides(spark):
    rows = [("Biaya kuliah?", None), ("biaya gratis semester", None), ("berapa uang  kuliah", None), ("beasiswa KIP-K itu", "x"), ("hi there!", None), ("biayanya", None), ("a b c", "http://h/Map/1"), ("a b c", "http://h/map/old"), (None, None), ("", None)]
    frame = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "i int, t string, u string, name string")
    got = intents.classified(frame, "t", RULES, R("none", confidence=0.1), url="u").orderBy("i").collect()
    assert [(r["name"], r["confidence"], r["priority"]) for r in got] == [("fee", 0.9, 0), ("none", 0.1, 0), ("fee", 0.9, 0), ("kip", 1.0, 4), ("hello", 0.8, 0), ("short", 1.0, 0), ("map", 1.0, 0), ("none", 0.1, 0), ("short", 1.0, 0), ("short", 1.0, 0)]
    assert intents.classified(frame, "t", RULES, R("none"), url="u", prefix="of_").columns == ["i", "t", "u", "name", "of_name", "of_confidence", "of_priority"]


def test_followups_by_the_whole_ladder(spark):
    turns = [("", "fee"), ("how much does it cost", "fee"), ("and where is it then, in all of the town", "campus"), ("what of that one", "general"), ("this fee then", "fee"), ("how much", "general"), ("one two three four five six", "general"), ("where is it", "campus"), ("tell me more of it now", "campus")]
    frame = spark.createDataFrame([(1, i, "user", t, k) for i, (t, k) in enumerate(turns)] + [(1, 99, "assistant", "x", "fee")], "conv_id int, turn int, role string, text string, intent string")
    got = conversation.followup_decisions(frame, ["campus"], ["that one"], ["this", "it"]).orderBy("turn").collect()
    assert [(r["turn"], r["confidence"], r["followup"], r["intent_changed"]) for r in got] == [(1, 0.0, False, False), (2, 0.1, False, True), (3, 0.9, True, False), (4, 0.3, False, False), (5, 0.78, True, False), (6, 0.3, False, False), (7, 0.1, False, False), (8, 0.3, False, False)]


def test_a_model_reranks_where_it_has_told_all(spark):
    rows = [(1, 1, 0.9, "html", 0.9, 0.9, 1.0), (1, 2, 0.8, "audio", 0.6, 0.9, None), (1, 3, 0.1, "x", None, 0.25, 1.0), (2, 1, 0.5, "x", None, 0.5, 1.0), (2, 2, 0.4, "x", None, 0.5, 1.0)]
    contexts = spark.createDataFrame(rows, "query_id int, id int, score double, source_type string, confidence double, authority double, freshness double")
    plain = {(r["query_id"], r["rank"]): (r["id"], r["relevance"], r["score"]) for r in retrieval.reranked(contexts).collect()}
    assert plain[1, 1] == (1, 1.23, 2.63) and plain[1, 2] == (2, 0.82, 2.22) and plain[1, 3] == (3, 0.1, 0.85)
    model = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (2, 1, 0.9)], "query_id int, id int, model double")
    got = {(r["query_id"], r["rank"]): (r["id"], r["reranked"]) for r in retrieval.reranked(contexts, model, top=2).collect()}
    assert got == {(1, 1): (2, True), (1, 2): (1, True), (1, 3): (3, False), (2, 1): (1, False), (2, 2): (2, False)}


def test_sufficiency(spark):
    rows = [(1, 1, 13.0, "faq", None, 0.2), (2, 1, 5.0, "entity", False, 0.2), (3, 1, 13.0, "faq", True, 0.9), (3, 2, 1.0, "x", None, 0.9), (4, 1, 1.0, "x", None, 0.6), (5, 1, 1.0, "x", None, 0.1), (5, 2, 1.0, "x", None, 0.6), (6, 1, 1.0, None, None, 0.1)]
    frame = spark.createDataFrame(rows, "query_id int, rank int, score double, source_type string, demoted boolean, authority double")
    got = {r["query_id"]: (r["confidence"], r["sufficient"]) for r in retrieval.sufficiency(frame, ["faq", "entity"]).collect()}
    assert got == {1: (0.95, True), 2: (0.85, True), 3: (0.7, True), 4: (0.55, False), 5: (0.4, False), 6: (0.2, False)}


def test_metrics_of_retrieval(spark):
    rows = [(True, True, 1, False, False, 10), (True, True, 3, True, None, 30), (False, True, None, None, True, 20), (False, False, None, None, False, 40), (True, False, 2, False, True, 50)]
    frame = spark.createDataFrame(rows, "found boolean, labelled boolean, target int, noisy boolean, not_expected boolean, ms int")
    got = audits.retrieval_metrics(frame).first().asDict()
    assert got == {"n": 5, "labelled": 3, "hit_rate": 0.6667, "target_rate": 0.6667, "hit_1": 0.3333, "hit_3": 0.6667, "mrr": pytest.approx(4 / 9, abs=1e-6), "noisy_1": 0.3333, "not_found": 0.4, "median_ms": 30.0, "p95_ms": 50.0, "answered_right": 1, "answered_wrong": 1, "refused_right": 1, "refused_wrong": 1}
    assert audits.retrieval_metrics(frame.limit(0)).first()["hit_rate"] == 0.0


def test_top_questions_of_a_window(spark):
    rows = [("user", "What is the fee?", "2024-01-20"), ("user", " what  IS the fee? ", "2024-01-10"), ("user", "Where is the campus", "2024-01-30"), ("user", "short", "2024-01-30"), ("assistant", "What is the fee now", "2024-01-30"), ("user", "An old question it is", "2023-12-01"), ("user", None, "2024-01-30")]
    got = audits.top_questions(spark.createDataFrame(rows, "role string, text string, at string"), "2024-02-01 00:00:00", ["Where is the CAMPUS", "Who is it", "who is it", "More"], k=4)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(1, "what  IS the fee?", 2), (2, "Where is the campus", 1), (3, "Who is it", 0), (4, "More", 0)]


def plain_chrome(own, chrome, prefixes, calls, most=90):
    """Line by line."""
    kept, last = [], None
    for line in own.replace("\r\n", "\n").split("\n"):
        line = re.sub(r"[ \t]+", " ", line).strip(" ")
        bare = " ".join(re.sub(r"[*_`#>\[\](){}|]", " ", line.lower()).split()).strip(" :-")
        if line == "":
            if kept and kept[-1] != "":
                kept.append("")
            continue
        called = any(re.search(rf"(^|\W){re.escape(c)}(\W|$)", bare) for c in calls) and len(bare) < most
        if bare in chrome or any(bare.startswith(p) for p in prefixes) or called or bare == last:
            continue
        kept.append(line)
        last = bare
    return "\n".join(kept).strip()


LINES = st.lists(st.sampled_from(["Skip to content", "**Skip  to content**", "# Back to top:", "Register now!", "x " * 60 + "register now", "select language: en", "a", "A ", "", "  ", "> b | c", "b c", "- d -", "registering nowhere"]), max_size=9)


@settings(max_examples=40, deadline=None)
@given(LINES)
def test_frames_of_pages_go_as_line_by_line(spark, lines):
    own, lists = "\n".join(lines), (["skip to content", "back to top"], ["select language"], ["register now"])
    assert spark.range(1).select(text.without_chrome(F.lit(own), *lists)).first()[0] == plain_chrome(own, *lists)


def test_json_that_is_cut_off(spark):
    cases = {'{"answer": "a\\u00e9\\t\\/\\"b': 'aé\t/"b', '```json\n{"n": 1, "answer": "x\\\\"}\n```': "x\\", '{"answer": "x\\u00': "x", '{"answer": "x\\\\u00': "x\\u00", '{"other": "x"}': "", '{"answer" : "two\nlines\\': "two\nlines", '{"answer": "\\ud83d\\ude00!"': "😀!"}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(text.salvaged(F.col("t"), "answer")).collect()] == list(cases.values())


def test_urls_that_are_not_verified_go(spark):
    verified = ["https://a.example/x"]
    cases = {"see [A](https://a.example/x) and [B](https://b.example/y).": "see [A](https://a.example/x) and B.", "at https://b.example/y, or (https://b.example/z) then": "at or then", "https://a.example/x. ok": "https://a.example/x. ok", "no link": "no link", "two https://b.example/a https://b.example/ab end": "two end"}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    known = F.array(*[F.lit(v) for v in verified])
    assert [r[0] for r in rows.orderBy("i").select(urls.scrubbed(F.col("t"), known)).collect()] == list(cases.values())


def test_batches_by_a_hash(spark):
    rows = spark.range(95).select(F.col("id"), F.lit("x").alias("text"))
    sizes = [r["count"] for r in stores.batched(rows, 10, "id").groupBy("batch").count().collect()]
    assert sum(sizes) == 95 and len(sizes) == 10 and stores.batched(rows.limit(0), 10, "id").count() == 0


def test_fields_are_mined(spark):
    patterns = {"dean": mining.name_pattern(["dekan", "dean"]), "grade": mining.grade_pattern(["akreditasi", "terakreditasi"], ["A", "B", "Unggul", "Baik Sekali"]), "email": mining.email_pattern(["campus.example"]), "address": mining.address_pattern(["Jl.", "Jalan"], ["No.", "Nomor"])}
    cases = [
        ("Dekan Fakultas Teknik: Prof. Dr. Budi Santoso dan", ["Prof. Dr. Budi Santoso"], [], [], [], []),
        ("dekan adalah Anna Maria Li\nDean - Anna Maria Li", ["Anna Maria Li"], [], [], [], []),
        ("Terakreditasi Unggul; akreditasi: B, akreditasi Biasa", [], ["Unggul", "B"], [], [], []),
        ("tulis a.b@campus.example atau x@other.example", [], [], ["a.b@campus.example"], [], []),
        ("di Jl. Melati Selatan No. 1 Jakarta, Indonesia", [], [], [], ["Jl. Melati Selatan No. 1 Jakarta"], []),
        ("Telp (021) 584-0816, +62 812 3456 7890 atau 12", [], [], [], [], ["0215840816", "+6281234567890"]),
        (None, [], [], [], [], []),
    ]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = mining.mined(frame, "t", patterns, r"^(\+62|62|0)[1-9][0-9]{6,13}$").orderBy("i").collect()
    assert [(r["t"], r["dean"], r["grade"], r["email"], r["address"], r["phones"]) for r in got] == cases


def test_small_operators(spark):
    rows = spark.createDataFrame([(1, None, {"title": "m", "host": "h"}), (2, "own", {"title": "m"})], "id int, title string, meta map<string,string>")
    assert [tuple(r) for r in search.projected(rows, ["title", "host"]).select("id", "title", "host").orderBy("id").collect()] == [(1, "m", "h"), (2, "own", None)]
    one = spark.range(1).select(search.question_allowed(F.lit(None).cast("string")), search.question_allowed(F.lit("x" * 401)), search.client_key(F.lit(""), F.lit("s")), search.client_key(F.lit(None).cast("string"), F.lit(None).cast("string")), search.answers(F.lit("call us"), ["dial", "call us"], "[0-9]{4,}"), search.answers(F.lit(None).cast("string"), ["dial"], "x"))
    assert tuple(one.first()) == (False, False, "s", "anonymous", True, False)
    listed = spark.createDataFrame([(1, '[{"a": 1}, {"a": 2}]'), (2, "torn"), (3, None), (4, "[]")], "k int, j string")
    assert sorted(map(tuple, stores.fanned_out(listed, "j", "array<struct<a: int>>", ["k"]).where("a IS NOT NULL").collect())) == [(1, 1), (1, 2)]
    aliases = spark.createDataFrame([(1, ["A b", " c ", None, ""])], "id int, aliases array<string>")
    assert sorted(map(tuple, entities.alias_table(aliases).collect())) == [("a b", 1, True), ("c", 1, False)]
    a, b = (spark.createDataFrame(x, "k int, ms int") for x in ([(1, 5), (2, 6)], [(1, 9), (3, 1)]))
    assert [tuple(r) for r in audits.deltas(a, b, "k", "ms").collect()] == [(1, 5, 9, 4)]


def test_layers_are_gated_demoted_moved_and_pinned(spark):
    schema = "query_id int, id string, score double, label string, authority double, fits boolean"
    faq = spark.createDataFrame([(1, "f", 14.0, "x", 0.9, None)], schema)
    entity = spark.createDataFrame([(1, "e", 10.0, "x", 0.2, False), (2, "e", 10.0, "x", 0.2, True), (2, "e2", 7.0, "x", 0.2, None), (3, "e", 10.0, "x", 0.2, True)], schema)
    index = spark.createDataFrame([(1, "f", 99.0, "x", 0.9, None), (1, "a", 3.0, "good", 0.9, None), (1, "b", 5.0, "bad", 0.9, None), (3, "c", 1.0, "good", 0.9, None), (4, "d", 1.0, None, 0.1, None)], schema)
    web = spark.createDataFrame([(q, f"w{q}", 2.0, "x", 0.3, None) for q in (1, 2, 3, 4, 5)], schema)
    hosts = spark.createDataFrame([("fee", "good", True), ("fee", "bad", False)], "intent string, label string, allowed boolean")
    questions = spark.createDataFrame([(1, "fee"), (2, "fee"), (3, "other"), (4, "fee"), (5, "fee"), (6, "fee")], "query_id int, intent string")
    made = [layers.Layer("faq", faq, pinned=True, structured=True), layers.Layer("entity", entity, pinned=True, structured=True, intents=("fee",), most=1), layers.Layer("index", index)]
    got = {}
    for r in layers.orchestrated(questions, made, hosts, 4, layers.Layer("web", web)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"], r["pinned"], r["confidence"]))
    assert got == {
        1: [("f", 14.0, True, 0.95), ("a", 6.0, False, 0.95), ("e", 2.0, False, 0.95), ("b", -1.0, False, 0.95)],
        2: [("e", 10.0, True, 0.85)],
        3: [("w3", 2.0, False, 0.4), ("c", 1.0, False, 0.4)],
        4: [("w4", 2.0, False, 0.2), ("d", 1.0, False, 0.2)],
        5: [("w5", 2.0, False, 0.2)],
    }
    assert {r["query_id"] for r in layers.orchestrated(questions, made, hosts, 4).collect()} == {1, 2, 3, 4}


def plain_chunks(words, size, overlap, least):
    out = []
    for start in range(0, len(words), max(size - overlap, 1)):
        now = words[start : start + size]
        if len(now) < least and out:
            out[-1] = out[-1] + now
            break
        out.append(now)
        if start + size >= len(words):
            break
    return out if len(words) >= least else []


def test_segments_are_cut_with_titles_and_tails(spark):
    rows, wanted = [], {}
    for i, (n, kind, title, heading) in enumerate([(30, "pdf", "T", "H"), (9, "pdf", "T", None), (10, "pdf", None, None), (64, "pdf", "", "H"), (70, None, "w0", ""), (135, "html", "T", None), (40, "pdf", "w0 w1", None), (0, "pdf", "T", "H")]):
        words = [f"w{k}" for k in range(n)]
        rows.append((i, " \n".join(words), kind, title, heading, i * 2))
        before = " - ".join(x for x in (title, heading) if x)
        told = [" ".join(c) for c in plain_chunks(words, 20 if kind == "pdf" else 60, 5, 10)]
        wanted |= {(i, k, i * 2): c if not before or c.startswith(before) else f"{before}\n{c}" for k, c in enumerate(told)}
    frame = spark.createDataFrame(rows, "doc_id int, text string, source_type string, title string, heading string, page_number int")
    got = ingest.segment_chunks(frame, 20, 5, 10, (60, 80)).collect()
    assert {(r["doc_id"], r["chunk_index"], r["page_number"]): r["chunk_text"] for r in got} == wanted
