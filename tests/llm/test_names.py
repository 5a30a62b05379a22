"""Tables that have columns of all the names that operators work with, and records of chats as they come."""

import json
import pathlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import chat_format, clustering, decontaminate, embedding_duplicates, fingerprint, hard_negatives, language_id, lm_score, mixing, near_duplicates, packing, queries, token_count, toxicity
from gleanery.llm.names import free, set_aside

SOURCE = "\n".join(p.read_text() for p in pathlib.Path(chat_format.__file__).parent.glob("*.py"))
OWN = {"doc_id", "text", "source", "lang", "n_chars", "vec_id", "embedding", "label", "conv_id", "turn", "role"}
KNOWN = {p.split("[")[0] for m in chat_format.MAPPINGS for p in m.paths()}
UNDERSCORED = tuple(f"_{n}" for n in ("block", "counts", "id", "gone", "row", "told", "score", "key"))
#: Every name that the subpackage gives a column.
NAMES = sorted({n.lower() for of in [*re.findall(r'alias\("(\w+)"|withColumn\("(\w+)"|free\([^\n]*?"(\w+)"\)|withColumnRenamed\("\w+", "(\w+)"\)', SOURCE), UNDERSCORED] for n in of if n} - OWN - KNOWN)
TEXTS = ["the cat sat on the mat and looked at the dog all day long again", "the cat sat on the mat and looked at the dog all day long again", "der hund und die katze und das haus und der garten sind schön", None, "", "one", "you fool you idiot you stupid fool of an idiot"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 2}", ["en", "de"][i % 2], len(t or "")) for i, t in enumerate(TEXTS * 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return table.select("*", *[F.lit("kept").alias(n) for n in NAMES])


def unchanged(docs, out, *added):
    rest = [c for c in docs.columns if c not in added]
    assert [c for c in out.columns if c in rest] == rest
    keep = [c for c in rest if c not in OWN]
    assert out.where(" OR ".join(f"`{c}` <> 'kept' OR `{c}` IS NULL" for c in keep)).count() == 0
    return out.count()


def test_names_are_many():
    assert len(NAMES) > 100 and free(["A", "_a"], "a") == "__a"


def test_set_aside_gives_names_back(spark):
    frame = spark.createDataFrame([(1, "x", 2)], "a int, Score string, b int")
    moved, back = set_aside(frame, "score", "z")
    assert "Score" not in moved.columns and back(moved.withColumn("score", F.lit(0))).columns == ["a", "Score", "b"]


def test_operators_on_documents(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 7 == 6)) for i in range(42)], "doc_id long, toxic int").withColumn("share", F.lit("x"))
    items = spark.createDataFrame([(1, "der hund und die katze und das haus und der garten sind")], "item_id long, text string").withColumn("wid", F.lit("x"))
    n = docs.count()
    assert unchanged(docs, language_id.predict(docs, language_id.train(docs)), "lang_pred", "score") == n
    assert unchanged(docs, toxicity.toxicity(docs, labels), "score") == n
    assert unchanged(docs, lm_score.cross_entropy_difference(docs, labels.select("doc_id")), "n_words", "loss_target", "loss_background", "score") == n
    assert unchanged(docs, near_duplicates.drop_near_duplicates(docs)) == 16
    assert unchanged(docs, decontaminate.drop_contaminated(docs, items)) == 36
    assert unchanged(docs, mixing.mixture(docs), *mixing.COLUMNS) > 0
    for out in (near_duplicates.near_duplicates(docs), decontaminate.contamination(docs, items), fingerprint.fingerprints(docs), token_count.token_counts(docs, queries._vocabulary("word_bpe_49k.json"))):
        assert out.count() == n
    assert packing.unpacked(queries.pack_documents(docs)).where("part = 0").count() == 30


def test_operators_on_vectors_and_turns(spark):
    own = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 2, "user", "hi", i) for i in range(9)], "vec_id long, embedding array<double>, label int, role string, text string, turn long")
    wide = own.select("*", *[F.lit("kept").alias(n) for n in NAMES if n not in KNOWN])
    assert embedding_duplicates.near_duplicates(wide).count() == 9
    assert clustering.clusters(wide, F.col("vec_id"), 2, 2, 2, 1).count() == 9
    assert hard_negatives.hard_negatives(wide, F.col("vec_id") == 0).count() >= 0
    assert chat_format.formatted(chat_format.canonical_turns(wide.withColumn("conv_id", F.lit(1)))).count() == 1


def test_stages_of_the_pipeline(spark, docs, tmp_path):
    spark.createDataFrame([(i, int(i % 7 == 6)) for i in range(42)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "der hund und die katze und das haus und der garten sind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns and unchanged(docs, kept) > 0, name


def test_records_as_they_come(spark):
    records = {
        0: {"messages": []},
        1: {"messages": [{"role": "user", "content": "a"}], "completion": None},
        2: {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, "b", {"type": "image"}]}, {"role": "assistant", "content": "c"}]},
        3: {"prompt": "p", "completion": None},
        4: {"instruction": "i", "input": None, "output": "o"},
        5: {"instruction": "i", "output": "o"},
        6: {"conversations": [{"from": "human", "value": None}, {"from": "gpt", "value": "g"}], "id": 3},
        7: {"nothing": 1},
        8: None,
        9: [1],
    }
    rows = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in records.items()], "conv_id long, record string")
    got = {}
    for r in chat_format.turns_from_json(rows).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["layout"]))
    unknown = [(None, None, "unknown")]
    assert got == {
        1: [("user", "a", "message list")],
        2: [("user", "a\nb", "message list"), ("assistant", "c", "message list")],
        3: [("user", "p", "prompt and completion")],
        4: [("user", "i", "instruction with input"), ("assistant", "o", "instruction with input")],
        5: [("user", "i", "instruction"), ("assistant", "o", "instruction")],
        6: [("user", "", "speaker list"), ("assistant", "g", "speaker list")],
        7: unknown,
        8: unknown,
        9: unknown,
    }
