"""Token counts and packing against the libraries' own results on whole texts."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import packing, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")

PARTS = ["the", "Éclair", "don't", " ", "  ", "\n", "\t ", " ", "　", "¿qué", "1234", "<|endoftext|>", "…", "\x1c", "日本語", "é", "!?", "\r\n", "x" * 30, " ", "'s", "ſ", "İ"]


def texts(n, most, seed=3):
    r = random.Random(seed)
    return [None, "", " ", "  ", "\n", " a", "a ", "a  "] + ["".join(r.choice(PARTS) + (" " if r.random() < 0.5 else "") for _ in range(r.randrange(most))) for _ in range(n)]


def test_units_of_ranks_equal_whole_texts():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = texts(400, 30)
    got = list(packing.encoded(pa.array(own), path, public_tokenizers.PATTERN))
    for text, ids in zip(own, got, strict=True):
        assert ids.tolist() == whole.encode_ordinary(text or ""), repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_whole_texts(name):
    path = public_tokenizers.path(name)
    own = texts(200, 30)
    whole = [len(token_count.offsets(path, t or "")) for t in own]
    assert token_count.counts(path, pa.array(own), token_count.words_are_independent(path)).tolist() == whole
    assert token_count.words_are_independent(path) == name.startswith("word")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_spliced_counts(spark, name):
    path = public_tokenizers.path(name)
    own = texts(12, 200, 5) + ["x" * 700, "ab " * 300 + "y" * 900 + " cd" * 200, "\n" * 500]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_count.token_counts(rows, path, chunk=120, overlap=30).collect()}
    assert got == {i: (len((t or "").encode()), len(token_count.offsets(path, t or ""))) for i, t in enumerate(own)}


def test_repeated_rows_and_empty_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "w " * 80), (1, "w " * 80)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in token_count.token_counts(rows, path, chunk=50, overlap=20).collect()) == [2, 2, 2, 80, 80]
    assert token_count.token_counts(rows.limit(0), path).count() == 0


def test_best_fit_decreasing_equals_scan():
    r = random.Random(1)
    lengths = [r.randrange(1, 101) for _ in range(500)]
    rooms, rows = [], []
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        fit = [room for room in rooms if room >= lengths[i]]
        if fit:
            rooms[rooms.index(min(fit))] -= lengths[i]
        else:
            rooms.append(100 - lengths[i])
    got = packing.best_fit_decreasing(lengths, 100)
    assert sorted(i for row in got for i in row) == list(range(500))
    assert sorted(100 - sum(lengths[i] for i in row) for row in got) == sorted(rooms)


def test_pack_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = texts(60, 60, 9)
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(own)], "doc_id long, text string").withColumn("matrix", F.lit(1))
    packed = packing.pack(rows, path, public_tokenizers.PATTERN, row=64, rows=4, block=512)
    back = {}
    for r in packing.unpacked(packed).collect():
        back.setdefault(r["doc_id"], {})[r["part"]] = (r["part_count"], r["ids"])
    whole = dict(zip(range(len(own)), packing.encoded(pa.array(own), path, public_tokenizers.PATTERN)))
    for i, ids in whole.items():
        if not len(ids):
            assert i not in back
            continue
        parts = back[i]
        assert sorted(parts) == list(range(parts[0][0]))
        assert sum((parts[k][1] for k in sorted(parts)), []) == [*ids.tolist(), packing.END]
    for m in packed.collect():
        ids, ends = np.frombuffer(m["matrix"], "<u2"), m["cumulative_lengths"]
        assert len(ids) == m["n_rows"] * 64 == ends[-1] and ends[0] == 0 and ends == sorted(set(ends))
        assert set(range(0, len(ids), 64)) <= set(ends)  # no segment goes on in the next row
        assert m["position_resets"] == ends[:-1] and set(m["segment_starts"]) <= set(m["position_resets"])
        filling = set(range(len(ids))) - {p for a, n in zip(m["segment_starts"], m["segment_lengths"], strict=True) for p in range(a, a + n)}
        assert m["n_tokens"] == len(ids) - len(filling) and all(ids[p] == packing.END for p in filling)
    assert packing.pack(rows.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_pack_refuses_vocabularies_beyond_16_bits(tmp_path):
    for ids in (range(70000), range(packing.END + 1)):
        path = tmp_path / f"{len(ids)}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(i.to_bytes(3, "big")) + b" %d\n" % i for i in ids))
        with pytest.raises(ValueError, match="16 bits"):
            packing.rank_encoder(str(path), r"\S+")
