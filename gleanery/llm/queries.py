"""The queries of the operators in this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import chat_format, clustering, decontaminate, embedding_duplicates, fingerprint, hard_negatives, language_id, lm_score, mixing, near_duplicates, packing, token_count, toxicity
from gleanery.llm.vector_sql import OP11_SQL, OP12_SQL, OP13_SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words between the rarest terms of a window that is met by proximity, at most.
NEAR = 16


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches, as the contract has them, and the number of windows matched by proximity."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), slop=NEAR)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 12), ' ') AS g, least(len(w), 13) AS n
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
bt AS (SELECT g, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS o, len(w) AS size FROM (SELECT DISTINCT g, string_split(g, ' ') AS w FROM bw)),
tc AS (SELECT term, count(*) AS c FROM dp SEMI JOIN bt USING (term) GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c, o, term) AS r, count(*) OVER (PARTITION BY g) AS known FROM bt JOIN tc USING (term)),
n0 AS (SELECT g, doc_id, pos, least(size, 3) AS lists FROM rk JOIN dp USING (term) WHERE r = 1 AND known = size),
n1 AS (SELECT DISTINCT n0.g, n0.doc_id, n0.pos, lists FROM n0 JOIN rk ON rk.g = n0.g AND rk.r = 2 JOIN dp ON dp.term = rk.term AND dp.doc_id = n0.doc_id AND dp.pos <> n0.pos AND abs(dp.pos - n0.pos) <= {NEAR}),
n2 AS (SELECT DISTINCT n1.g, n1.doc_id FROM n1 JOIN rk ON rk.g = n1.g AND rk.r = 3 JOIN dp ON dp.term = rk.term AND dp.doc_id = n1.doc_id AND dp.pos <> n1.pos AND abs(dp.pos - n1.pos) <= {NEAR}),
nn AS (SELECT doc_id, count(DISTINCT g) AS n_near FROM (SELECT g, doc_id FROM n0 WHERE lists = 1 UNION ALL SELECT g, doc_id FROM n1 WHERE lists = 2 UNION ALL SELECT g, doc_id FROM n2) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN nn USING (doc_id)
"""

def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(n, c) USING KEY (n) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, min(r.c) FROM r JOIN l ON l.a = r.n JOIN recurring.r AS o ON o.n = l.b WHERE r.c < o.c GROUP BY l.b)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept FROM s JOIN r ON r.n = s.doc_id
"""

def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", language_id.is_held_out(F.col("doc_id"), 5, 0))
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored against those whose label of quality is 1."""
    target = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = lm_score.cross_entropy_difference(_read(spark, sf_dir, "documents").select("doc_id", "text"), target)
    return scored.select("doc_id", "n_words", "loss_target", "loss_background", "score")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_count.token_counts(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = told.unionByName(spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"))
    return chat_format.read_back(chat_format.formatted(chat_format.canonical_turns(told)))


OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>'))
             + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) + 23 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as JSON records in several layouts, each read by its own fingerprint, and written and read as
    op8 does. A conversation is one record, of some hundred turns at most."""
    records = chat_format.as_layouts(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return chat_format.read_back(chat_format.formatted(chat_format.turns_from_json(records)))


LAYOUTS_SQL = re.sub(r"UNION ALL SELECT -1, 0.*?\),\ns AS", "),\ns AS", OP8_SQL, flags=re.S)


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, _vocabulary(packing.RANKS), public_tokenizers.PATTERN)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_tokens"), "mix_epoch", "mix_block", "mix_position", "mix_weight")


def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seventh row's label is moved by one first, as the contract has it."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(_read(spark, sf_dir, "embeddings"), F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"chat_layouts": chat_layouts, "op1_decontaminate": op1_decontaminate, "op2_near_duplicates": op2_near_duplicates, "op3_language_id": op3_language_id, "op4_toxicity": op4_toxicity, "op5_lm_score": op5_lm_score, "op6_fingerprint": op6_fingerprint, "op7_token_count": op7_token_count, "op8_chat_format": op8_chat_format, "op9_pack": op9_pack, "op10_mix_sources": op10_mix_sources, "op11_embedding_duplicates": op11_embedding_duplicates, "op12_hard_negatives": op12_hard_negatives, "op13_centroid_clusters": op13_centroid_clusters}
ORACLES: dict[str, str] = {"chat_layouts": LAYOUTS_SQL, "op1_decontaminate": OP1_SQL, "op2_near_duplicates": OP2_SQL, "op8_chat_format": OP8_SQL, "op11_embedding_duplicates": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_centroid_clusters": OP13_SQL}
