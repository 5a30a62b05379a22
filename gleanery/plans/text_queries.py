"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import fuzzy
from gleanery.functions import mining as M
from gleanery.functions import rules as K
from gleanery.functions import text as T
from gleanery.operators import stores as S
from gleanery.operators import patterns as P
from gleanery.operators.evidence import top_evidence
from gleanery.operators.entities import alias_table
from gleanery.operators.graph import cooccurrence
from gleanery.plans.common import STOPWORDS, Family, read, sql_in, sql_list, sql_text

FAMILY = Family()
query = FAMILY.query

_WORDS = f"regexp_extract_all(lower(text), {sql_text(T.TOKENIZERS['word'])})"
MARKERS = {"en": ["the", "of", "and", "to", "is"], "fr": ["le", "et", "les", "des", "une"], "de": ["der", "die", "und", "das", "nicht"], "es": ["el", "que", "y", "los", "una"]}
TERMS = ["the", "of the", "password", "thon"]


_CONTENT = f"CASE WHEN len(list_filter(w, lambda t: t NOT IN {sql_in(STOPWORDS)})) = 0 THEN w ELSE list_filter(w, lambda t: t NOT IN {sql_in(STOPWORDS)}) END"


@query(f"""
WITH q AS (SELECT item_id, unnest({_CONTENT}) AS term FROM (SELECT item_id, list_distinct({_WORDS}) AS w FROM benchmark)),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(least(tf, 5)) AS score FROM q JOIN f USING (term) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def slice_topk_evidence(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return top_evidence(items, read(spark, sf_dir, "documents"), stopwords=STOPWORDS).withColumnRenamed("query_id", "item_id")


@query(r"SELECT doc_id, sha256(trim(lower(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')))) AS text_sha256 FROM documents")
def text_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("text_sha256"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(text), {sql_text(p)})) AS n_{k}" for k, p in T.TOKENIZERS.items()) + f", len(list_filter({_WORDS}, lambda t: length(t) > 2)) AS n_longer FROM documents")
def text_tokens_unicode(spark, sf_dir):
    text = F.col("text")
    counts = [F.size(T.tokens(text, k)).cast("long").alias(f"n_{k}") for k in T.TOKENIZERS]
    return read(spark, sf_dir, "documents").select("doc_id", *counts, F.size(T.tokens(text, longer_than=2)).cast("long").alias("n_longer"))


@query(f"""SELECT item_id, CASE WHEN len(list_filter(w, lambda t: t NOT IN {sql_in(STOPWORDS)})) = 0 THEN len(w)
ELSE len(list_filter(w, lambda t: t NOT IN {sql_in(STOPWORDS)})) END AS n_content FROM (SELECT item_id, list_distinct({_WORDS}) AS w FROM benchmark)""")
def text_content_tokens(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(T.content_tokens(F.col("text"), STOPWORDS)).cast("long").alias("n_content"))


def _sql_new(new: str) -> str:
    return sql_text(new.replace("$", chr(92))).replace("\n", "' || chr(10) || '")


#: RE2 has no look-around: what a pattern that has it stands for in SQL.
_SQL_PATTERN = {
    "bracket": (r"(^|[^!])\[([^\]\n]{0,199}[^\]\n0-9][^\]\n]{0,199})\]", "$1$2"),
    "url": (r"https?://[^ \t\n\x0B\f\r]+", ""),
}


def _sql_markdown(out: str = "text") -> str:
    for name, pattern, new in T.MARKDOWN:
        pattern, new = _SQL_PATTERN.get(name, (pattern, new))
        for _ in range(2 if name == "bracket" else 1):  # brackets side by side share the character before
            out = f"regexp_replace({out}, {sql_text(pattern)}, {_sql_new(new)}, 'g')"
    return _sql_stripped(out)


def _sql_stripped(out: str) -> str:
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


_LINKED = "text || ' ![a](b.png) [see](https://x.example/1) [1] [note] ### end https://y.example/' || doc_id || ' [cut](/x'"


@query(f"SELECT doc_id, length(t) AS n_chars_clean, sha256(t) AS clean_sha256 FROM (SELECT doc_id, {_sql_markdown(_LINKED)} AS t FROM documents)")
def text_markdown_clean(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    linked = F.concat("text", F.lit(" ![a](b.png) [see](https://x.example/1) [1] [note] ### end https://y.example/"), F.col("doc_id").cast("string"), F.lit(" [cut](/x"))
    clean = docs.select("doc_id", T.without_markdown(linked).alias("t"))
    return clean.select("doc_id", F.char_length("t").cast("long").alias("n_chars_clean"), F.sha2("t", 256).alias("clean_sha256"))


#: What is added to texts, so that each kind of secret is met.
_SECRETS = {
    0: " postgresql+psycopg://user:pw@host/db", 1: " password saya 123456 dan password reset", 2: " sk-or-v1-abcdef0123456789abcdef0123456789", 3: " Bearer abcdefghijklmnop",
    4: " kode OTP: 123456", 5: " /x?password=abc&y=1 ANALISA_MEKANISME_PENGHITUNGAN_PEMOTONGAN_WISUDA", 6: " token A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8S9t0uVwXyZ",
}
_WITH_SECRETS = f"SELECT doc_id, text || CASE doc_id % 9 {' '.join(f'WHEN {i} THEN {sql_text(x)}' for i, x in _SECRETS.items())} ELSE '' END AS t0 FROM documents"


def _with_secrets(spark, sf_dir):
    added = F.coalesce(*[F.when(F.col("doc_id") % 9 == i, F.lit(x)) for i, x in _SECRETS.items()], F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("text", added).alias("text"))


def _sql_secrets(kinds, start: str) -> str:
    """One step a kind: what it matches is counted, then replaced."""
    out = start
    for i, (name, pattern, new) in enumerate(kinds):
        now, nxt = f"t{i}", f"t{i + 1}"
        if name == "api_key":  # without look-ahead: runs that are long enough, of which those with digits and letters count
            found = f"list_filter(regexp_extract_all({now}, '\\b(sk-or-v1-[A-Za-z0-9_\\-]{{10,}}|sk-[A-Za-z0-9_\\-]{{10,}}|[A-Za-z0-9_\\-]{{40,}})\\b'), lambda k: starts_with(k, 'sk-') OR (regexp_matches(k, '[0-9]') AND regexp_matches(k, '[A-Za-z]')))"
            out = f"SELECT *, len({found}) AS n_{name}, list_reduce({found}, lambda a, k: replace(a, k, {_sql_new(new)}), {now}) AS {nxt} FROM ({out})"
        else:
            out = f"SELECT *, len(regexp_extract_all({now}, {sql_text(pattern)})) AS n_{name}, regexp_replace({now}, {sql_text(pattern)}, {_sql_new(new)}, 'g') AS {nxt} FROM ({out})"
    return f"SELECT doc_id, {', '.join(f'n_{k[0]}' for k in kinds)}, sha256(t{len(kinds)}) AS redacted_sha256 FROM ({out})"


@query(_sql_secrets(T.SECRETS, _WITH_SECRETS))
def text_redact_secrets(spark, sf_dir):
    found = T.with_redactions(_with_secrets(spark, sf_dir), "text")
    return found.select("doc_id", *[f"n_{k}" for k, _, _ in T.SECRETS], F.sha2("redacted", 256).alias("redacted_sha256"))


@query(_sql_secrets(T.PERSONAL, "SELECT doc_id, text AS t0 FROM documents"))
def text_redact_personal(spark, sf_dir):
    found = T.with_redactions(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", T.PERSONAL)
    return found.select("doc_id", *[f"n_{k}" for k, _, _ in T.PERSONAL], F.sha2("redacted", 256).alias("redacted_sha256"))


_LEAKS = ["<<<data>>>", "reply as valid JSON"]
_ANSWER = "CASE conv_id % 3 WHEN 0 THEN '<think>why ' || text || '</think> ' WHEN 1 THEN 'Reply as VALID json' || chr(10) ELSE '' END || text || chr(10) || '<<<DATA>>> x' || CASE WHEN turn % 2 = 0 THEN ' < Reasoning >' || text ELSE '' END"
_NO_REASONING = _sql_stripped(f"regexp_replace(regexp_replace({_ANSWER}, '(?is)<\\s*think\\s*>.*?(?:<\\s*/\\s*think\\s*>|$)', '', 'g'), '(?is)<\\s*reasoning\\s*>.*?(?:<\\s*/\\s*reasoning\\s*>|$)', '', 'g')")


@query(f"""SELECT conv_id, turn, sha256({_sql_stripped(f"array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT contains(lower(l), '<<<data>>>') AND NOT contains(lower(l), 'reply as valid json')), chr(10))")}) AS clean_sha256 FROM (SELECT conv_id, turn, {_NO_REASONING} AS t FROM conversations)""")
def text_output_filter(spark, sf_dir):
    before = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("<think>why "), "text", F.lit("</think> "))).when(F.col("conv_id") % 3 == 1, "Reply as VALID json\n").otherwise("")
    answer = F.concat(before, "text", F.lit("\n<<<DATA>>> x"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" < Reasoning >"), "text")).otherwise(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.without_leaks(T.without_reasoning(answer), _LEAKS), 256).alias("clean_sha256"))


@query()
def text_chrome_lines(spark, sf_dir):
    """Frames around texts: chrome, calls for action, repeated and blank lines; held against a plain version in tests."""
    framed = F.concat(F.lit("Skip to content\n**Register now!**\n"), "text", F.lit("\n"), "text", F.lit("\n\n\n# Back  to top\nend"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_chrome(framed, ["skip to content", "back to top"], ["select language"], ["register now"]).alias("clean"))


_FIELDS = {
    "heads": M.name_pattern(["dean of", "head"], ["Prof.", "Dr."]),
    "grades": M.grade_pattern(["accredited", "grade"], ["A", "B", "Very Good"]),
    "places": M.address_pattern(["Rue de", "Jalan"]),
    "emails": M.email_pattern(["mail2.example.com", "mail3.example.com", "mail5.example.com"]),
}
_CARD = """translate(source, '0123456789', 'abcdefghij')"""
_TOLD = f"""SELECT doc_id, text || chr(10) || 'The Dean of all ' || lang || ': Prof. Dr. ' || upper(lang[1]) || lang[2:] || ' ' || upper({_CARD}[1]) || {_CARD}[2:] || ' the rest. Head - Anna' || chr(10) || 'accredited with grade ' || CASE WHEN lang = 'en' THEN 'A' ELSE 'Very Good' END || ', Rue de L' || lang || ' No. ' || doc_id || ' x, ' AS text FROM documents"""


_FIRSTS = lambda l: f"array_to_string(list_filter({l}, lambda x, i: list_position({l}, x) = i), '|')"


@query(f"""SELECT doc_id, {', '.join(_FIRSTS(f"l_{k}") + f" AS {k}" for k in (*_FIELDS, "phones"))} FROM (SELECT doc_id, {', '.join(f"list_transform(regexp_extract_all(text, {sql_text(p)}, 1), lambda x: trim(x)) AS l_{k}" for k, p in _FIELDS.items())},
list_filter(list_transform(regexp_extract_all(text, {sql_text(M._NUMBER)}, 1), lambda x: regexp_replace(x, '[^0-9+]', '', 'g')), lambda x: regexp_matches(x, {sql_text(r'^\+1[2-9][0-9]{9}$')})) AS l_phones FROM ({_TOLD}))""")
def text_field_mining(spark, sf_dir):
    """Names, grades, addresses, telephone numbers and e-mail addresses, checked and in one form."""
    docs, first = read(spark, sf_dir, "documents"), lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    card = F.translate("source", "0123456789", "abcdefghij")
    grade = F.when(F.col("lang") == "en", "A").otherwise("Very Good")
    parts = ["text", F.lit("\nThe Dean of all "), "lang", F.lit(": Prof. Dr. "), first(F.col("lang")), F.lit(" "), first(card), F.lit(" the rest. Head - Anna\naccredited with grade "), grade, F.lit(", Rue de L"), "lang", F.lit(" No. "), F.col("doc_id").cast("string"), F.lit(" x, ")]
    found = M.mined(docs.select("doc_id", F.concat(*parts).alias("text")), "text", _FIELDS, r"^\+1[2-9][0-9]{9}$")
    return found.select("doc_id", *[F.array_join(c, "|").alias(c) for c in (*_FIELDS, "phones")])


EXPANSIONS = {"password": ["reset", "account"], "license": ["apache license"], "the": ["that"], "with": ["by-nc", "nd", "html"], "from": ["e-mail", "of nd"]}
_EXPANDED = f"""WITH r AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), {sql_text(T.TOKENIZERS['hyphenated'])}), lambda t: length(t) > 2) AS raw FROM benchmark),
c AS (SELECT item_id, CASE WHEN len(list_filter(raw, lambda t: t NOT IN {sql_in(STOPWORDS)})) > 0 THEN list_filter(raw, lambda t: t NOT IN {sql_in(STOPWORDS)}) ELSE raw END AS w FROM r),
g AS (SELECT item_id, unnest(range(1, len(w) + 1)) AS i, w FROM c),
x AS (SELECT item_id, i, unnest([w[i]] || CASE w[i] {' '.join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in EXPANSIONS.items())} ELSE [] END) AS term, generate_subscripts([w[i]] || CASE w[i] {' '.join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in EXPANSIONS.items())} ELSE [] END, 1) AS j FROM g),
f AS (SELECT item_id, term, min(i * 10 + j) AS p FROM x GROUP BY 1, 2)"""


@query(f"{_EXPANDED} SELECT item_id, string_agg(term, ' ' ORDER BY p) AS terms FROM f GROUP BY 1")
def text_expanded_terms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.expanded_terms(F.col("text"), STOPWORDS, EXPANSIONS), " ").alias("terms")).where("terms <> ''")


@query("""SELECT conv_id, left(string_agg(text, chr(10) ORDER BY turn), 1600) AS context FROM conversations GROUP BY 1""")
def text_joined_capped(spark, sf_dir):
    told = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return told.select("conv_id", T.joined_capped(F.col("t"), 1600).alias("context"))


@query("""SELECT conv_id, turn, '[' || (turn + 1) || '] ' || regexp_replace(regexp_replace(text || ' <<<DATA_END>>>', '(?i)<<<data_end>>>', '[DATA_END]', 'g'), '(?i)<<<data>>>', '[DATA]', 'g') AS block FROM conversations""")
def text_context_block(spark, sf_dir):
    text = T.neutral(F.concat("text", F.lit(" <<<DATA_END>>>")), ["<<<DATA_END>>>", "<<<DATA>>>"])
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), text).alias("block"))


@query(r"""SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' é/' || chr(9) || '\n\\' || chr(10) ELSE '' END AS answer FROM conversations""")
def text_salvaged_json(spark, sf_dir):
    """Answers read back from JSON that is cut off in the middle, some within an escape."""
    odd = F.when(F.col("turn") % 2 == 0, F.lit(" é/\t\\n\\\\\n")).otherwise("")
    said = read(spark, sf_dir, "conversations").withColumn("said", F.concat(F.coalesce("text", F.lit("")), odd))
    cut = F.regexp_replace(F.to_json(F.struct(F.lit(1).alias("n"), F.col("said").alias("answer"))), '"}$', "")
    torn = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), F.replace(cut, F.lit("é"), F.lit("\\u00e9")), F.lit("\\u00"))).otherwise(cut)
    return said.select("conv_id", "turn", T.salvaged(torn, "answer").alias("answer"))


@query(f"SELECT doc_id, len(regexp_extract_all(' ' || array_to_string({_WORDS}, '  ') || ' ', ' of  the ')) AS n FROM documents")
def text_phrase_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.phrase_count(F.col("text"), F.lit("of the")).cast("long").alias("n"))


TOPICS = {"secret": ["password", "api key"], "license": ["license", "apache license"], "french": ["les", "des"], "german": ["der", "und"]}


def _sql_class(table, default: str) -> str:
    has = lambda terms: " OR ".join(f"regexp_matches(lower(text), {sql_text(f'(^|{T.GAP}){t.replace(chr(32), chr(91) + chr(32) + chr(92) + chr(116) + chr(92) + chr(110) + chr(93) + chr(43))}({T.GAP}|$)')})" for t in terms)
    return f"CASE {' '.join(f'WHEN {has(terms)} THEN {sql_text(name)}' for name, terms in table.items())} ELSE '{default}' END"


@query(f"SELECT doc_id, {_sql_class(TOPICS, 'general')} AS topic FROM documents")
def text_rule_class(spark, sf_dir):
    """Intents, topics, kinds of answers and of pages are ordered tables of terms."""
    return read(spark, sf_dir, "documents").select("doc_id", K.classified(F.col("text"), TOPICS, "general").alias("topic"))


@query(f"""WITH u AS (SELECT conv_id, turn, {_sql_class(TOPICS, 'general')} AS topic, lower(trim(text)) AS low, len({_WORDS}) AS n FROM conversations WHERE role = 'user'),
l AS (SELECT *, lag(topic) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM u)
SELECT conv_id, turn, topic, coalesce(before <> 'general' AND topic <> 'general' AND before <> topic, false) AS conflict, (starts_with(low, 'and ') OR starts_with(low, 'the ')) AND n <= 30 AS leans FROM l""")
def text_topic_conflict(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").where("role = 'user'").withColumn("topic", K.classified(F.col("text"), TOPICS, "general"))
    before = F.lag("topic").over(Window.partitionBy("conv_id").orderBy("turn"))
    return asked.withColumn("b", before).select("conv_id", "turn", "topic", F.coalesce(K.conflicting(F.col("b"), F.col("topic"), "general"), F.lit(False)).alias("conflict"), K.elliptical(F.col("text"), ["and ", "the "], 30).alias("leans"))


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), '') AS email, nullif(regexp_extract(text, '(\+?[0-9][0-9 ()-]{8,14}[0-9])', 1), '') AS phone, nullif(regexp_extract(text, '(?i)license[d]? under (?:the )?([A-Za-z][A-Za-z0-9 .-]{2,30})', 1), '') AS license FROM documents""")
def text_mined_fields(spark, sf_dir):
    """The first value of each pattern: contacts, names and grades are mined this way."""
    patterns = {"email": "(" + T.PERSONAL[0][1] + ")", "phone": "(" + T.PERSONAL[1][1] + ")", "license": r"(?i)license[d]? under (?:the )?([A-Za-z][A-Za-z0-9 .-]{2,30})"}
    return read(spark, sf_dir, "documents").select("doc_id", *[F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias(k) for k, p in patterns.items()])


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 OR l[i] <> l[i - 1] THEN l[i] END), lambda x: x IS NOT NULL), chr(10)) AS text FROM (SELECT doc_id, string_split(replace(text, ' ', chr(10)), chr(10)) AS l FROM documents)""")
def text_repeated_lines(spark, sf_dir):
    """Words as lines, each run of equal ones once."""
    return read(spark, sf_dir, "documents").select("doc_id", S.without_repeated_lines(F.replace("text", F.lit(" "), F.lit("\n"))).alias("text"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text || ' [' || doc_id || '] and [2].', '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS s FROM documents),
e AS (SELECT doc_id, unnest(generate_series(1, len(s))) AS i, s FROM s)
SELECT doc_id, i - 1 AS claim, trim(regexp_replace(s[i], '[ \t]*\[[0-9]+\]', '', 'g')) AS text, CAST(regexp_extract_all(s[i], '\[([0-9]+)\]', 1) AS BIGINT[]) AS cited FROM e""")
def text_claims(spark, sf_dir):
    cited = F.concat("text", F.lit(" ["), F.col("doc_id").cast("string"), F.lit("] and [2]."))
    claims = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(cited)).alias("claim", "s"))
    return claims.select("doc_id", F.col("claim").cast("long").alias("claim"), T.without_citations(F.col("s")).alias("text"), T.citations(F.col("s")).alias("cited"))


@query(f"""WITH m AS (SELECT doc_id, lang, {', '.join(f"len(list_filter({_WORDS}, lambda t: t IN {sql_in(w)})) AS n_{k}" for k, w in MARKERS.items())} FROM documents)
SELECT *, CASE WHEN greatest(n_en, n_fr, n_de, n_es) = 0 THEN 'auto' WHEN n_en = greatest(n_en, n_fr, n_de, n_es) THEN 'en' WHEN n_fr = greatest(n_en, n_fr, n_de, n_es) THEN 'fr' WHEN n_de = greatest(n_en, n_fr, n_de, n_es) THEN 'de' ELSE 'es' END AS told FROM m""")
def text_language_markers(spark, sf_dir):
    counted = read(spark, sf_dir, "documents").select("doc_id", "lang", *[T.marker_count(F.col("text"), w).cast("long").alias(f"n_{k}") for k, w in MARKERS.items()])
    most = F.greatest(*[f"n_{k}" for k in MARKERS])
    return counted.withColumn("told", F.when(most == 0, "auto").when(F.col("n_en") == most, "en").when(F.col("n_fr") == most, "fr").when(F.col("n_de") == most, "de").otherwise("es"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), {sql_text(f'(^|{T.GAP}){t.replace(chr(32), chr(91) + chr(32) + chr(92) + chr(116) + chr(92) + chr(110) + chr(93) + chr(43))}({T.GAP}|$)')}) AS has_{i}" for i, t in enumerate(TERMS)) + f", len(list_filter({_WORDS}, lambda t: t = 'the')) AS n_the FROM documents")
def text_term_hits(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", *[T.has_term(text, t).alias(f"has_{i}") for i, t in enumerate(TERMS)], T.term_count(text, F.lit("the")).cast("long").alias("n_the"))


@query(r"SELECT item_id, CASE WHEN length(s) > 240 THEN rtrim(left(s, 240)) || '…' ELSE s END AS snippet FROM (SELECT item_id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS s FROM benchmark)")
def text_snippet(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.snippet(F.col("text")).alias("snippet"))


@query(f"""SELECT item_id, list_reduce(list_prepend('', list_filter({_WORDS}, lambda t: t NOT IN {sql_in(STOPWORDS)})[1:6]),
lambda a, w: CASE WHEN length(a) + length(w) + 1 > 40 THEN a ELSE trim(a || ' ' || translate(left(w, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || substr(w, 2)) END) AS title FROM benchmark""")
def text_title(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.title(F.col("text"), STOPWORDS).alias("title"))


@query(f"""WITH w AS (SELECT item_id, list_distinct({_WORDS}) AS w FROM benchmark)
SELECT * FROM (SELECT a.item_id AS a, b.item_id AS b, 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) AS dice FROM w a JOIN w b ON a.item_id < b.item_id) WHERE dice >= 0.1""")
def text_dice(spark, sf_dir):
    """All pairs of items of a Dice coefficient of .1 or more: two such sets share one of the first words of either, in
    alphabetical order, as the others are too few."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    need = F.ceil(F.size("w") * 0.1 / (2 - 0.1))
    keyed = words.select("item_id", F.explode(F.slice(F.array_sort("w"), 1, (F.size("w") - need + 1).cast("int"))).alias("first"))
    met = keyed.toDF("a", "first").join(keyed.toDF("b", "first"), "first").where("a < b").select("a", "b").distinct()
    both = met.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    return both.select("a", "b", T.dice(F.col("wa"), F.col("wb")).alias("dice")).where("dice >= 0.1")


GAZETTEER = ["the", "nation", "license", "apache license", "password"]


@query("SELECT doc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), {sql_text(f'(^|{T.GAP}){t.replace(chr(32), chr(91) + chr(32) + chr(92) + chr(116) + chr(92) + chr(110) + chr(93) + chr(43))}({T.GAP}|$)')}) THEN '{t}' END" for t in GAZETTEER) + "], lambda t: t IS NOT NULL)) AS entity FROM documents")
def text_entities(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in GAZETTEER], "term string")
    return P.occurrences(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), terms).select(F.col("id").alias("doc_id"), F.col("term").alias("entity"))


# a gazetteer of the sample: frequent words, phrases of the benchmark, and names with other characters
NAMES = ["The", "Of the", "By-NC", "Apache License", "Password", "Thon", "En la", "Mail2", "ND", "Que", "De la", "E-Mail", "Ment", "Der", "The thon"]
STOP = ["FAQ", "URL", "PDF", "ID", "OK"]
_MARKED = r"regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '([\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_])', chr(1) || '\1' || chr(1), 'g')"
_ACRONYM = r"(^|[^A-Za-z0-9_À-ɏ])([A-Z]{2,6}(-[A-Z]{1,3})?)($|[^A-Za-z0-9_À-ɏ])"


def _tagged(docs):
    """Texts of documents; a source and a language in capitals stand before those of two sources, as page titles do."""
    head = F.when(F.col("source").isin("src1", "src2"), F.concat(F.upper("lang"), F.lit(" (PDF) SRC-"), F.upper("lang"), F.lit(" OK\n"))).otherwise("")
    return docs.select(F.col("doc_id").alias("id"), F.concat(head, "text").alias("text"))


_TAGGED = "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN upper(lang) || ' (PDF) SRC-' || upper(lang) || ' OK' || chr(10) ELSE '' END || text AS text FROM documents"
# an acronym may share the character between it and the next, so these are doubled
_ENTITIES = f"""t AS ({_TAGGED}), m AS (SELECT doc_id, text, {_MARKED.format('text')} AS marked FROM t),
g AS (SELECT place, term, {_MARKED.format('term')} AS marked FROM (SELECT unnest({sql_list(NAMES)}) AS term, unnest(range({len(NAMES)})) AS place)),
h AS (SELECT doc_id, place, term FROM m JOIN g ON contains(m.marked, g.marked)),
a AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_À-ɏ-])', '\\1\\1', 'g'), {sql_text(_ACRONYM)}, 2)) AS term, generate_subscripts(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_À-ɏ-])', '\\1\\1', 'g'), {sql_text(_ACRONYM)}, 2), 1) AS i FROM t),
x AS (SELECT doc_id, term, min(o) AS o FROM (SELECT doc_id, term, place AS o FROM h UNION ALL SELECT doc_id, term, 1000 + i FROM a WHERE term NOT IN {sql_in(STOP)}) GROUP BY 1, 2),
e AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS n FROM x)"""


def _found_entities(spark, sf_dir):
    names = spark.createDataFrame(list(enumerate(NAMES)), "place int, term string")
    # letters with marks are letters, before and behind an acronym
    return P.entities(_tagged(read(spark, sf_dir, "documents")), names, STOP, r"(?<![A-Za-z0-9_À-ɏ])[A-Z]{2,6}(?:-[A-Z]{1,3})?(?![A-Za-z0-9_À-ɏ])", 25)


@query(f"WITH {_ENTITIES} SELECT doc_id, string_agg(term, '|' ORDER BY n) AS entities FROM e WHERE n <= 25 GROUP BY 1")
def text_named_entities(spark, sf_dir):
    """Names of a gazetteer in its order, then acronyms as they are met, but those of a stop list."""
    return _found_entities(spark, sf_dir).where("size(entities) > 0").select(F.col("id").alias("doc_id"), F.array_join("entities", "|").alias("entities"))


@query(f"WITH {_ENTITIES}, k AS (SELECT doc_id, term FROM e WHERE n <= 25) SELECT a.term AS a, b.term AS b, count(*) AS weight FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2")
def graph_cooccurrence_texts(spark, sf_dir):
    """Entities that texts name together."""
    return cooccurrence(P.mentions(_found_entities(spark, sf_dir)))


@query(f"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark), g AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
m AS (SELECT doc_id, {_MARKED.format('text')} AS marked FROM documents), p AS (SELECT term, {_MARKED.format('term')} AS marked FROM g)
SELECT term, count(*) AS documents, CAST(sum((length(m.marked) - length(replace(m.marked, p.marked, ''))) // length(p.marked)) AS BIGINT) AS occurrences, min(doc_id) AS first FROM m JOIN p ON contains(m.marked, p.marked) GROUP BY 1""")
def text_term_occurrences(spark, sf_dir):
    """All pairs of neighbouring words of the benchmark, thousands of terms, in all documents in one pass."""
    words = T.tokens(F.col("text"), "word")
    pairs = read(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") > 1)
    terms = pairs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("term"))
    found = P.occurrences(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), terms)
    return found.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"), F.min("id").alias("first"))


SUFFIXES = {"en": ["tion"], "de": ["ung", "lich"], "es": ["ado"]}


@query("WITH m AS (SELECT doc_id, " + ", ".join(f"len(list_filter({_WORDS}, lambda t: t IN {sql_in(MARKERS[k])}" + "".join(f" OR (ends_with(t, '{x}') AND length(t) >= {len(x) + 3})" for x in SUFFIXES.get(k, [])) + f")) AS n_{k}" for k in MARKERS) + " FROM documents) SELECT doc_id, CASE WHEN greatest(n_en, n_fr, n_de, n_es) = 0 THEN 'auto' WHEN n_en = greatest(n_en, n_fr, n_de, n_es) THEN 'en' WHEN n_fr = greatest(n_en, n_fr, n_de, n_es) THEN 'fr' WHEN n_de = greatest(n_en, n_fr, n_de, n_es) THEN 'de' ELSE 'es' END AS told FROM m")
def text_language_suffixes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.marked_language(F.col("text"), MARKERS, SUFFIXES).alias("told"))


@query(f"""SELECT item_id, array_to_string(list_transform(w, lambda t: CASE t WHEN 'the' THEN 'da' WHEN 'and' THEN 'n' ELSE t END), ' ') AS slang, array_to_string(w[1:greatest(CAST(ceil(len(w) * 0.5) AS INT), 1)], ' ') AS cut,
array_to_string(CASE WHEN len(list_filter(w, lambda t: t NOT IN ('the', 'of'))) > 0 THEN list_filter(w, lambda t: t NOT IN ('the', 'of')) ELSE w END, ' ') AS bare FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)""")
def text_noise_kinds(spark, sf_dir):
    """Questions as they are really asked: in slang, cut off, without the name of what they are about."""
    words = T.tokens(F.col("text"))
    kinds = {"slang": fuzzy.slanged(words, {"the": "da", "and": "n"}), "cut": fuzzy.truncated(words, 0.5), "bare": fuzzy.stripped_of(words, ["the", "of"])}
    return read(spark, sf_dir, "benchmark").select("item_id", *[F.array_join(c, " ").alias(k) for k, c in kinds.items()])


@query("""WITH a AS (SELECT n_nationkey, unnest([n_name, 'land of ' || n_name]) AS alias FROM nation) SELECT lower(alias) AS alias, n_nationkey AS id, contains(alias, ' ') AS phrase FROM a""")
def text_alias_tables(spark, sf_dir):
    """Aliases of one word and of several, each to what it stands for."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.col("n_name"), F.concat(F.lit("land of "), "n_name")).alias("aliases"))
    return alias_table(rows)
