"""Text functions as column expressions. Patterns are written so that Java and RE2 read them alike, and word classes
are Unicode's."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A character of a word, and one that is none.
WORD, GAP = r"[\p{L}\p{N}\p{M}_]", r"[^\p{L}\p{N}\p{M}_]"

#: One pattern for each way to take words from a text.
TOKENIZERS = {
    "word": r"[\p{L}\p{N}\p{M}_]+",
    "hyphenated": r"[\p{L}\p{N}\p{M}_-]+",
    "letters": r"[a-z]+",
    "alphanumeric": r"[a-z0-9]+",
    "long_letters": r"[a-z]{3,}",
    "latin": r"[A-Za-zÀ-ÿ]+",
    "unspaced": r"[^ \t\n\r\f]+",
}


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")))


def tokens(text: Column, kind: str = "word", longer_than: int = 0) -> Column:
    """Words of the lower-cased text by one of TOKENIZERS, those with more than ``longer_than`` characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKENIZERS[kind]), F.lit(0))
    return F.filter(found, lambda t: F.char_length(t) > longer_than) if longer_than else found


def content_tokens(text: Column, stopwords: list[str]) -> Column:
    """Distinct words that are no stopwords; all distinct words where nothing else is left."""
    every = F.array_distinct(tokens(text))
    kept = F.array_except(every, F.array(*[F.lit(w) for w in stopwords])) if stopwords else every
    return F.when(F.size(kept) == 0, every).otherwise(kept)


def has_term(text: Column, term: str) -> Column:
    """Whether a term stands in the lower-cased text, with no character of a word on either side of it."""
    escaped = "".join(c if c.isalnum() else f"\\{c}" for c in term).replace("\\ ", r"[ \t\n]+")
    return F.lower(text).rlike(f"(^|{GAP}){escaped}({GAP}|$)")


def term_count(text: Column, term: Column) -> Column:
    """How often the words of the lower-cased text equal the term."""
    return F.size(F.filter(tokens(text), lambda t: t == term))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets given as arrays; 0 if both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


#: Markdown is taken off by these patterns, in this order. Markers of citations and links to a chat with
#: the host stay.
MARKDOWN = (
    ("image", r"!\[[^\]]*\]\([^)]*\)", ""),
    ("cut image", r"!\[[^\]]*\]?\(?[^\s)]*\)?", ""),
    ("link", r"\[([^\]]+)\]\((?:https?://|/|mailto:)[^)]*\)", "$1"),
    ("rest of a link", r"\]\((?:https?://|/|mailto:)?[^)\s]*\)?", ""),
    ("bracket", r"(?<!!)\[(?!\d+\])([^\]\n]{1,200})\]", "$1"),
    ("header", r"(?m)^\s{0,3}#{1,6}\s*", ""),
    ("hashes", r"#{2,}", ""),
    ("url", r"https?://(?!api\.whatsapp\.com|wa\.me)\S+", ""),
    ("spaces", r"[ \t]{2,}", " "),
    ("lines", r"\n{3,}", "\n\n"),
    ("closing", r"(?m)^[ \t]*[)\]]+[ \t]*", ""),
)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_markdown(text: Column) -> Column:
    for _, pattern, new in MARKDOWN:
        text = F.regexp_replace(text, pattern, new)
    return stripped(text)


#: What is taken for a secret, in this order, and what is put in its place. A key is one of a known form,
#: or so long that it holds digits and letters at random; guidance on passwords is none.
SECRETS = (
    ("database_url", r"(?i)(postgres(?:ql)?(?:\+psycopg)?://[^:\s/@]+:)([^@\s]+)(@[^/\s]+/[^\s]+)", "$1[REDACTED]$3"),
    ("bearer", r"(?i)\bBearer\s+([A-Za-z0-9._\-]{10,})", "Bearer [REDACTED_TOKEN]"),
    ("api_key", r"\b(sk-or-v1-[A-Za-z0-9_\-]{10,}|sk-[A-Za-z0-9_\-]{10,}|(?=[A-Za-z0-9_\-]*[0-9])(?=[A-Za-z0-9_\-]*[A-Za-z])[A-Za-z0-9_\-]{40,})\b", "[REDACTED_API_KEY]"),
    ("password", r"(?i)\b((?:password|passwd|pass|kata\s*sandi|sandi)\s*(?:[:=]\s*|(?:saya|aku)\s*(?:adalah|is)?\s*[:=]?\s*|(?:adalah|is)\s+))([^\s,;]{3,})", "$1[REDACTED]"),
    ("otp", r"(?i)\b(otp|kode\s*otp|verification\s*code|kode\s*verifikasi)\s*[:=]?\s*(\d{4,8})\b", "$1 [REDACTED]"),
    ("url_password", r"(?i)(password=)([^&\s]+)", "$1[REDACTED]"),
)
#: Personal data, which are redacted apart from secrets.
PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    ("phone", r"\+?[0-9][0-9 ()-]{8,14}[0-9]", "[REDACTED_PHONE]"),
)


def redacted(text: Column, kinds=SECRETS) -> Column:
    for _, pattern, new in kinds:
        text = F.regexp_replace(text, pattern, new)
    return text


def has_secret(text: Column) -> Column:
    """Whether any of the patterns of secrets is met; null has none."""
    found = F.lit(False)
    for _, pattern, _ in SECRETS:
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def with_redactions(frame: DataFrame, text: str, kinds=SECRETS) -> DataFrame:
    """Adds n_<kind>, how often each kind matches what the kinds before it have left, and ``redacted``.

    Each step is a column of its own, which the next reads: no pattern runs twice over a text for being named twice.
    """
    frame = frame.withColumn("redacted", F.col(text))
    for name, pattern, new in kinds:
        frame = frame.withColumn(f"n_{name}", F.regexp_count("redacted", F.lit(pattern)).cast("long")).withColumn("redacted", F.regexp_replace("redacted", pattern, new))
    return frame


#: Tags around what a model writes before its answer.
REASONING = ("think", "reasoning", "thought")


def without_reasoning(text: Column) -> Column:
    """Without what stands in tags of reasoning, in either case; one that is not closed goes to the end."""
    for tag in REASONING:
        text = F.regexp_replace(text, rf"(?is)<\s*{tag}\s*>.*?(<\s*/\s*{tag}\s*>|\z)", "")
    return stripped(text)


def lines_kept(text: Column, keep) -> Column:
    """The lines for which keep(line) holds."""
    return F.array_join(F.filter(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), keep), "\n")


def without_leaks(text: Column, markers: list[str]) -> Column:
    """Without the lines that hold a marker of the prompt, in either case."""
    return stripped(lines_kept(text, lambda line: ~F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(F.lower(line), m))))


def sanitized(text: Column, markers: list[str]) -> Column:
    """An answer as it may be shown: without reasoning, Markdown, lines of the prompt and secrets, in this order."""
    return redacted(without_leaks(without_markdown(without_reasoning(text)), markers))


#: Signs of Markdown that make no difference when lines are compared, and those that do at their ends.
SIGNS, ENDS = "*_`#>[](){}|", " :-"


def plain_line(line: Column) -> Column:
    """A line as it is compared: without signs of Markdown, in lower case."""
    words = F.filter(F.split(F.translate(F.lower(line), SIGNS, " " * len(SIGNS)), r"\s+"), lambda w: w != "")
    return F.trim(F.array_join(words, " "), F.lit(ENDS))


def without_chrome(text: Column, chrome: list[str], prefixes: list[str] = (), calls: list[str] = (), most: int = 90) -> Column:
    """Without lines of a page's frame: those that equal one of ``chrome``, begin with one of ``prefixes``, or call for
    action (hold one of ``calls`` in fewer than ``most`` characters). Of lines that repeat the last one kept, the first
    stays, and of blank lines in a row one."""
    own = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    both = F.transform(own, lambda x: F.struct(F.trim(F.regexp_replace(x, r"[ \t]+", " ")).alias("line"), plain_line(x).alias("plain")))
    drop = lambda x: x["plain"].isin(*chrome) | F.coalesce(*[F.when(x["plain"].startswith(p), True) for p in prefixes], *[F.when(has_term(x["plain"], c) & (F.char_length(x["plain"]) < most), True) for c in calls], F.lit(False))
    kept = F.filter(both, lambda x: (x["line"] == "") | ~drop(x))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("last"))

    def step(a: Column, x: Column) -> Column:
        blank, twice = x["line"] == "", x["plain"].eqNullSafe(a["last"])
        lines = F.when(blank & (F.size(a["lines"]) > 0) & (F.element_at(a["lines"], -1) != ""), F.concat(a["lines"], F.array(F.lit("")))).when(blank | twice, a["lines"]).otherwise(F.concat(a["lines"], F.array(x["line"])))
        return F.struct(lines.alias("lines"), F.when(blank, a["last"]).otherwise(x["plain"]).alias("last"))

    return stripped(F.array_join(F.aggregate(kept, start, step, lambda a: a["lines"]), "\n"))


def phrase_count(text: Column, phrase: Column) -> Column:
    """How often a phrase's words stand in a row in the text; occurrences do not overlap."""
    spaced = lambda x: F.concat(F.lit(" "), F.array_join(tokens(x), "  "), F.lit(" "))
    return F.regexp_count(spaced(text), F.concat(F.lit(r"\Q"), spaced(phrase), F.lit(r"\E")))


def expanded_terms(text: Column, stopwords: list[str], expansions: dict[str, list[str]]) -> Column:
    """Terms of a query, in the order in which they are met, each followed by what it expands to: words of more than
    two characters that are no stopwords, or all of these where nothing else is left."""
    raw = tokens(text, "hyphenated", 2)
    content = F.filter(raw, lambda t: ~t.isin(*stopwords))
    table = F.create_map(*[x for k, v in expansions.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]) if expansions else None
    grown = lambda t: F.concat(F.array(t), F.coalesce(table[t], F.array().cast("array<string>"))) if expansions else F.array(t)
    return F.array_distinct(F.flatten(F.transform(F.when(F.size(content) > 0, content).otherwise(raw), grown)))


def joined_capped(parts: Column, most: int, between: str = "\n") -> Column:
    """Texts of an array joined, cut to ``most`` characters."""
    return F.substring(F.array_join(parts, between), 1, most)


def neutral(text: Column, delimiters: list[str]) -> Column:
    """A text in which no delimiter of data can be closed: each is put in square brackets without its signs."""
    for d in delimiters:
        text = F.regexp_replace(text, "(?i)" + "".join(c if c.isalnum() else f"\\{c}" for c in d), "[" + "".join(c for c in d if c.isalnum() or c == "_") + "]")
    return text


def salvaged(text: Column, field: str) -> Column:
    """The text of a field of JSON that may be cut off, stand in a fence or among other words: up to its closing quote,
    or as far as it goes, escapes resolved but for one that is cut off; empty where there is no such field."""
    raw = F.regexp_extract(text, f'(?s)"{field}"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)', 1)
    whole = F.regexp_replace(raw, r"(?<!\\)((?:\\\\)*)\\u[0-9A-Fa-f]{0,3}$", "$1")
    read = F.from_json(F.concat(F.lit('{"v": "'), whole, F.lit('"}')), "v string", {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"})
    return F.coalesce(read["v"], whole)


def sentences(text: Column) -> Column:
    """Lines, cut after . ! or ? and white space; trimmed, without empty ones."""
    marked = F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")  # trim itself would take the place as what to trim


def citations(text: Column) -> Column:
    """Numbers of the markers [n] in a text, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda n: n.cast("bigint"))


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t]*\[[0-9]+\]", ""))


def marker_count(text: Column, markers: list[str]) -> Column:
    """How many words of the text are markers."""
    return F.size(F.filter(tokens(text), lambda t: t.isin(markers)))


def marked_language(text: Column, markers: dict[str, list[str]], suffixes: dict[str, list[str]], default: str = "auto") -> Column:
    """The language with the most words that are its markers, or end in one of its suffixes after three characters or
    more; the first of equals, ``default`` without any."""
    words = tokens(text)

    def told(language: str) -> Column:
        own, ends = markers[language], suffixes.get(language, [])
        ended = lambda t: F.exists(F.array(*[F.lit(x) for x in ends]), lambda x: F.endswith(t, x) & (F.char_length(t) >= F.char_length(x) + 3)) if ends else F.lit(False)
        return F.size(F.filter(words, lambda t: t.isin(own) | ended(t)))

    counts = {k: told(k) for k in markers}
    most = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    return F.when(most == 0, default).otherwise(F.coalesce(*[F.when(n == most, F.lit(k)) for k, n in counts.items()]))


def snippet(text: Column, most: int = 240) -> Column:
    """The text on one line, cut to ``most`` characters with an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.when(F.char_length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("…"))).otherwise(line)


def title(text: Column, stopwords: list[str], words: int = 6, most: int = 40) -> Column:
    """Up to ``words`` content words, each with a capital if it begins with a-z, as many as fit in ``most`` characters."""
    kept = F.slice(F.filter(tokens(text), lambda t: ~t.isin(stopwords)), 1, words)
    grown = F.aggregate(kept, F.lit(""), lambda a, w: F.when(F.char_length(a) + F.char_length(w) + 1 > most, a).otherwise(F.trim(F.concat(a, F.lit(" "), F.concat(F.translate(F.substring(w, 1, 1), string.ascii_lowercase, string.ascii_uppercase), F.substr(w, F.lit(2)))))))
    return grown


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, ``overlap`` of them shared, that cover n words."""
    return F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / (size - overlap)) + 1)


def chunks(words: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of an array of words."""
    return F.transform(F.sequence(F.lit(0), (chunk_count(F.size(words), size, overlap) - 1).cast("int")), lambda i: F.slice(words, i * (size - overlap) + 1, size))
