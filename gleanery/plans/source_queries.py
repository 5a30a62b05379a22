"""Queries of page sources and of functions in Arrow batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import fuzzy, registry
from gleanery.functions import text as T
from gleanery.functions.urls import host, host_in
from gleanery.operators import normalizing as Z
from gleanery.plans.common import Family, read
from gleanery.sources import files, html, sitemaps

FAMILY = Family()
query = FAMILY.query


@query("""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS link FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))""")
def html_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("pos", "link"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, array_to_string(regexp_extract_all(html, '<h[123]>([^<]*)</h[123]>', 1), ' | ') AS headings FROM pages")
def html_title_headings(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), F.array_join(html.headings(F.col("html")), " | ").alias("headings"))


_ADDED = ['<html><head><meta property="og:title" content="t', '"><meta name="author" content="x"><script type="application/ld+json">{"@id": ', "}</script><body><p>head  ", '</p><noscript>no</noscript><a href="/a/', '">l</a></body></html>']


@query(f"""SELECT page_id, 't' || page_id AS og, 'x' AS author, '{{"@id": ' || page_id || '}}' AS schema, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/' || page_id AS link, 'head ' || page_id || chr(10) || 'l' AS body FROM pages""")
def html_metadata(spark, sf_dir):
    """Pages made of each page's id, without an end of their head."""
    own = F.col("page_id").cast("string")
    made = F.concat(F.lit(_ADDED[0]), own, F.lit(_ADDED[1]), own, F.lit(_ADDED[2]), own, F.lit(_ADDED[3]), own, F.lit(_ADDED[4]))
    found = html.parsed_pages(read(spark, sf_dir, "pages").withColumn("html", made))
    return found.select("page_id", F.col("open_graph")["og:title"].alias("og"), F.col("meta")["author"].alias("author"), F.col("schema_org")[0].alias("schema"), F.col("links")[0].alias("link"), "body")


@query()
def html_pages(spark, sf_dir):
    found = html.parsed_pages(read(spark, sf_dir, "pages"))
    return found.select("page_id", "title", F.size("meta").alias("n_meta"), "headings", "links", "body")


@query("""SELECT page_id, 0 AS table_index, 'name, n' AS columns, 2 AS n_rows, 'name: p' || page_id || '; n: 1' || chr(10) || 'name: q; n: ' || page_id AS summary FROM pages""")
def udtf_html_tables(spark, sf_dir):
    """The last table of each page, which is added to it."""
    own = F.col("page_id").cast("string")
    table = F.concat(F.lit("<table><tr><th>name</th><th>n</th></tr><tr><td>p"), own, F.lit("</td><td>1</td></tr><tr><td>q</td><td> "), own, F.lit("</td></tr></table>"))
    found = html.tables(read(spark, sf_dir, "pages").withColumn("html", F.concat("html", table)))
    return found.select("page_id", "table_index", F.array_join("columns", ", ").alias("columns"), "n_rows", "summary")


@query("""WITH r AS (SELECT unnest(['a', 'b', 'c', 'd']) AS host, unnest([200, 200, 404, 403]) AS status, unnest([1, 2, 0, 0]) AS kind), p AS (SELECT page_id, ['a', 'b', 'c', 'd'][page_id % 4 + 1] AS host, ['/x/1', '/private/2', '/private/open/3'][page_id % 3 + 1] AS path FROM pages)
SELECT page_id, CASE WHEN status = 403 THEN false WHEN kind = 1 THEN NOT starts_with(path, '/private') OR starts_with(path, '/private/open') WHEN kind = 2 THEN NOT starts_with(path, '/x') ELSE true END AS permitted FROM p JOIN r USING (host)""")
def robots_permitted(spark, sf_dir):
    """Agent lines in a row share their rules; a group that names the agent counts in place of that of all."""
    texts = [("a", 200, "User-agent: *\nUser-agent: other\nDisallow: /private # no\nAllow: /private/open"), ("b", 200, "User-agent: *\nDisallow: /private\n\nUser-agent: gleaner\nDisallow: /x"), ("c", 404, None), ("d", 403, None)]
    rules = files.robots_rules(spark.createDataFrame(texts, "host string, status int, content string"), "gleaner/1.0")
    i = F.col("page_id")
    pick = lambda of, n: F.get(F.array(*[F.lit(x) for x in of]), (i % n).cast("int"))
    urls = read(spark, sf_dir, "pages").select("page_id", pick("abcd", 4).alias("host"), pick(["/x/1", "/private/2", "/private/open/3"], 3).alias("path"))
    return files.permitted(urls, rules).select("page_id", "permitted")


@query()
def udf_difflib_normalize(spark, sf_dir):
    words = fuzzy.corrected(T.tokens(F.col("text")), ["the", "and", "that", "this", "with"], {"teh": "the"})
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("corrected"))


# a page's table of its links, with one inside a cell of each row
_LINKS = """r AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)"""


def _tabled(spark, sf_dir):
    cells = F.transform(html.links(F.col("html")), lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("</td><td><table><tr><td>in</td></tr><tr><td> "), F.char_length(x).cast("string"), F.lit("</td></tr></table></td><td>after</td></tr>")))
    table = F.concat(F.lit("<table><tr><th>link</th><th>inner</th><th>next</th></tr>"), F.array_join(cells, ""), F.lit("</table>"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat("html", table).alias("html"))


@query(f"""WITH {_LINKS} SELECT page_id, 0 AS table_index, 'link, inner, next' AS columns, CAST(len(l) AS INTEGER) AS n_rows, coalesce(array_to_string(list_transform(l[1:25], lambda x: 'link: ' || trim(x) || '; inner: ; next: after'), chr(10)), '') AS summary FROM r
UNION ALL SELECT page_id, CAST(i AS INTEGER), 'in', 1, 'in: ' || length(l[i]) FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM r)""")
def udtf_tables_in_sql(spark, sf_dir):
    """A table function in SQL, beside each row; tables inside tables are their own."""
    registry.register(spark)
    _tabled(spark, sf_dir).createOrReplaceTempView("tabled_pages")
    return spark.sql("SELECT page_id, table_index, array_join(columns, ', ') AS columns, n_rows, summary FROM tabled_pages, LATERAL html_tables(html)")


def _counter():
    """A model of one letter each: how often vowels follow each other."""
    pairs = [a + b for a in "aeiou" for b in "aeiou"]
    return lambda texts: texts.map(lambda t: [float((t or "").count(p)) for p in pairs])


@query("SELECT doc_id, ((length(text) - length(replace(text, 'ae', ''))) / 2)::DOUBLE AS ae, ((length(text) - length(replace(text, 'oi', ''))) / 2)::DOUBLE AS oi FROM documents")
def udf_model_in_sql(spark, sf_dir):
    """A function of SQL whose model each task loads once."""
    registry.register(spark, vowel_pairs=(_counter, "array<double>"))
    read(spark, sf_dir, "documents").createOrReplaceTempView("model_documents")
    return spark.sql("SELECT doc_id, v[1] AS ae, v[17] AS oi FROM (SELECT doc_id, vowel_pairs(text) AS v FROM model_documents)")


# site maps of the pages: an index of four maps, one of them itself, and one that is no XML
_MAPS = """m AS (SELECT page_id, 'https://maps.example.org/m' || (length(html) % 3) || '.xml' AS map, url FROM pages)"""


def _maps(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("https://maps.example.org/m"), (F.char_length("html") % 3).cast("string"), F.lit(".xml")).alias("map"), F.concat(F.lit("<url><loc><![CDATA["), "url", F.lit("]]></loc></url>")).alias("e"), "page_id")
    own = pages.groupBy("map").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "e"))), lambda x: x["e"]), "").alias("e"))
    own = own.select("map", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "e", F.lit("</urlset>")).alias("content"))
    listed = "".join(f"<sitemap><loc>https://maps.example.org/{n}</loc></sitemap>" for n in ("index.xml", "m0.xml", "m1.xml", "none.xml", "torn.xml", "m2.xml"))
    return own.unionByName(spark.createDataFrame([("https://maps.example.org/index.xml", f"<?xml version='1.0'?><sitemapindex>{listed}</sitemapindex>"), ("https://maps.example.org/torn.xml", "<urlset><url><loc>https://a.example.org/</loc>")], "map string, content string"))


@query(f"""WITH {_MAPS} SELECT url, min(map) AS map FROM m WHERE regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '(^|\\.)example\\.(org|net)$') AND NOT regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '\\.xml$') GROUP BY 1""")
def sitemap_walk(spark, sf_dir):
    """Pages in scope by a walk through maps that name each other."""
    maps = _maps(spark, sf_dir)
    in_scope = lambda u: host_in(host(u), "example.org") | host_in(host(u), "example.net")
    return sitemaps.walk(spark, ["https://maps.example.org/index.xml"], lambda urls: maps.where(F.col("map").isin(urls)), in_scope)


#: Common words of the sample, and names among its phrases.
PLAIN = Z.Vocabulary(
    slang={"teh": "the", "wht": "what", "nd": "and"},
    keep=("er", "re", "thon"),
    fillers=("ou", "que"),
    words=("ering", "ation", "their", "which", "erent", "thing", "mention", "ungen", "lich", "schen", "password", "license", "password reset"),
    acronyms=("ing", "ment", "faq"),
    phrases=("apache license", "the nation", "er und", "de la"),
)


def _misspelt(spark, sf_dir):
    """Words of the conversations, and words that they might be meant as: those of the benchmark."""
    longer = lambda table, column: read(spark, sf_dir, table).select(F.explode(T.tokens(F.col("text"))).alias(column)).where(F.length(column) > 3).distinct()
    return longer("conversations", "a"), longer("benchmark", "b")


@query(r"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS a FROM conversations), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS b FROM benchmark),
x AS (SELECT a, c, count(*) AS n FROM (SELECT a, unnest(string_split(a, '')) AS c FROM a WHERE length(a) > 3) GROUP BY 1, 2), y AS (SELECT b, c, count(*) AS n FROM (SELECT b, unnest(string_split(b, '')) AS c FROM b WHERE length(b) > 3) GROUP BY 1, 2)
SELECT a, b FROM x JOIN y USING (c) GROUP BY a, b HAVING 2 * sum(least(x.n, y.n)) >= 0.9 * (length(a) + length(b)) - 1e-9""")
def fuzzy_candidates(spark, sf_dir):
    """Words that may be misspellings of others, by their characters."""
    return Z.alike(*_misspelt(spark, sf_dir), 0.9)


@query()
def normalized_queries(spark, sf_dir):
    """What users ask, in plain words; ratios of matching blocks are beyond SQL, and held against a plain version."""
    asked = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    return Z.normalized_queries(asked, PLAIN)


@query()
def udf_noise_seeded(spark, sf_dir):
    noisy = fuzzy.with_typos(F.col("text"), F.col("item_id").cast("string"), 0.1, "42")
    return read(spark, sf_dir, "benchmark").select("item_id", noisy.alias("noisy"), fuzzy.block_ratio(F.col("text"), noisy).alias("ratio"))


@query()
def udf_slug(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", fuzzy.slug(html.title(F.col("html"))).alias("slug"))


@query("""SELECT event_id, (event_id % 3) * 3600 + (event_id % 60) * 60 + (event_id % 59) + 0.25 AS seconds FROM events""".replace("+ 0.25 AS", "+ 0.25::DOUBLE AS"))
def transcript_times(spark, sf_dir):
    stamp = F.format_string("%02d:%02d:%02d,250", F.col("event_id") % 3, F.col("event_id") % 60, F.col("event_id") % 59)
    return read(spark, sf_dir, "events").select("event_id", files.seconds(stamp).alias("seconds"))
