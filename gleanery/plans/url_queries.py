"""Queries of URL functions."""

from __future__ import annotations


from pyspark.sql import functions as F

from gleanery.functions import urls as U
from gleanery.plans.common import Family, read, sql_in, sql_list

FAMILY = Family()
query = FAMILY.query
ROOTS = ["example.com", "example.net"]

# every page's URL, some made odd: escapes, ports, users, doubled slashes, repeated and tracking parameters, archives
_ODD = {
    0: "/%61dmin/x", 1: "//a///b/?source=2&utm_id=3&REF=x+y", 2: ":443/Berita/;p=1?b=%2A~&a&fbclid=1#frag", 3: "/x?action=yith-woocompare-add-product&id=398", 4: "/author/private/.git", 5: "/style.CSS?v=1", 6: "/", 7: ":8080/a%20b/?q=%zz",
}
_BASE = r"regexp_replace(url, '^([a-z]+://[^/?#]*).*$', '\1')"
_VARIED = f"SELECT page_id, CASE page_id % 10 {' '.join(f'WHEN {i} THEN {_BASE} || ' + chr(39) + odd + chr(39) for i, odd in _ODD.items())} WHEN 8 THEN 'https://web.archive.org/web/20200101000000/' || url ELSE url END AS url FROM pages UNION ALL SELECT -page_id - 1, url FROM pages"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
_AUTHORITY = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_HOST = f"regexp_extract({_AUTHORITY}, '^(?:.*@)?([^:]*)', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"


def _sql_parts(table: str = "pages") -> str:
    return f"SELECT page_id, url, {_SCHEME} AS scheme, {_AUTHORITY} AS authority, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM {table}"


def _sql_normal(table: str = "pages") -> str:
    key = lambda p: f"url_decode(replace(regexp_extract({p}, '^([^=]*)', 1), '+', ' '))"
    value = lambda p: f"url_decode(replace(regexp_extract({p}, '^[^=]*=(.*)$', 1), '+', ' '))"
    form = lambda x: f"replace(url_encode({x}), '%20', '+')"
    pairs = f"list_transform(list_filter(string_split(query, '&'), lambda p: p <> '' AND lower({key('p')}) NOT IN {sql_in(U.TRACKING)}), lambda p: {form(key('p'))} || '=' || {form(value('p'))})"
    plain = "regexp_replace(CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, ';[^/]*$', '') END, '/{2,}', '/', 'g')"
    return f"""SELECT *, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
|| CASE WHEN plain = '/' THEN '/' ELSE rtrim(plain, '/') END || CASE WHEN rest = '' THEN '' ELSE '?' || rest END AS normalized
FROM (SELECT *, regexp_extract(authority, ':([0-9]+)$', 1) AS port, {plain} AS plain, array_to_string({pairs}, '&') AS rest FROM ({_sql_parts(table)}))"""


_PARTS, _NORMAL = _sql_parts(), _sql_normal()


def _varied(spark, sf_dir):
    """The URLs of all pages, odd forms in place of most, and again (under negative ids) as they are."""
    base = F.regexp_replace("url", "^([a-z]+://[^/?#]*).*$", "$1")
    url = F.coalesce(*[F.when(F.col("page_id") % 10 == i, F.concat(base, F.lit(odd))) for i, odd in _ODD.items()], F.when(F.col("page_id") % 10 == 8, F.concat(F.lit("https://web.archive.org/web/20200101000000/"), "url")), "url")
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", url.alias("url")).unionByName(pages.select((-F.col("page_id") - 1).alias("page_id"), "url"))


@query(f"SELECT page_id, normalized FROM ({_sql_normal(f'({_VARIED})')})")
def url_normalize(spark, sf_dir):
    return _varied(spark, sf_dir).select("page_id", U.normalized_url(F.col("url")).alias("normalized"))


def _sql_scope(table: str) -> str:
    inside = " OR ".join(f"host = '{r}' OR host LIKE '%.{r}'" for r in ROOTS)
    where = "lower(url_decode(CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END))"
    sensitive = f"len(list_filter({sql_list(U.SENSITIVE)}, lambda p: contains({where}, p))) > 0"
    stateful = f"len(list_filter(string_split(query, '&'), lambda p: p <> '' AND (lower(url_decode(regexp_extract(p, '^([^=]*)', 1))) IN {sql_in(U.STATEFUL_KEYS)} OR regexp_matches(lower(url_decode(regexp_extract(p, '^[^=]*=(.*)$', 1))), '{'|'.join(U.STATEFUL_VALUES)}')))) > 0"
    asset = f"len(list_filter({sql_list(U.ASSETS)}, lambda p: ends_with(lower(url_decode(path)), p))) > 0"
    return f"""SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN NOT ({inside}) THEN 'outside_allowed_domain' WHEN {sensitive} THEN 'sensitive_or_private_path'
WHEN {stateful} THEN 'stateful_or_transactional_url' WHEN {asset} THEN 'non_knowledge_asset' ELSE 'allowed' END AS decision FROM ({_sql_parts(table)})"""


@query(f"SELECT decision, count(*) AS n FROM ({_sql_scope(f'({_VARIED})')}) GROUP BY decision")
def url_scope_decision(spark, sf_dir):
    return _varied(spark, sf_dir).groupBy(U.scope_decision(F.col("url"), ROOTS).alias("decision")).agg(F.count("*").alias("n"))


@query(_sql_scope(f"({_VARIED})"))
def url_scope_partition(spark, sf_dir):
    """Each URL with the reason for which it is in or out."""
    return _varied(spark, sf_dir).select("page_id", U.scope_decision(F.col("url"), ROOTS).alias("decision"))


@query(f"""WITH n AS (SELECT page_id, url AS archived, host, regexp_extract(url, '/web/[0-9]+[a-z_]*?/(https?://.+)$', 1) AS url FROM ({_sql_parts(f'({_VARIED})')}))
SELECT page_id, CASE WHEN n.host IN ('web.archive.org', 'archive.org') AND n.url <> '' THEN m.normalized ELSE archived END AS live FROM n LEFT JOIN ({_sql_normal()}) m USING (page_id)""")
def url_archive_live(spark, sf_dir):
    return _varied(spark, sf_dir).select("page_id", U.live_candidate(F.col("url")).alias("live"))


@query(f"""SELECT page_id, CASE WHEN starts_with(n, 'https://www.example.com') THEN 'https://example.com' || substr(n, 24) ELSE n END AS canonical FROM (
SELECT page_id, regexp_replace(regexp_replace(normalized, '^http:', 'https:'), '^(https://[^/:?]*):(80|443)([/?]|$)', '\\1\\3') AS n FROM ({_sql_normal(f'({_VARIED})')}))""")
def url_canonical(spark, sf_dir):
    return _varied(spark, sf_dir).select("page_id", U.canonical_url(F.col("url"), "example.com").alias("canonical"))


@query(f"SELECT normalized, min(page_id) AS page_id, count(*) AS n FROM ({_NORMAL}) GROUP BY normalized")
def url_dedup(spark, sf_dir):
    """The first page of each canonical URL: an aggregate, so that no window sorts whole pages."""
    return read(spark, sf_dir, "pages").groupBy(U.normalized_url(F.col("url")).alias("normalized")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


#: Authority of hosts by their label below a root.
TIERS = {"": 0.9, "www": 0.85, "m": 0.5, "blog": 0.45}


@query(f"""SELECT host, label, CASE WHEN NOT inside THEN 0.0 {' '.join(f"WHEN label = '{k}' THEN {v}" for k, v in TIERS.items())} ELSE 0.25 END::DOUBLE AS authority, n FROM (
SELECT host, host LIKE '%.example.com' OR host = 'example.com' AS inside, CASE WHEN host LIKE '%.example.com' THEN string_split(left(host, length(host) - 12), '.')[-1] ELSE '' END AS label, count(*) AS n FROM ({_PARTS}) GROUP BY 1, 2, 3)""")
def url_host_authority(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    label = U.host_label(F.col("host"), "example.com")
    tier = F.when(~U.host_in(F.col("host"), "example.com"), 0.0)
    for name, value in TIERS.items():
        tier = tier.when(label == name, value)
    return hosts.select("host", label.alias("label"), tier.otherwise(0.25).alias("authority"), "n")


@query(f"""SELECT page_id, trust_class, CASE trust_class WHEN 'official' THEN 1.0 WHEN 'partner' THEN 0.7 WHEN 'unsafe' THEN 0.0 ELSE 0.4 END::DOUBLE AS trust FROM (
SELECT page_id, CASE WHEN contains(host, 'pills') THEN 'unsafe' WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'official' WHEN host LIKE '%.example.org' THEN 'partner' ELSE 'public' END AS trust_class FROM ({_PARTS}))""")
def url_source_trust(spark, sf_dir):
    host = U.host(F.col("url"))
    kind = U.first_reason((F.contains(host, F.lit("pills")), "unsafe"), (U.host_in(host, "example.com"), "official"), (host.endswith(".example.org"), "partner"), default="public")
    rated = read(spark, sf_dir, "pages").select("page_id", kind.alias("trust_class"))
    return rated.withColumn("trust", F.when(F.col("trust_class") == "official", 1.0).when(F.col("trust_class") == "partner", 0.7).when(F.col("trust_class") == "unsafe", 0.0).otherwise(0.4))


_TYPED = f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.png?x=1' WHEN 2 THEN '/article/download/7' WHEN 3 THEN '/c.html' ELSE '/c' END AS tail, CASE WHEN page_id % 3 = 0 THEN 'text/html; charset=utf-8' WHEN page_id % 3 = 1 THEN 'image/webp' END AS mime FROM pages"""


@query(f"""WITH t AS (SELECT *, map_from_entries([{', '.join(f"('{k}', '{v}')" for k, v in U.BY_SUFFIX.items())}])[lower(regexp_extract(regexp_replace(tail, '[?].*$', ''), '\\.([A-Za-z0-9]+)$', 1))] AS by_suffix, contains(tail, '/article/download/') AS down,
CASE {' '.join(f"WHEN starts_with(lower(mime), '{k}') THEN '{v}'" for k, v in U.BY_MIME.items())} END AS by_mime FROM ({_TYPED}))
SELECT page_id, coalesce(by_suffix, CASE WHEN down THEN 'pdf' END, by_mime, 'unknown') AS kind, CASE WHEN by_suffix IS NOT NULL THEN 0.95 WHEN down THEN 0.7 WHEN by_mime IS NOT NULL THEN 0.85 ELSE 0.1 END::DOUBLE AS confidence FROM t""")
def url_source_type(spark, sf_dir):
    tail = F.coalesce(*[F.when(F.col("page_id") % 5 == i, F.lit(t)) for i, t in enumerate(("/a.PDF", "/b.png?x=1", "/article/download/7", "/c.html", "/c"))])
    mime = F.when(F.col("page_id") % 3 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 1, "image/webp")
    kind, sure = U.source_type(F.concat(F.regexp_replace("url", "^([a-z]+://[^/?#]*).*$", "$1"), tail), mime)
    return read(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), sure.alias("confidence"))


@query(f"""SELECT page_id, CASE WHEN host = '' THEN '?' WHEN NOT ends_with(host, 'example.com') THEN host WHEN label IN ('', 'www') THEN '@' ELSE label END AS subdomain FROM (
SELECT page_id, host, string_split(rtrim(left(host, greatest(length(host) - 11, 0)), '.'), '.')[-1] AS label FROM ({_sql_parts(f'({_VARIED})')}))""")
def url_subdomains(spark, sf_dir):
    return _varied(spark, sf_dir).select("page_id", U.subdomain(U.host(F.col("url")), "example.com").alias("subdomain"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'see ' || url || ' or [this](' || url || ').' ELSE 'see or this.' END AS shown FROM pages""")
def url_scrubbed(spark, sf_dir):
    """Answers that cite pages, half of which are known."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    told = F.concat(F.lit("see "), "url", F.lit(" or [this]("), "url", F.lit(")."))
    verified = F.when(F.col("page_id") % 2 == 0, F.array(U.normalized_url(F.col("url")))).otherwise(F.array(F.lit("https://other.example/")))
    return pages.select("page_id", U.scrubbed(told, verified).alias("shown"))
