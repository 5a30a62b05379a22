"""Coverage in one scan, site maps, tables inside tables, functions for SQL, copies by pages."""

import re
import sqlite3
from collections import deque

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.functions import registry
from gleanery.operators import audits, entities
from gleanery.sources import html, sitemaps
from gleanery.sources.paged import PagedSource


def test_coverage_is_one_scan(spark, tmp_path):
    rows = [("a", "x", "One"), ("a", None, "two"), (None, "x", None), ("b", "y", "ONE two")]
    spark.createDataFrame(rows, "k string, m string, t string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    areas = {"first": ["one"], "second": ["two", "zwei"], "third": ["three"]}
    found = audits.coverage(table, {"k": F.col("k"), "m": F.col("m")}, {"null": F.col("t").isNull()}, areas, F.col("t"))
    assert {(r["kind"], r["value"]): r["n"] for r in found.collect()} == {("all", "all"): 4, ("k", "a"): 2, ("k", "b"): 1, ("k", "unknown"): 1, ("m", "x"): 2, ("m", "y"): 1, ("m", "unknown"): 1, ("state", "null"): 1, ("area", "first"): 2, ("area", "second"): 2, ("area", "third"): 0}
    assert audits.missing_areas(found, list(areas)).first()["missing"] == ["third"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan.split("Initial Plan")[0])) == 1
    empty = audits.coverage(table.limit(0), {"k": F.col("k")}, {}, areas, F.col("t"))
    assert {r["n"] for r in empty.collect()} <= {0} and audits.missing_areas(empty, list(areas)).first()["missing"] == list(areas)


MAPS = {
    "https://h.example/index.xml": "<?xml version='1.0'?><sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>https://h.example/a.xml</loc></sitemap><sitemap><loc> https://h.example/index.xml </loc></sitemap><sitemap><loc>https://other.example/x.xml</loc></sitemap><sitemap><loc>https://h.example/b</loc></sitemap><sitemap><loc>https://h.example/torn.xml</loc></sitemap></sitemapindex>",
    "https://h.example/a.xml": "<urlset><url><loc><![CDATA[https://h.example/p?a=1&b=2]]></loc></url><url><loc>https://h.example/q?x=1&amp;y=2</loc></url><url><loc>https://h.example/c.xml</loc></url><url><loc>https://other.example/no</loc></url><url><loc>  </loc></url></urlset>",
    "https://h.example/b": "<urlset><url><loc>https://h.example/q?x=1&amp;y=2</loc></url><url><loc>https://h.example/r</loc></url></urlset>",
    "https://h.example/c.xml": "<urlset><url><loc>https://h.example/s</loc></url><url><loc>https://h.example/a.xml?again</loc></url></urlset>",
    "https://h.example/torn.xml": "<urlset><url><loc>https://h.example/never</loc>",
    "https://other.example/x.xml": "<urlset><url><loc>https://h.example/elsewhere</loc></url></urlset>",
}


def plain_walk(starts, most_maps, most_urls):
    from xml.etree import ElementTree

    queue, seen, urls = deque(starts), [], {}
    while queue and len(seen) < most_maps:
        at = queue.popleft()
        if at in seen:
            continue
        seen.append(at)
        try:
            root = ElementTree.fromstring(MAPS.get(at, "-"))
        except ElementTree.ParseError:
            continue
        for loc in (n.text.strip() for n in root.iter() if n.tag.endswith("loc") and n.text and n.text.strip()):
            if "://h.example/" not in loc:
                continue
            if root.tag.endswith("sitemapindex") or loc.split("?")[0].endswith(".xml"):
                queue.append(loc)
            else:
                urls.setdefault(loc, at)
    return dict(list(urls.items())[:most_urls])


@pytest.mark.parametrize(("most_maps", "most_urls"), [(100, 100), (2, 100), (3, 2), (1, 9)])
def test_site_maps_are_walked_as_a_plain_walk_does(spark, most_maps, most_urls):
    table = spark.createDataFrame(list(MAPS.items()), "map string, content string")
    found = sitemaps.walk(spark, ["https://h.example/index.xml"], lambda urls: table.where(F.col("map").isin(urls)), lambda u: F.contains(u, F.lit("://h.example/")), most_maps, most_urls)
    assert {r["url"]: r["map"] for r in found.collect()} == plain_walk(["https://h.example/index.xml"], most_maps, most_urls)


def test_robots_name_maps(spark):
    robots = spark.createDataFrame([("h", "User-agent: *\r\nSITEMAP : https://h/a.xml\nSitemap:https://h/b.xml\nSitemap:\nDisallow: /x"), ("g", None)], "host string, content string")
    assert {tuple(r) for r in sitemaps.robots_maps(robots).collect()} == {("h", "https://h/a.xml"), ("h", "https://h/b.xml")}


NESTED = "<table><tr><th>a</th><th>b</th></tr><tr><td>1<table><tr><td>in</td></tr><tr><td>ner</td></tr></table></td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table><p>x</p>"


def test_tables_inside_tables_are_their_own(spark):
    pages = spark.createDataFrame([(1, NESTED), (2, None), (3, "<td>no table</td>")], "page_id long, html string")
    wanted = [(1, 0, ["a", "b"], 2, "a: 1; b: 2\na: 3; b: 4"), (1, 1, ["in"], 1, "in: ner")]
    assert sorted(map(tuple, html.tables(pages).collect())) == wanted
    registry.register(spark)
    pages.createOrReplaceTempView("nested_pages")
    assert sorted(map(tuple, spark.sql("SELECT page_id, t.* FROM nested_pages, LATERAL html_tables(html) t").collect())) == wanted
    assert spark.sql("SELECT n_rows, summary FROM nested_pages, LATERAL html_tables(html, 1) WHERE page_id = 1 AND table_index = 0").first()[1] == "a: 1; b: 2"


def test_functions_for_sql(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda s: s.str.len().fillna(-1).astype("int64")

    registry.register(spark, length_by_model=(load, "long"))
    assert spark.sql("SELECT slug('Été à Paris!') AS s, block_ratio('abcd', 'bcde') AS r").first() == ("ete-a-paris", 0.75)
    spark.range(0, 50_000, 1, 2).selectExpr("repeat('x', CAST(id % 7 AS INT)) AS t").createOrReplaceTempView("lengths")
    assert spark.sql("SELECT sum(length_by_model(t)) FROM lengths").first()[0] == sum(i % 7 for i in range(50_000))
    assert loads.value == 2  # once a task, for several batches


@pytest.fixture()
def database(tmp_path):
    at = str(tmp_path / "db.sqlite")
    with sqlite3.connect(at) as c:
        c.execute('CREATE TABLE "from" (id INTEGER PRIMARY KEY, name TEXT)')
        c.executemany('INSERT INTO "from" VALUES (?, ?)', [(i * 3, f"n{i}") for i in range(1234)])
        c.execute("CREATE TABLE target (id INTEGER PRIMARY KEY, name TEXT)")
        c.execute("INSERT INTO target VALUES (3, 'kept')")
    return at


def test_a_copy_that_is_interrupted_and_repeated_has_each_row_once(spark, database, tmp_path):
    spark.dataSource.register(PagedSource)
    read = lambda **o: spark.read.format("paged").schema("id long, name string").options(database=database, table="from", key="id", **o).load()
    rows = read(ranges=4, page=100)
    assert rows.rdd.getNumPartitions() == 4 and sorted(map(tuple, rows.collect())) == [(i * 3, f"n{i}") for i in range(1234)]
    assert read(where="id % 2 = 0").count() == 617 and read(where="id < 0").count() == 0
    torn, mark = tmp_path / "torn", str(tmp_path / "torn")

    def once(frames):
        import os

        for frame in frames:
            yield frame
            if not os.path.exists(mark) and frame["id"].max() >= 3000:
                open(mark, "w").close()
                raise RuntimeError("torn")

    target = {"database": database, "table": "target", "key": "id", "page": "50"}
    copied = rows.coalesce(1).mapInPandas(once, "id long, name string")
    with pytest.raises(Exception, match="torn"):
        copied.write.format("paged").options(**target).mode("append").save()
    assert torn.exists()
    for _ in range(2):
        copied.write.format("paged").options(**target).mode("append").save()
    with sqlite3.connect(database) as c:
        assert c.execute("SELECT count(*), count(DISTINCT id), max(CASE WHEN id = 3 THEN name END) FROM target").fetchone() == (1234, 1234, "kept")
    with pytest.raises(Exception, match="missing"):
        spark.read.format("paged").schema("id long").options(table="t", key="id").load().collect()


def test_entities_by_longest_match_guards_and_order(spark):
    rules = entities.EntityRules(
        lookups=(
            entities.Lookup("faculty", ("dekan", "fakultas", "teknik"), {"teknik": "Fakultas Teknik", "feb": "Fakultas Ekonomi"}, default=2, quiet=("program",)),
            entities.Lookup("program", ("prodi", "kaprodi", "informatika", "akreditasi", "teknik"), {"informatika": "Teknik Informatika"}),
            entities.Lookup("campus", ("lokasi",), {"me": "Mela"}, contains=True, default=1),
        ),
        guards=(("faculty", "program", ("dekan", "fakultas")),),
        demotions=((("biaya",), ()),),
        orders=((("kaprodi",), ("program", "faculty")),),
        order=("faculty", "program"),
    )
    table = spark.createDataFrame([("f1", "faculty", "Fakultas Teknik", "c", 0.9), ("f2", "faculty", "Fakultas Ekonomi", "c", None), ("p1", "program", "Teknik Informatika", "c", 0.9), ("p2", "program", "Teknik", "c", 0.9), ("c1", "campus", "Melati", "c", 0.9), ("c2", "campus", "Bekasi", "c", 0.9)], "entity_id string, kind string, name string, card string, confidence double")
    texts = ["Dekan fakultas?", "Kaprodi Teknik Informatika", "dekan dan kaprodi Teknik Informatika di FEB", "biaya prodi teknik", "lokasi me", "lokasi", "", None, "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {}
    for r in entities.entity_search(rows, table, rules).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["entity_id"], r["score"]))
    assert got == {
        0: [("f1", 10.0), ("f2", 7.0)],
        1: [("p1", 10.0)],
        2: [("p1", 10.0), ("f2", 7.0)],
        3: [("p2", 2.0)],
        4: [("c1", 10.0)],
        5: [("c2", 10.0)],
    }


def test_cards_leave_out_what_has_no_value(spark):
    row = spark.createDataFrame([("A", None, " ", "x")], "a string, b string, c string, d string")
    assert row.select(entities.card({"A": F.col("a"), "B": F.col("b"), "C": F.col("c"), "D": F.col("d")})).first()[0] == "A: A. D: x."


def test_a_walk_keeps_all_pages(spark):
    """More pages than the 100,000 that a walk once kept."""
    from gleanery.sources import sitemaps

    urls = spark.range(100_500).select(F.concat(F.lit("<url><loc>https://a.org/"), F.col("id").cast("string"), F.lit("</loc></url>")).alias("e"))
    made = urls.agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("e"), ""), F.lit("</urlset>")).alias("content")).select(F.lit("https://a.org/m.xml").alias("map"), "content")
    assert sitemaps.walk(spark, ["https://a.org/m.xml"], lambda _: made, lambda u: F.lit(True)).count() == 100_500
    assert sitemaps.walk(spark, ["https://a.org/m.xml"], lambda _: made, lambda u: F.lit(True), most_urls=7).count() == 7


class Taken:
    """A table of pages that gives the function run on its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, task, _):  # noqa: N802
        return task


@pytest.mark.parametrize(("of", "columns"), [(html.parsed_pages, ["page_id", "url", "html"]), (html.tables, ["page_id", "html"])])
def test_a_few_pages_of_a_batch_are_held_at_once(of, columns):
    pages = [{"page_id": i, "url": f"https://h/{i}", "html": f"<title>{i}</title><table><tr><td>a</td></tr></table>"} for i in range(1000)]
    task, whole = of(Taken()), pa.RecordBatch.from_pylist(pages).select(columns)
    told = list(task(iter([whole, whole.slice(0, 0)])))
    assert max(map(len, told)) <= 64 and [i for b in told for i in b.column("page_id").to_pylist()] == list(range(1000))
