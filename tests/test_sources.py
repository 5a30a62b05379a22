"""Files of other kinds as tables, written and read back; streams of running figures and of admitted events."""

import gzip
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleanery.operators import stores
from gleanery.sources import files
from gleanery.streaming import windows


def test_site_maps(spark):
    maps = [("a", "<sitemapindex><sitemap><loc> https://h/b.xml </loc></sitemap></sitemapindex>"), ("b", "<urlset><url><loc>https://h/x?a=1&amp;b=2</loc></url><url><loc>\nhttps://h/y</loc></url></urlset>"), ("c", "")]
    got = files.sitemap_urls(spark.createDataFrame(maps, "path string, content string")).collect()
    assert sorted(map(tuple, got)) == [("a", "index", "https://h/b.xml"), ("b", "page", "https://h/x?a=1&b=2"), ("b", "page", "https://h/y")]


def test_lists_of_urls(spark, tmp_path):
    (tmp_path / "finder.txt").write_text("https://a\n\n https://b \nhttps://c\n")
    (tmp_path / "other.txt").write_text("https://a")
    got = files.tool_urls(spark, f"{tmp_path}/*.txt", 2).collect()
    assert sorted((r["tool"], r["url"]) for r in got) == [("finder", "https://a"), ("finder", "https://b"), ("other", "https://a")]


def test_seeds_and_questions(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps([{"url": "https://a", "name": "A"}, {"link": " https://b ", "title": "B"}, {"name": "none"}, {"url": "https://a", "name": "A"}]))
    assert sorted(map(tuple, files.seed_links(spark, f"{tmp_path}/seed.json").collect())) == [("A", "https://a"), ("B", "https://b")]
    (tmp_path / "q.json").write_text(json.dumps([{"id": 1, "question": "x"}, {"id": 2, "question": "y"}]))
    (tmp_path / "q.jsonl").write_text('{"id": 1, "question": "x"}\n{"id": 2, "question": "y"}\n')
    (tmp_path / "q.csv").write_text('id,question\n1,x\n2,"y ""z""\nnext"\n')
    assert [files.read_questions(spark, f"{tmp_path}/q.{k}").count() for k in ("json", "jsonl", "csv")] == [2, 2, 2]
    assert files.read_questions(spark, f"{tmp_path}/q.csv").where("id = 2").first()["question"] == 'y "z"\nnext'


def test_sheet_and_transcripts(spark, tmp_path):
    sheet = spark.createDataFrame([(i, f"n{i}", None) for i in range(60)], "k int, name string, more string")
    told = files.table_summary(sheet, "k").first()
    assert told["columns"] == "k, name, more" and told["summary"].split("\n")[0] == "k: 0; name: n0" and len(told["summary"].split("\n")) == 50
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhello\n")
    assert [(r["start"], r["text"]) for r in files.read_transcripts(spark, f"{tmp_path}/*.vtt").collect()] == [(1.0, "hello")]


def test_export_in_pages_of_the_key(spark, tmp_path):
    files.export_pages(spark.range(100).withColumn("v", F.lit("x")), "id", 4, f"{tmp_path}/out")
    pages = [[json.loads(x)["id"] for x in gzip.open(p, "rt")] for p in sorted((tmp_path / "out").glob("part-*.json.gz"))]
    assert sum(pages, []) == list(range(100)) and len(pages) == 4


def _stream(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_running_totals_of_a_stream(spark, tmp_path):
    events = _stream(spark, [("a", 1.0), ("a", 3.0), ("b", 5.0)], f"{tmp_path}/in", "event_type string, value double")
    run = windows.running_totals(events).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("totals").collect())) == [("a", 2, 2.0), ("b", 1, 5.0)]


def test_stored_vectors(spark):
    store = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, "p", [0.0, 1.0])], "chunk_id long, profile string, embedding array<double>")
    batch = spark.createDataFrame([(1, "p", [0.5, 0.5], 1), (1, "p", [0.6, 0.4], 2), (2, "p", [1.0], 3), (3, "p", [float("nan"), 1.0], 1), (4, "q", None, 1)], "chunk_id long, profile string, embedding array<double>, version int")
    assert {r["chunk_id"]: r["problem"] for r in stores.validated_vectors(batch, 2).where("version <> 1").collect()} == {1: None, 2: "dimension"}
    assert sorted((r["chunk_id"], r["embedding"]) for r in stores.stored_vectors(store, batch, 2).collect()) == [(1, [0.6, 0.4]), (2, [0.0, 1.0])]
    chunks = spark.createDataFrame([(1, "one"), (9, "nine")], "chunk_id long, chunk_text string")
    made = stores.backfilled(chunks, store, {"profile": "p"}, lambda text: F.array(F.char_length(text).cast("double"), F.lit(0.0)))
    assert [tuple(r) for r in made.collect()] == [(9, "p", [4.0, 0.0])]


def test_times_of_http(spark):
    at = datetime(2024, 2, 29, 12, 30, 5)
    rows = spark.createDataFrame([(at,), (at + timedelta(days=200),)], "at timestamp").withColumn("text", stores.http_date(F.col("at")))
    assert rows.first()["text"] == "Thu, 29 Feb 2024 12:30:05 GMT" and rows.where(stores.from_http_date(F.col("text")) == F.col("at")).count() == 2
    assert spark.range(1).select(stores.from_http_date(F.lit("soon"))).first()[0] is None
