"""Files of other kinds as tables: transcripts, site maps, robots rules, lists of URLs, test sets; and paged exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TIME = r"([0-9]{1,2}:)?([0-9]{2}):([0-9]{2})[.,]([0-9]{3})"


def seconds(stamp: Column) -> Column:
    """Seconds of [HH:]MM:SS,mmm; null for anything else."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(stamp, f"^{_TIME}$", i), ":", ""), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(stamp.rlike(f"^{_TIME}$"), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000)


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    """(path, segment_index, start, end, text) of transcripts (path, content) in the forms of WebVTT and SubRip; a file
    without times is one segment for each paragraph."""
    blocks = transcripts.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), r"\n[ \t]*\n")).alias("segment_index", "block"))
    arrow = f"({_TIME})[ \t]*-->[ \t]*({_TIME})"
    timed = blocks.withColumn("start", seconds(F.regexp_extract("block", arrow, 1))).withColumn("end", seconds(F.regexp_extract("block", arrow, 6)))
    text = F.trim(F.regexp_replace(F.regexp_replace("block", rf"(?s)^.*?{arrow}[^\n]*\n?", ""), r"[ \t\n]+", " "))
    out = timed.withColumn("text", text).where((F.col("text") != "") & ~F.col("text").startswith("WEBVTT"))
    return out.select("path", "segment_index", "start", "end", "text")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return transcript_segments(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content")))


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """(path, kind, url) of site maps (path, content): ``index`` entries name further maps, ``page`` entries pages."""
    kind = F.when(F.contains("content", F.lit("<sitemapindex")), "index").otherwise("page")
    found = F.regexp_extract_all("content", F.lit(r"<loc>[ \n\t]*([^< \n\t]+)[ \n\t]*</loc>"), F.lit(1))
    return maps.select("path", kind.alias("kind"), F.explode(found).alias("url")).withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&")))


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, allow, prefix) of robots files (host, status, content) for an agent: those of the groups that name it,
    or of the groups of all agents where none does. Agent lines in a row begin one group. Files that are missing or
    failing allow everything, forbidden ones nothing."""
    lines = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")
    none = F.array().cast("array<struct<own: boolean, rule: string>>")
    start = F.struct(F.lit(False).alias("own"), F.lit(False).alias("all"), F.lit(False).alias("naming"), none.alias("rules"))

    def step(a: Column, x: Column) -> Column:
        names, rules = F.lower(x).rlike("^user-agent *:"), F.lower(x).rlike("^(dis)?allow *:")
        name = F.lower(F.trim(F.regexp_extract(x, ":(.*)$", 1)))
        own, every = (name != "*") & (name != "") & F.contains(F.lit(agent.lower()), name), name == "*"
        ruled = F.when(rules & (a["own"] | a["all"]), F.concat(a["rules"], F.array(F.struct(a["own"].alias("own"), x.alias("rule"))))).otherwise(a["rules"])
        return F.struct(
            F.when(names, own | (a["naming"] & a["own"])).otherwise(a["own"]).alias("own"),
            F.when(names, every | (a["naming"] & a["all"])).otherwise(a["all"]).alias("all"),
            names.alias("naming"),
            ruled.alias("rules"),
        )

    found = F.aggregate(lines, start, step, lambda a: a["rules"])
    chosen = F.when(F.exists(found, lambda r: r["own"]), F.filter(found, lambda r: r["own"])).otherwise(found)
    listed = robots.where("status = 200").select("host", F.explode(F.transform(chosen, lambda r: r["rule"])).alias("rule"))
    prefix = F.trim(F.regexp_extract("rule", ":(.*)$", 1))
    kept = listed.where(prefix != "").select("host", F.lower("rule").startswith("allow").alias("allow"), prefix.alias("prefix"))
    return kept.unionByName(robots.where("status IN (401, 403)").select("host", F.lit(False).alias("allow"), F.lit("/").alias("prefix")))


def permitted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path, ...) with permitted, by the longest prefix among the host's rules; allow wins a tie."""
    listed = rules.groupBy("host").agg(F.collect_list(F.struct(F.char_length("prefix").alias("n"), "allow", "prefix")).alias("_rules"))
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    return urls.join(listed, "host", "left").withColumn("permitted", F.coalesce(best["allow"], F.lit(True))).drop("_rules")


def tool_urls(spark: SparkSession, path: str, cap: int) -> DataFrame:
    """(tool, line_no, url): the first ``cap`` lines of each tool's file of URLs."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[a-z]+$", 1).alias("tool"), F.posexplode(F.split("value", "\n")).alias("line_no", "url"))
    full = lines.where(F.trim("url") != "").withColumn("n", F.row_number().over(Window.partitionBy("tool").orderBy("line_no")))
    return full.where(F.col("n") <= cap).select("tool", "line_no", F.trim("url").alias("url"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A test set of questions in JSON (an array or lines) or CSV, all fields as they are."""
    if path.endswith(".csv"):
        return spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True)
    return spark.read.json(path, multiLine=not path.endswith(".jsonl"))


def seed_links(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of seed files in JSON: arrays of objects with ``url`` or ``link`` and a ``name`` or ``title``."""
    wide = spark.read.schema("url string, link string, name string, title string").json(path, multiLine=True)
    return wide.select(F.coalesce("name", "title").alias("name"), F.trim(F.coalesce("url", "link")).alias("url")).where("url <> ''").distinct()


def table_summary(rows: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """One row: the columns of a sheet and its first rows, by key, told as text."""
    told = F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in rows.columns])
    first = rows.select(F.col(key).alias("_k"), told.alias("t")).orderBy("_k").limit(limit)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "t"))), lambda x: x["t"]), "\n").alias("summary")).withColumn("columns", F.lit(", ".join(rows.columns)))


def export_pages(table: DataFrame, key: str, pages: int, path: str) -> None:
    """Writes a table as gzipped JSON in ranges of its key, a file or more for each."""
    table.repartitionByRange(pages, key).sortWithinPartitions(key).write.mode("overwrite").json(path, compression="gzip")
