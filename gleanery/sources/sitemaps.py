"""Walks over site maps: from robots files and starting maps through the maps that these name, to pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.urls import path
from gleanery.operators.steps import written

_LOCS = "array<struct<loc: string, image: array<struct<loc: string>>>>"
_MAP = f"sitemap {_LOCS}, url {_LOCS}"
_READ = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}


def robots_maps(robots: DataFrame) -> DataFrame:
    """(host, url): the maps that robots files (host, content) name, in lines of ``Sitemap:`` in any case."""
    named = robots.select("host", F.explode(F.split("content", "\r?\n")).alias("line"))
    url = F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap\s*:(.*)$", 1))
    return named.select("host", url.alias("url")).where("url <> ''").distinct()


def entries(maps: DataFrame) -> DataFrame:
    """(map, place, kind, url) of maps (map, content): ``index`` entries name further maps, ``page`` entries pages. What
    is no XML has none; CDATA, entities, and the places of images are read as XML has them."""
    read = maps.select("map", F.from_xml("content", _MAP, _READ).alias("m"))
    flat = lambda of: F.flatten(F.transform(F.coalesce(of, F.array().cast(_LOCS)), lambda u: F.concat(F.array(u["loc"]), F.coalesce(F.transform(u["image"], lambda i: i["loc"]), F.array().cast("array<string>")))))
    told = F.concat(F.transform(flat(F.col("m.sitemap")), lambda u: F.struct(F.lit("index").alias("kind"), F.trim(u).alias("url"))), F.transform(flat(F.col("m.url")), lambda u: F.struct(F.lit("page").alias("kind"), F.trim(u).alias("url"))))
    out = read.select("map", F.posexplode(told).alias("place", "e")).select("map", "place", "e.*")
    # a map may be listed among pages
    return out.where("url <> ''").withColumn("kind", F.when(F.lower(path(F.col("url"))).endswith(".xml"), "index").otherwise(F.col("kind")))


def walk(spark: SparkSession, starts: list[str], read: Callable[[list[str]], DataFrame], in_scope: Callable[[Column], Column], most_maps: int = 100, most_urls: int | None = None) -> DataFrame:
    """(url, map): the pages in scope that a walk from the maps ``starts`` finds, each under the map that named it first.

    ``read`` gives the maps of some URLs as a table (map, content); a map that can't be read has nothing. Maps are read
    level by level, in the order in which they are named, each once, and ``most_maps`` at most, so the driver holds no
    more than their URLs; the pages stay in tables. Of these all are kept, or the first ``most_urls``.
    """
    seen: list[str] = []
    level, found = list(dict.fromkeys(starts)), None
    while level and len(seen) < most_maps:
        now = level[: most_maps - len(seen)]
        order = F.create_map(*[F.lit(x) for i, m in enumerate(now) for x in (m, len(seen) + i)])
        told = entries(read(now)).where(in_scope(F.col("url")))
        told = written(told.select(order[F.col("map")].cast("int").alias("turn"), "map", "place", "kind", "url").where("turn IS NOT NULL"), "sitemap")
        seen += now
        first = told.where("kind = 'index'").where(~F.col("url").isin(seen)).groupBy("url").agg(F.min(F.struct("turn", "place")).alias("at"))
        level = [r["url"] for r in first.orderBy("at").limit(most_maps).collect()]
        found = told if found is None else found.unionByName(told)
    if found is None:
        return spark.createDataFrame([], "url string, map string")
    pages = found.where("kind = 'page'").groupBy("url").agg(F.min(F.struct("turn", "place", "map")).alias("at"))
    return (pages if most_urls is None else pages.orderBy("at").limit(most_urls)).select("url", "at.map")
