"""Functions of the library for SQL, and functions that load a model once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from gleanery.functions import fuzzy
from gleanery.sources.html import TABLE, TablesOf


def model_udf(load: Callable[[], Callable[[pd.Series], pd.Series]], kind: str):
    """A function of a column by a model: ``load`` is called once in each task, and what it gives is called for each
    batch of the column."""

    def applied(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return F.pandas_udf(applied, kind)


def register(spark: SparkSession, **models: tuple[Callable[[], Callable[[pd.Series], pd.Series]], str]) -> None:
    """Makes functions known to SQL: html_tables(html, rows), a table function for LATERAL joins, slug(text),
    block_ratio(a, b), and for each of ``models`` (load, kind) one of its name."""
    spark.udtf.register("html_tables", udtf(TablesOf, returnType=TABLE))
    spark.udf.register("slug", F.pandas_udf(fuzzy.slugs, "string"))
    spark.udf.register("block_ratio", F.pandas_udf(fuzzy.ratios, "double"))
    for name, (load, kind) in models.items():
        spark.udf.register(name, model_udf(load, kind))
