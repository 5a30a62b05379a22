"""What the queries share: reading tables, and a registry of each family's queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The reference time of all queries: operators never read the clock.
AS_OF = "2024-02-01 00:00:00"
#: Words without content, in the languages of the sample tables.
STOPWORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "de", "la", "le", "et", "les", "des", "der", "die", "und", "el", "que", "y", "en"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in words) + "]"


def sql_in(words) -> str:
    return "(" + sql_list(words)[1:-1] + ")"


def sql_text(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


class Family:
    """Queries and their SQL, by name."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
