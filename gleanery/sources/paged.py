"""Tables of a database, read and written page by page.

``spark.dataSource.register(PagedSource)`` makes the format ``paged`` known. It reads a table in ranges of its key, each
a task that pages through its range (``key > last ORDER BY key LIMIT n``), so that no page depends on how many were
before it. It writes in batches that pass over rows whose key is there already: a task or a copy that is done again
after it was interrupted adds each row once.

Options: ``database`` and ``driver`` (a module with the DB-API's connect(), sqlite3 by default), ``table``, ``key``,
``ranges`` (tasks of a read), ``page`` (rows of a page or batch, 500 by default), ``where`` (a condition for what is
read). The schema is given by the reader.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Table:
    def __init__(self, options: dict, schema: StructType):
        self.options = dict(options)
        missing = [k for k in ("database", "table", "key") if k not in options]
        if missing:
            raise ValueError(f"options that are missing: {', '.join(missing)}")
        self.columns = [f.name for f in schema.fields]
        if options["key"] not in self.columns:
            raise ValueError(f"the schema lacks the key {options['key']}")
        self.table, self.key = _quoted(options["table"]), _quoted(options["key"])
        self.place = self.columns.index(options["key"])
        self.page = int(options.get("page", 500))
        self.where = f"({options['where']})" if options.get("where") else "1 = 1"

    def connect(self):
        return importlib.import_module(self.options.get("driver", "sqlite3")).connect(self.options["database"])


class Range(InputPartition):
    """Keys above ``low`` (all if null) up to ``high``."""

    def __init__(self, low, high):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(_Table, DataSourceReader):
    def partitions(self) -> list[Range]:
        ranges, rows = max(1, int(self.options.get("ranges", 8))), f"FROM {self.table} WHERE {self.where} AND {self.key} IS NOT NULL"
        connection = self.connect()
        try:
            n = connection.execute(f"SELECT count(*) {rows}").fetchone()[0]
            ends = sorted({-(-n * (i + 1) // ranges) for i in range(ranges)} - {0})
            highs = [connection.execute(f"SELECT {self.key} {rows} ORDER BY {self.key} LIMIT 1 OFFSET {e - 1}").fetchone()[0] for e in ends]
        finally:
            connection.close()
        return [Range(low, high) for low, high in zip([None, *highs], highs, strict=False)] or [Range(None, None)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.high is None:  # there are no rows
            return
        listed, last = ", ".join(map(_quoted, self.columns)), partition.low
        connection = self.connect()
        try:
            while True:
                above, known = ("", []) if last is None else (f"AND {self.key} > ?", [last])
                page = connection.execute(f"SELECT {listed} FROM {self.table} WHERE {self.where} {above} AND {self.key} <= ? ORDER BY {self.key} LIMIT {self.page}", [*known, partition.high]).fetchall()
                yield from map(tuple, page)
                if len(page) < self.page:
                    return
                last = page[-1][self.place]
        finally:
            connection.close()


class _Written(WriterCommitMessage):
    def __init__(self, rows: int):
        self.rows = rows


class _Writer(_Table, DataSourceWriter):
    def write(self, iterator: Iterator[Row]) -> _Written:
        listed, places = ", ".join(map(_quoted, self.columns)), ", ".join("?" for _ in self.columns)
        insert = f"INSERT INTO {self.table} ({listed}) VALUES ({places}) ON CONFLICT ({self.key}) DO NOTHING"
        connection, n, batch = self.connect(), 0, []

        def stored() -> None:
            connection.executemany(insert, batch)
            connection.commit()
            batch.clear()

        try:
            for row in iterator:
                batch.append(tuple(row))
                n += 1
                if len(batch) >= self.page:
                    stored()
            stored()
        finally:
            connection.close()
        return _Written(n)

    def commit(self, messages: list[_Written]) -> None:
        """Every batch is committed as it is stored."""

    def abort(self, messages: list[_Written]) -> None:
        """What is stored stays: a repeated copy passes over it."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("rows are added to a table, which is not overwritten")
        return _Writer(self.options, schema)
