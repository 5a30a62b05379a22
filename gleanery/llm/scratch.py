"""Tables that an operator writes between its steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local temporary one only on a ``local`` master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='gleanery-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_owners: list[list[str]] = []


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Frees, at its end, all tables that operators have written inside. A result is read from such tables, so it is to
    be written before: ``with freed(spark): operator(docs).write.parquet(path)``."""
    made: list[str] = []
    _owners.append(made)
    try:
        yield
    finally:
        _owners.remove(made)
        for root in made:
            _delete(spark, root)


class Scratch:
    """Written tables of one run of one operator. ``drop`` frees a table once later steps no longer read it; what a
    result reads is freed by the caller, with ``freed``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        for made in _owners:
            made.append(self.root)

    def keep(self, frame: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Write ``frame`` and read it back: later steps restart from files, whichever executor is lost. ``batch``: rows
        of an Arrow batch at most while it is written, where Python tasks take whole texts."""
        at, conf = f"{self.root}/{name}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(conf)
        if batch is not None:
            self.spark.conf.set(conf, str(min(batch, int(before)) if int(before) > 0 else batch))
        try:
            frame.write.mode("overwrite").parquet(at)
        finally:
            self.spark.conf.set(conf, before)
        return self.spark.read.schema(frame.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
