"""Tables that are written between the steps of an iteration, or as an index."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see. A folder of this machine's is taken only on a
    ``local`` master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settled(frame: DataFrame) -> DataFrame:
    """``frame`` as a reliable checkpoint in the shared folder: later steps read it, whichever executor is lost."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


_owners: list[list[str]] = []


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were written inside by ``written``; what is read from them is to be written
    elsewhere before."""
    made: list[str] = []
    _owners.append(made)
    try:
        yield
    finally:
        _owners.remove(made)
        for at in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as Parquet in the shared folder, read back: unlike a checkpoint, its columns and filters are pushed
    down to the files."""
    at = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for made in _owners:
        made.append(at)
    frame.write.parquet(at)
    return frame.sparkSession.read.schema(frame.schema).parquet(at)
