"""Windows, sessions, rate limits and ledgers over events. The window operators work on tables and on streams alike;
a stream needs a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of event time; with ``lateness`` events later than it are left out."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", lateness) if lateness else events
    counted = events.groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str | None = None) -> DataFrame:
    """(user_id, start, n) by sessions that end after a gap."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", lateness) if lateness else events
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def running_totals(events: DataFrame) -> DataFrame:
    """(event_type, n, mean) so far: a stream gives updates."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def _decide(kept: list[int], now: int, most: int, micros: int) -> bool:
    """Whether one more is admitted; ``kept`` is brought up to date. Only admitted ones are remembered."""
    while kept and kept[0] <= now - micros:
        kept.pop(0)
    if len(kept) < most:
        kept.append(now)
        return True
    return False


def admitted(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """(event_id, user_id, admitted): at most ``most`` admitted events of a user in any ``seconds``.

    Rows come by user in the order of time, and only the admitted times of one window are held: a user's events are
    streamed through, however many they are.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, kept = None, []
        for frame in frames:
            out = []
            for u, at in zip(frame["user_id"], frame["at"], strict=True):
                if u != user:
                    user, kept = u, []
                out.append(_decide(kept, at, most, seconds * 1_000_000))
            yield frame[["event_id", "user_id"]].assign(admitted=out)

    timed = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(task, "event_id long, user_id long, admitted boolean")


class RateLimiter(StatefulProcessor):
    """admitted() for a stream: the admitted times of a user are its state."""

    def __init__(self, most: int, seconds: int):
        self.most, self.micros = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "at long", self.micros // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.kept.get()]
        for frame in rows:
            frame = frame.sort_values(["at", "event_id"])
            yield frame[["event_id", "user_id"]].assign(admitted=[_decide(kept, at, self.most, self.micros) for at in frame["at"]])
        self.kept.put([(at,) for at in kept])

    def close(self) -> None:
        pass


def admitted_stream(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """admitted() of a streaming table, by transformWithState (needs the RocksDB state store)."""
    timed = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy("user_id").transformWithStateInPandas(RateLimiter(most, seconds), "event_id long, user_id long, admitted boolean", "Append", "processingTime")


def merge_batches(target: str, key: str):
    """A foreachBatch sink: folds each batch into the snapshot at ``target``/v<n>, which is written anew beside the old
    one; the latest complete version is the table."""
    from gleanery.operators.ingest import merged

    def write(batch: DataFrame, number: int) -> None:
        before = latest(batch.sparkSession, target, number)
        rows = batch.dropDuplicates([key])
        (rows if before is None else merged(before, rows, key)).write.mode("overwrite").parquet(f"{target}/v{number}")

    return write


def latest(spark, target: str, before: int | None = None) -> DataFrame | None:
    """The latest version of a snapshot that merge_batches() has completed (before a number)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    versions = sorted(int(p.getName()[1:]) for p in done if before is None or int(p.getName()[1:]) < before)
    return spark.read.parquet(f"{target}/v{versions[-1]}") if versions else None
