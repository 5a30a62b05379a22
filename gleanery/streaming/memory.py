"""What is remembered of sessions: bounded in time and number, on tables and on streams alike.

Sessions are dealt into shards. A shard remembers its latest sessions, so many at most, and none that has been idle for
longer than a bound; with one shard that is one memory for all. A table's shards are streamed through in the order of
time; a stream's are the state of a stateful operator, with event-time timers that forget what is idle.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_TOLD = "event_id long, user_id long, carried string, known boolean"


class Memory:
    """The sessions of a shard, the one that was used longest ago first: of each user the time and the slot."""

    def __init__(self, most: int, micros: int, held: OrderedDict[int, tuple[int, str | None]] | None = None):
        self.most, self.micros, self.held = most, micros, OrderedDict() if held is None else held

    def forget(self, now: int) -> None:
        while self.held and next(iter(self.held.values()))[0] < now - self.micros:
            self.held.popitem(last=False)

    def told(self, user: int, now: int, slot: str | None, resets: bool) -> tuple[str | None, bool]:
        """The slot that is carried, and whether the session was known: a turn's own slot, or else what was remembered,
        unless the turn resets it."""
        self.forget(now)
        before = self.held.pop(user, None)
        carried = slot if slot is not None else None if resets or before is None else before[1]
        self.held[user] = (now, carried)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return carried, before is not None

    def rows(self, frame: pd.DataFrame) -> pd.DataFrame:
        told = [self.told(u, at, None if pd.isna(s) else s, bool(r)) for u, at, s, r in zip(frame["user_id"], frame["at"], frame["slot"], frame["resets"], strict=True)]
        return pd.DataFrame({"event_id": frame["event_id"], "user_id": frame["user_id"], "carried": pd.Series([c for c, _ in told], frame.index, dtype=object), "known": pd.Series([k for _, k in told], frame.index, dtype=bool)})


def _sharded(events: DataFrame, slot: Column, resets: Column, shards: int) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    return events.select(F.pmod(F.xxhash64("user_id"), F.lit(shards)).alias("shard"), "event_id", "user_id", "ts", micros, slot.cast("string").alias("slot"), F.coalesce(resets, F.lit(False)).alias("resets"))


def remembered(events: DataFrame, slot: Column, resets: Column, idle_seconds: int = 1800, most: int = 2000, shards: int = 1) -> DataFrame:
    """(event_id, user_id, carried, known) of events (event_id, user_id, ts): the value of the slot that a turn or an
    earlier one of its session has given, and whether the session was still in memory."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, memory = None, None
        for frame in frames:
            for s, part in frame.groupby("shard", sort=False):
                if s != shard:
                    shard, memory = s, Memory(most, idle_seconds * 1_000_000)
                yield memory.rows(part)

    dealt = _sharded(events, slot, resets, shards).drop("ts")
    return dealt.repartition("shard").sortWithinPartitions("shard", "at", "event_id").mapInPandas(task, _TOLD)


class SessionMemory(StatefulProcessor):
    """remembered() for a stream. The state of a shard is a map of its users: time, order of use, slot."""

    def __init__(self, most: int, idle_seconds: int):
        self.most, self.micros = most, idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("sessions", "user_id long", "at long, place long, slot string")

    def _load(self) -> Memory:
        held = sorted(((v[1], k[0], v[0], v[2]) for k, v in self.state.iterator()))
        return Memory(self.most, self.micros, OrderedDict((user, (at, slot)) for _, user, at, slot in held))

    def _store(self, memory: Memory) -> None:
        self.state.clear()
        for place, (user, (at, slot)) in enumerate(memory.held.items()):
            self.state.updateValue((user,), (at, place, slot))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if memory.held:
            oldest = next(iter(memory.held.values()))[0]
            self.handle.registerTimer((oldest + self.micros) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory = self._load()
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])  # what has come of a shard in one batch
        told = memory.rows(frame)
        self._store(memory)
        yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        memory = self._load()
        memory.forget(timerValues.getCurrentWatermarkInMs() * 1000)
        self._store(memory)
        return iter(())

    def close(self) -> None:
        pass


def remembered_stream(events: DataFrame, slot: Column, resets: Column, lateness: str, idle_seconds: int = 1800, most: int = 2000, shards: int = 1) -> DataFrame:
    """remembered() of a stream whose batches come in the order of time; rows later than ``lateness`` are left out
    (needs the RocksDB state store)."""
    dealt = _sharded(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness), slot, resets, shards)
    return dealt.groupBy("shard").transformWithStateInPandas(SessionMemory(most, idle_seconds), _TOLD, "Append", "eventTime")
