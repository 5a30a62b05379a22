"""Stateful streams against their tables: restarts, bounded memory, passes of a crawl."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from gleanery.streaming import crawl, memory, windows

EVENTS = "event_id long, user_id long, event_type string, s long"


@pytest.fixture(scope="module")
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def events(spark, n=400, users=9, seed=3):
    r = random.Random(seed)
    times = sorted(r.randrange(4000) for _ in range(n))
    rows = [(i, r.randrange(users), r.choice(["view", "click", "signup", "other", "other"]), t) for i, t in enumerate(times)]
    return rows, spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def slot():
    return F.when(F.col("event_type").isin("view", "click"), F.concat("event_type", F.col("event_id").cast("string"))), F.col("event_type") == "signup"


def plain_memory(rows, idle, most):
    held, out = OrderedDict(), {}
    for i, user, kind, t in sorted(rows, key=lambda x: (x[3], x[0])):
        for u in [u for u, (at, _) in held.items() if at < t - idle]:
            del held[u]
        before = held.pop(user, None)
        own = f"{kind}{i}" if kind in ("view", "click") else None if kind == "signup" or before is None else before[1]
        held[user] = (t, own)
        while len(held) > most:
            held.popitem(last=False)
        out[i] = (own, before is not None)
    return out


def test_memory_is_bounded_in_time_and_number(spark):
    rows, frame = events(spark)
    for idle, most in ((120, 100), (10_000, 3), (60, 4)):
        got = {r["event_id"]: (r["carried"], r["known"]) for r in memory.remembered(frame, *slot(), idle, most).collect()}
        assert got == plain_memory(rows, idle, most)


def ran(stream, out, checkpoint, mode="append"):
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def test_a_stream_of_sessions_restarts_where_it_was(rocksdb, tmp_path):
    spark = rocksdb
    rows, frame = events(spark, 240)
    wanted = {r["event_id"]: (r["carried"], r["known"]) for r in memory.remembered(frame, *slot(), 90, 4, shards=2).collect()}
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in range(3):  # each part comes while the query is down
        frame.where(f"event_id >= {part * 80} AND event_id < {part * 80 + 80}").coalesce(1).write.mode("append").parquet(source)
        ran(memory.remembered_stream(spark.readStream.schema(frame.schema).parquet(source), *slot(), "0 seconds", 90, 4, 2), out, checkpoint)
    got = spark.read.parquet(out).collect()
    assert {r["event_id"]: (r["carried"], r["known"]) for r in got} == wanted and len(got) == len(wanted)


def test_a_stream_admits_what_its_table_admits(rocksdb, tmp_path):
    spark = rocksdb
    rows, frame = events(spark, 200, 4, 5)
    wanted = {r["event_id"]: r["admitted"] for r in windows.admitted(frame, 3, 120).collect()}
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in range(2):
        frame.where(f"event_id >= {part * 100} AND event_id < {part * 100 + 100}").coalesce(1).write.mode("append").parquet(source)
        ran(windows.admitted_stream(spark.readStream.schema(frame.schema).parquet(source), 3, 120), out, checkpoint)
    assert {r["event_id"]: r["admitted"] for r in spark.read.parquet(out).collect()} == wanted


LEDGER = "url string, frequency string, content_hash string, last_modified timestamp, last_crawl timestamp, last_changed timestamp, failures int"
FETCHES = "url string, ok boolean, http_status int, new_hash string, last_modified timestamp, error string, at timestamp"


def crawl_tables(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    stamp = lambda c: F.col(c).cast("timestamp")
    ledger = spark.createDataFrame([("a", "daily", "h1", None, day(1), day(1), 0), ("b", "weekly", "h2", None, day(9), None, 2), ("c", "monthly", None, None, None, None, 0), ("d", "daily", "h4", None, day(1), None, 1)], LEDGER.replace("timestamp", "string"))
    rows = [("a", True, 200, "h1x", None, None, day(10)), ("b", True, 200, "zz", None, None, day(10)), ("c", True, 200, "h3", None, None, day(10)), ("d", False, None, None, None, "timeout", day(10))]
    rows += [("a", True, 304, None, None, None, day(12)), ("d", True, 200, "h4", None, None, day(12)), ("b", True, 200, "h2", None, None, day(16)), ("x", True, 200, "h", None, None, day(16)), ("a", None, 404, None, None, None, day(16)), ("a", True, 200, "old", None, None, day(15))]
    fetches = spark.createDataFrame(rows, FETCHES.replace("timestamp", "string"))
    return (f.select(*[stamp(c.name).alias(c.name) if c.name in ("at", "last_modified", "last_crawl", "last_changed") else c.name for c in f.schema.fields]) for f in (ledger, fetches))


def test_a_pass_records_what_fetches_tell(spark):
    ledger, fetches = crawl_tables(spark)
    got = {r["url"]: r for r in crawl.tick(ledger, fetches.where("at = '2024-01-10'"), "2024-01-10 00:00:00").collect()}
    assert {u: (r["outcome"], r["reason"], r["content_hash"], r["failures"]) for u, r in got.items()} == {
        "a": ("reingested", "hash_changed", "h1x", 0),
        "b": (None, None, "h2", 2),  # not due
        "c": ("reingested", "new", "h3", 0),
        "d": ("failed", "timeout", "h4", 2),
    }
    one = crawl.tick(ledger, fetches, "2024-01-10 00:00:00", most=1).where("outcome IS NOT NULL").collect()
    assert [r["url"] for r in one] == ["c"]
    assert crawl.pass_counts(crawl.tick(ledger, fetches, "2024-01-10 00:00:00", "monthly")).collect()[0]["n"] == 1


def test_passes_of_a_stream_survive_a_crash(spark, tmp_path):
    ledger, fetches = crawl_tables(spark)
    source, target, checkpoint = str(tmp_path / "in"), f"file://{tmp_path}/ledger", str(tmp_path / "checkpoint")
    ledger.write.parquet(f"{target}/v-1")
    wanted, days = ledger, ("2024-01-10", "2024-01-12", "2024-01-16")
    for day in days:
        wanted = crawl.tick(wanted.select(*crawl.LEDGER), fetches.where(F.col("at") <= f"{day}").where(F.col("at") > {"2024-01-10": "2024-01-01", "2024-01-12": "2024-01-10", "2024-01-16": "2024-01-12"}[day]), f"{day} 00:00:00")
    crashed = []

    def once_torn(batch, number):
        if number == 1 and not crashed:
            crashed.append(number)
            crawl.ticks(target)(batch, number)
            raise RuntimeError("torn after the pass was written")
        crawl.ticks(target)(batch, number)

    last = "2024-01-01"
    for day in days:
        fetches.where(F.col("at") <= day).where(F.col("at") > last).coalesce(1).write.mode("append").parquet(source)
        last = day
        for _ in range(2):  # the second run finds nothing to do, or does again what was torn
            query = spark.readStream.schema(fetches.schema).parquet(source).writeStream.foreachBatch(once_torn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            try:
                query.awaitTermination(120)
            except Exception as e:
                assert "torn" in str(e)
    assert crashed == [1]
    got = windows.latest(spark, target)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
