"""Passes of a crawl over a ledger: which pages are due, what their fetches have told, what is recorded of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.ingest import detected_change, is_due
from gleanery.streaming.windows import latest

#: Columns of a ledger.
LEDGER = ("url", "frequency", "content_hash", "last_modified", "last_crawl", "last_changed", "failures")


def tick(ledger: DataFrame, fetches: DataFrame, as_of: str, frequency: str | None = None, most: int | None = None) -> DataFrame:
    """The ledger (LEDGER) after one pass, with outcome and reason of each page that was due and fetched, null for others.

    Due are pages of ``frequency``, or of any, that were never crawled or not for their time, the longest waiting first
    where ``most`` bounds them. fetches: url, ok, http_status, new_hash, last_modified, error, at; the last one of a page
    counts. A fetch fails, or finds the page unmodified (304, or no content), changed (it is to be ingested again) or
    unchanged. A page that fails keeps its hash; whatever is fetched has been crawled.
    """
    due = ledger.where(is_due(F.col("last_crawl"), F.col("frequency"), as_of))
    due = due.where(F.col("frequency") == frequency) if frequency is not None else due
    if most is not None:
        due = due.orderBy(F.col("last_crawl").asc_nulls_first(), "url").limit(most)
    told = fetches.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("at"), F.col("new_hash").desc_nulls_last()))).where("n = 1")
    told = told.select("url", F.coalesce("ok", F.lit(False)).alias("ok"), "http_status", "new_hash", F.col("last_modified").alias("new_modified"), "error")
    met = ledger.join(due.select("url", F.lit(True).alias("due")), "url", "left").join(told, "url", "left")
    tried = F.coalesce(F.col("due") & F.col("ok").isNotNull(), F.lit(False))
    same = (F.col("http_status") == 304) | F.col("new_hash").isNull()
    kind = detected_change(F.col("content_hash"), F.col("new_hash"), F.col("last_modified"), F.col("new_modified"))
    outcome = F.when(~tried, None).when(~F.col("ok"), "failed").when(same, "skipped").when(kind == "unchanged", "skipped").otherwise("reingested")
    reason = F.when(~tried, None).when(~F.col("ok"), F.coalesce("error", F.concat(F.lit("http_"), F.col("http_status").cast("string")), F.lit("unknown"))).when(same, "not_modified").otherwise(kind)
    met = met.withColumn("outcome", outcome).withColumn("reason", reason).withColumn("now", F.lit(as_of).cast("timestamp"))
    read = (F.col("outcome") != "failed") & ~same
    return met.select(
        "url",
        "frequency",
        F.when(read, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(read, F.coalesce("new_modified", "last_modified")).otherwise(F.col("last_modified")).alias("last_modified"),
        F.when(tried, F.col("now")).otherwise(F.col("last_crawl").cast("timestamp")).alias("last_crawl"),
        F.when(F.col("outcome") == "reingested", F.col("now")).otherwise(F.col("last_changed").cast("timestamp")).alias("last_changed"),
        F.when(F.col("outcome") == "failed", F.coalesce("failures", F.lit(0)) + 1).when(tried, 0).otherwise(F.coalesce("failures", F.lit(0))).alias("failures"),
        "outcome",
        "reason",
    )


def pass_counts(passed: DataFrame) -> DataFrame:
    """(frequency, outcome, reason, n) of the pages of a pass that were due and fetched."""
    return passed.where("outcome IS NOT NULL").groupBy("frequency", "outcome", "reason").agg(F.count("*").alias("n"))


def ticks(target: str):
    """A foreachBatch sink of fetches: a batch is a pass at its latest time. ``target``/v<n> is the ledger after pass n
    with its outcomes, and v-1 the ledger at the start. A pass that is done again starts from the same ledger and is
    written anew, so that an interrupted one leaves nothing behind."""

    def write(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.date_format(F.max(F.col("at").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")).first()[0]
        before = latest(batch.sparkSession, target, number)
        if before is None:
            raise ValueError(f"no ledger at {target}/v-1")
        if now is not None:
            tick(before.select(*LEDGER), batch, now).write.mode("overwrite").parquet(f"{target}/v{number}")

    return write
