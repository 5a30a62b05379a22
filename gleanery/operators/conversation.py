"""Conversation state: what a turn knows of the turns before it. Turns are ordered by ``turn`` within ``conv_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.rules import any_term
from gleanery.functions.text import tokens


def _in_order() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn")


def _before() -> Window:
    return _in_order().rowsBetween(Window.unboundedPreceding, -1)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, with their place from the end."""
    return turns.withColumn("from_end", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("from_end") <= n)


def sticky(turns: DataFrame, entity: Column) -> DataFrame:
    """Adds entity, the turn's own or, for a user's turn without one, the latest one a user has named before."""
    named = turns.withColumn("own", F.when(F.col("role") == "user", entity))
    return named.withColumn("entity", F.coalesce("own", F.when(F.col("role") == "user", F.last("own", ignorenulls=True).over(_before())))).drop("own")


def followups(turns: DataFrame, intent: Column, elliptical: Column) -> DataFrame:
    """Users' turns with followup_confidence: .1 for the first turn, .9 if it is elliptical, .8 if its intent is the one
    before, .3 otherwise; followup from .75 on."""
    asked = turns.where(F.col("role") == "user").withColumn("intent", intent)
    before = F.lag("intent").over(_in_order())
    sure = F.when(before.isNull(), 0.1).when(elliptical, 0.9).when(F.col("intent") == before, 0.8).otherwise(0.3)
    scored = asked.withColumn("followup_confidence", sure)
    return scored.withColumn("followup", F.col("followup_confidence") >= 0.75)


def followup_decisions(turns: DataFrame, specific: Sequence[str], strong: Sequence[str], weak: Sequence[str], general: str = "general", threshold: float = 0.75) -> DataFrame:
    """(conv_id, turn, intent, before, confidence, reason, followup, intent_changed) of users' turns (conv_id, turn,
    role, text, intent): whether each goes on from the user's turn before it.

    In this order: without an earlier turn, or without words, 0; another one of the ``specific`` intents, .1, whatever
    its words; a term that leans on what was said before, .9; a weaker one in five words at most of the same or of no
    certain intent, .8; four words at most of such, .78; else .3. It is a follow-up from ``threshold`` on.
    """
    asked = turns.where((F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    asked = asked.withColumn("before", F.lag("intent").over(_in_order()))
    words = tokens(F.col("text"), "unspaced")
    same = (F.col("intent") == general) | (F.col("intent") == F.col("before"))
    other = F.col("intent").isin(*specific) & (F.col("intent") != F.col("before"))
    rung = lambda sure, why: F.struct(F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    told = F.when(F.col("before").isNull(), rung(0.0, "no_history")).when(other, rung(0.1, "other_intent")).when(any_term(F.col("text"), strong), rung(0.9, "leaning"))
    told = told.when(any_term(F.col("text"), weak) & (F.size(words) <= 5) & same, rung(0.8, "short_and_weakly_leaning")).when((F.size(words) <= 4) & same, rung(0.78, "short_of_one_topic")).otherwise(rung(0.3, "uncertain"))
    changed = F.coalesce((F.col("intent") != F.col("before")) & (F.col("intent") != general) & (F.col("before") != general), F.lit(False))
    return asked.withColumn("told", told).select("conv_id", "turn", "intent", "before", "told.*", (F.col("told.confidence") >= threshold).alias("followup"), changed.alias("intent_changed"))


def session_slots(events: DataFrame, slot: Column, resets: Column, idle_seconds: int) -> DataFrame:
    """Adds session (from 0, a new one after more than ``idle_seconds`` without an event) and carried: the latest value
    of the slot in the session since the last reset. events: user_id, event_id, ts."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(by)
    marked = events.withColumn("session", F.sum(F.when(gap > idle_seconds * 1_000_000, 1).otherwise(0)).over(by)).withColumn("_slot", slot)
    epochs = marked.withColumn("_epoch", F.sum(F.when(resets, 1).otherwise(0)).over(Window.partitionBy("user_id", "session").orderBy("ts", "event_id")))
    carried = F.last("_slot", ignorenulls=True).over(Window.partitionBy("user_id", "session", "_epoch").orderBy("ts", "event_id"))
    return epochs.withColumn("carried", carried).drop("_slot", "_epoch")
