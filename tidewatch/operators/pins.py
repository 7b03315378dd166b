"""Standing rows: what is still live, and what stays pinned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.keys import days_until


def live_ids(previous: DataFrame, new: DataFrame, checked: DataFrame) -> DataFrame:
    """source_id, change_id: of checked sources what the new snapshot has, of others what the previous had."""
    now = new.select("source_id", "change_id").join(checked, "source_id", "left_semi")
    then = previous.select("source_id", "change_id").join(checked, "source_id", "left_anti")
    return now.unionByName(then).distinct()


def refreshed(pins: DataFrame, fresh: DataFrame, live: DataFrame, checked: DataFrame, today: Column) -> DataFrame:
    """The pins of today: old and fresh ones, first_pinned kept and last_seen moved.

    A pin retires only if its source was checked and no longer lists it, or its deadline passed.
    """
    old = pins.join(checked.withColumn("was_checked", F.lit(True)), "source_id", "left").join(live.withColumn("lives", F.lit(True)), ["source_id", "change_id"], "left")
    gone = F.coalesce("was_checked", F.lit(False)) & F.col("lives").isNull()
    past = F.coalesce(days_until(F.col("deadline"), today) < 0, F.lit(False))
    kept = old.where(~gone & ~past).select("change_id", "source_id", "company", "position", "deadline", "first_pinned", F.when(F.col("lives"), today.cast("string")).otherwise(F.col("last_seen")).alias("last_seen"), F.lit(0).alias("age"))
    new = fresh.where(~past).select("change_id", "source_id", "company", "position", "deadline", today.cast("string").alias("first_pinned"), today.cast("string").alias("last_seen"), F.lit(1).alias("age"))
    by = kept.unionByName(new).groupBy("change_id")
    latest = lambda c: F.max_by(c, "age").alias(c)
    return by.agg(latest("source_id"), latest("company"), latest("position"), latest("deadline"), F.min("first_pinned").alias("first_pinned"), F.max("last_seen").alias("last_seen"))


def pin_order() -> list[Column]:
    return [F.col("first_pinned").asc(), F.lower("company").asc(), F.lower("position").asc()]
