"""Judgments of a paid judge: reading them, joining them, their cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import clipped, unstated

SCHEMA = "relevant boolean, why string, confidence string, class_year string, location string, deadline string, employer_size string, bad string"
# The sizes of an employer that a judge may state.
SIZES = ("small", "large")


def parsed(rows: DataFrame, body: str = "body") -> DataFrame:
    """Typed judgment columns from JSON text: unreadable is an error, missing fields take defaults."""
    j = F.from_json(body, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    read = rows.withColumn("j", j)
    broken = F.col(body).isNull() | F.col("j").isNull() | F.col("j.bad").isNotNull()
    size = F.lower(unstated(F.coalesce("j.employer_size", F.lit(""))))
    return read.select(
        *rows.columns,
        F.when(broken, "error").otherwise("model").alias("outcome"),
        F.coalesce("j.relevant", F.lit(True)).alias("relevant"),
        F.coalesce(F.lower("j.confidence"), F.lit("low")).alias("confidence"),
        F.coalesce("j.why", F.lit("")).alias("why"),
        unstated(F.coalesce("j.deadline", F.lit(""))).alias("deadline"),
        unstated(F.coalesce("j.class_year", F.lit(""))).alias("class_year"),
        F.when(size.isin(*SIZES), size).otherwise("").alias("employer_size"),
    )


def cost(tokens_in: Column, cached: Column, tokens_out: Column, rate_in: Column, rate_out: Column, cached_share: float = 0.1) -> Column:
    """Price by rates per million tokens; cached input at a tenth; null without a rate."""
    return ((tokens_in - cached + cached * cached_share) * rate_in + tokens_out * rate_out) / 1e6


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """By model: calls, tokens, unreported calls (not counted as zero) and cost; null cost for an unpriced model."""
    by = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("tokens_in").isNull()).alias("unreported"), *[F.sum(c).alias(c) for c in ("tokens_in", "cached", "tokens_out")])
    return by.join(prices, "model", "left").withColumn("cost", cost(F.col("tokens_in"), F.coalesce("cached", F.lit(0)), F.col("tokens_out"), F.col("rate_in"), F.col("rate_out")))


def joined(changes: DataFrame, verdicts: DataFrame, judgments: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Each change with one outcome: screened by a rule, judged, in error, over budget, or unclassified."""
    out = changes.join(verdicts.select("change_id", "rule", "quote"), "change_id", "left").join(judgments.select("change_id", F.col("outcome").alias("said"), "relevant", "confidence"), "change_id", "left")
    beyond = F.lit(False)
    if over is not None:
        out = out.join(over.select("change_id", F.lit(True).alias("over")).distinct(), "change_id", "left")
        beyond = F.coalesce("over", F.lit(False))
    outcome = F.when(F.col("rule").isNotNull(), "screened").when(F.col("said").isNotNull(), F.col("said")).when(beyond, "over_budget").otherwise("unclassified")
    return out.select(*changes.columns, outcome.alias("outcome"), "rule", "quote", F.when(F.col("rule").isNotNull(), False).otherwise(F.coalesce("relevant", F.lit(True))).alias("relevant"), F.coalesce("confidence", F.lit("low")).alias("confidence"))


def bodies(changes: DataFrame, fetched: DataFrame) -> DataFrame:
    """A body for every change: its inline text, else the one fetch of its URL that all its changes share; an error isn't an empty text."""
    inline = F.coalesce(F.trim("posting_text"), F.lit("")) != ""
    out = changes.join(fetched.select("url", F.col("text").alias("got"), F.col("error").alias("failed")).dropDuplicates(["url"]), "url", "left")
    origin = F.when(inline, "inline").when(F.col("got").isNotNull() | F.col("failed").isNotNull(), "fetched").otherwise("absent")
    return out.select("change_id", F.when(inline, F.col("posting_text")).otherwise(F.col("got")).alias("text"), F.when(~inline, F.col("failed")).alias("error"), "url", origin.alias("origin"))


def still_needed(changes: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct URLs without inline text that the cache doesn't have."""
    return changes.where("coalesce(trim(posting_text), '') = '' AND coalesce(url, '') <> ''").select("url").distinct().join(cache.select("url"), "url", "left_anti")


def body_health(found: DataFrame) -> DataFrame:
    fetched = F.col("origin") == "fetched"
    return found.agg(F.count_if(fetched).alias("fetched"), F.count_if(fetched & F.col("error").isNull()).alias("read"), F.count_if(fetched & F.col("error").isNotNull()).alias("failed"))


def model_input(key: Column, detail: Column, text: Column, error: Column) -> Column:
    """What a judge reads: the row, its detail up to a bound, then the posting or why there is none."""
    body = F.when(text.isNotNull() & (F.trim(text) != ""), F.concat(F.lit("Posting: "), clipped(text, 12_000))).otherwise(F.concat(F.lit("Posting unavailable: "), F.coalesce(error, F.lit("not fetched"))))
    return F.concat_ws("\n", F.concat(F.lit("Row: "), key), F.when(detail != "", F.concat(F.lit("Detail: "), clipped(detail, 4000))), body)


def label(rule: Column, quote: Column, labels: dict[str, str]) -> Column:
    """A rule's short phrase; an out-of-field rule quotes its match; a model's own phrase stands as it is."""
    table = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return F.when(rule == "out-of-field-title", F.concat(F.lit("field: "), quote)).otherwise(F.coalesce(table[rule], F.when(rule != "", rule), F.lit("not relevant")))
