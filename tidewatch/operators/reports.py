"""Filter reports: every screen says what it looked at and what it removed, also when that is nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SAMPLES = 5


def filter_report(rows: DataFrame, removed: Column, filter_id: str, reason: str, sources: DataFrame | None = None, key: str = "key", order: str = "ord", samples: int = MAX_SAMPLES) -> DataFrame:
    """source_id, filter_id, considered, removed, reason, samples. Unknown (null) never removes; ``sources`` adds those without rows."""
    marked = rows.withColumn("__out", F.coalesce(removed, F.lit(False)))
    counts = marked.groupBy("source_id").agg(F.count(F.lit(1)).alias("considered"), F.count_if("__out").alias("removed"))
    # Spark makes a limit for each group of this rank before it deals rows out, so no task gets all rows of a source
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(order))
    first = marked.where("__out").select("source_id", order, F.col(key).alias("k")).withColumn("__n", n).where(F.col("__n") <= samples)
    names = first.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "k"))), lambda x: x["k"]).alias("samples"))
    report = counts.hint("merge").join(names, "source_id", "left")
    if sources is not None:
        report = sources.select("source_id").distinct().join(report, "source_id", "left")
    return report.select("source_id", F.lit(filter_id).alias("filter_id"), F.coalesce("considered", F.lit(0)).alias("considered"), F.coalesce("removed", F.lit(0)).alias("removed"), F.lit(reason).alias("reason"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def rollup(reports: DataFrame, named: int = 6) -> DataFrame:
    """By filter that removed anything: totals, and its sources by name if they are few, else their number."""
    some = reports.where("removed > 0").groupBy("filter_id").agg(F.sum("removed").alias("removed"), F.sum("considered").alias("considered"), F.count_distinct("source_id").alias("n_sources"))
    rank = F.row_number().over(Window.partitionBy("filter_id").orderBy("source_id"))
    names = reports.where("removed > 0").select("filter_id", "source_id").distinct().withColumn("n", rank).where(F.col("n") <= named).groupBy("filter_id").agg(F.array_join(F.array_sort(F.collect_list("source_id")), ", ").alias("names"))
    who = F.when(F.col("n_sources") <= named, F.col("names")).otherwise(F.concat(F.col("n_sources").cast("string"), F.lit(" sources")))
    return some.join(names, "filter_id").select("filter_id", "removed", "considered", "n_sources", who.alias("sources"))


def removed_by(reports: DataFrame, filter_id: str) -> DataFrame:
    return reports.where(F.col("filter_id") == filter_id).agg(F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))
