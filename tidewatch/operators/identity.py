"""One posting from many sources: components over shared identities, winners, and the suppression chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.components import components
from tidewatch.operators.places import placed
from tidewatch.operators.reports import filter_report
from tidewatch.session import stored, work_folder


def identity_edges(rows: DataFrame) -> DataFrame:
    """a, b: each row of (row, ids) with the least row of each of its identities: a star, linear in the identity's rows."""
    long = rows.select("row", F.explode("ids").alias("id"))
    least = long.groupBy("id").agg(F.min("row").alias("b"))
    # an identity may stand on a third of the rows: a merge join, whose large partitions Spark splits
    return long.hint("merge").join(least, "id").select(F.col("row").alias("a"), "b").where("a <> b").distinct()


def posting_groups(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Adds ``component``, the least row joined by shared identities; rows without identities stand alone."""
    folder = folder or work_folder(rows.sparkSession, "postings")
    roots = components(identity_edges(rows), folder)
    return rows.join(roots, F.col("row") == F.col("node"), "left").withColumn("component", F.coalesce("root", "row")).drop("node", "root")


def winners(grouped: DataFrame) -> DataFrame:
    """One row of each component: the first that no aggregator carries, else the first; ordered by the component's first row."""
    best = F.min(F.struct("is_aggregator", "row")).alias("best")
    out = grouped.groupBy("component").agg(best, F.count(F.lit(1)).alias("members"), F.min("row").alias("position"))
    return out.select("component", F.col("best.row").alias("winner"), "members", "position")


def names_of(names: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(names, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def all_muted(names: Column, muted: Column) -> Column:
    """Every name of a ``|`` list is muted; an empty list never is."""
    each = names_of(names)
    return (F.size(each) > 0) & (F.size(F.array_except(each, F.coalesce(muted, F.array().cast("array<string>")))) == 0)


def with_muted(rows: DataFrame, muted: DataFrame) -> DataFrame:
    """Adds ``mutes``: whether every name of a row's ``program_name`` is in ``muted`` (name).

    The distinct lists of names, not the rows, meet the muted names, by equal names.
    """
    lists = rows.select("program_name").distinct()
    each = lists.select("program_name", F.explode(names_of(F.col("program_name"))).alias("name"))
    off = muted.select("name", F.lit(1).alias("off")).distinct()
    by = each.hint("merge").join(off, "name", "left").groupBy("program_name").agg((F.count(F.lit(1)) == F.count("off")).alias("mutes"))
    return rows.hint("merge").join(by, "program_name", "left").withColumn("mutes", F.coalesce("mutes", F.lit(False)))


def suppressed(changes: DataFrame, muted: DataFrame, applied: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept changes and the reports of the chain: removed rows, duplicates, muted names, dismissed keys, in this order.

    changes: row (input order), source_id, kind, key, ids, is_aggregator, program_name, mute_key.
    """
    folder = folder or work_folder(changes.sparkSession, "suppress")
    sources = changes.select("source_id").distinct()
    reports = []

    def screened(rows: DataFrame, out: Column, filter_id: str, reason: str) -> DataFrame:
        rows = stored(rows.withColumn("out", F.coalesce(out, F.lit(False))), f"{folder}/{filter_id}")
        reports.append(filter_report(rows, F.col("out"), filter_id, reason, sources, order="row"))
        return rows.where("NOT out").drop("out")

    rows = screened(changes, F.col("kind") == "removed", "removed-row", "a row that went away asks for nothing")
    grouped = posting_groups(rows, f"{folder}/components")
    best = winners(grouped).select("component", "winner")
    rows = screened(grouped.join(best, "component"), F.col("row") != F.col("winner"), "duplicate-posting", "the same posting from another source").drop("component", "winner")
    rows = screened(with_muted(rows, muted), F.col("mutes"), "muted", "every name is muted").drop("mutes")
    hit = rows.join(applied.select("mute_key", F.lit(True).alias("gone")).distinct(), "mute_key", "left")
    rows = screened(hit, F.col("gone"), "applied", "dismissed in this cycle").drop("gone")
    every = reports[0]
    for report in reports[1:]:
        every = every.unionByName(report)
    return rows, every


def positions(rows: DataFrame, order: list[Column], folder: str | None = None) -> DataFrame:
    """Adds ``position``, from 1, in one order of all rows."""
    found = placed(rows, [], order, folder or work_folder(rows.sparkSession, "positions"), "position")
    return found.withColumn("position", F.col("position") + 1)
