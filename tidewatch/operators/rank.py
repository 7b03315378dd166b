"""Ranks, budgets and orders of the output table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.keys import days_until
from tidewatch.operators.places import placed, summed
from tidewatch.session import stored, work_folder

URGENT_DAYS = 21
MAX_CHARS = 65_536
MAX_JUDGED = 250


def closes(deadline: Column, days: Column) -> Column:
    date = F.try_to_date(F.trim(deadline), "yyyy-MM-dd")
    day = F.concat(F.lit("closes "), F.date_format(date, "MMM d"))
    when = F.when(days == 0, "today").when(days == 1, "1 day").otherwise(F.concat(days.cast("string"), F.lit(" days")))
    return F.when(days > URGENT_DAYS, day).otherwise(F.concat(day, F.lit(" ("), when, F.lit(")")))


def rank(deadline: Column, as_of: Column, rolling: Column, discovery: Column, classified: Column, confidence: Column) -> Column:
    """struct<tier, reason>: only dated, named-firm or discovery rows are High."""
    days = days_until(deadline, as_of)
    pair = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when(days.between(0, URGENT_DAYS), pair("High", closes(deadline, days)))
        .when(F.coalesce(rolling, F.lit(False)), pair("High", "rolling firm, fills early"))
        .when(F.coalesce(discovery & classified & confidence.isin("medium", "high"), F.lit(False)), pair("High", "discovery programme"))
        .when(~F.coalesce(classified, F.lit(False)), pair("Medium", "unverified"))
        .when(F.coalesce(F.lower(F.trim(deadline)) == "rolling", F.lit(False)), pair("Medium", "rolling, no close date"))
        .when(days > URGENT_DAYS, pair("Medium", closes(deadline, days)))
        .when(days.isNotNull(), pair("Medium", "deadline passed"))
        .otherwise(pair("Medium", "no deadline stated"))
    )


def digest_order(rows: DataFrame) -> list[Column]:
    """Top block, High with small firms first, Medium by reason then size, ruled out last; input order breaks ties."""
    block = F.when(~F.coalesce("relevant", F.lit(True)), 3).when(F.coalesce("top", F.lit(False)), 0).when(F.col("tier") == "High", 1).otherwise(2)
    reason = F.when(F.col("tier") == "High", 0).when(F.startswith("reason", F.lit("rolling")), 0).when(F.startswith("reason", F.lit("closes")), 1).when(F.col("reason") == "no deadline stated", 2).when(F.col("reason") == "unverified", 3).otherwise(4)
    return [block.asc(), reason.asc(), (F.coalesce(F.lower("employer_size"), F.lit("")) != "small").asc(), F.col("ord").asc()]


def judging_order() -> list[Column]:
    """What a judge reads first when a day has more than the budget: rolling firms, discovery programmes, then input order."""
    return [F.coalesce("rolling", F.lit(False)).desc(), F.coalesce("discovery", F.lit(False)).desc(), F.col("ord").asc()]


def within_budget(rows: DataFrame, order: list[Column], most: int = MAX_JUDGED, group: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Adds ``judged``: the first ``most`` rows in order, by group if one is given; others are labelled, not dropped."""
    if group:
        return rows.withColumn("judged", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) <= most)
    found = placed(rows, [], order, folder or work_folder(rows.sparkSession, "budget"), "__place")
    return found.withColumn("judged", F.col("__place") < most).drop("__place")


def fitted(rows: DataFrame, order: list[str], length: str, group: list[str], header: int, footer: int, most: int = MAX_CHARS) -> DataFrame:
    """Adds ``shown``: rows in order while header, rows with line ends, footer and the note fit. Its longest form is reserved for the note when not all fit."""
    w = Window.partitionBy(*group)
    used = F.sum(F.col(length) + 1).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    total, count = F.sum(F.col(length) + 1).over(w), F.count(F.lit(1)).over(w)
    note = F.length(F.concat(count.cast("string"), F.lit(" more rows did not fit."))) + 1
    room = F.when(total + header + footer <= most, F.lit(most)).otherwise(most - note)
    return rows.withColumn("shown", used + header + footer <= room)


def fitted_one(rows: DataFrame, order: list[Column], length: str, header: int, footer: int, most: int = MAX_CHARS, folder: str | None = None) -> DataFrame:
    """Adds ``n``, the row's number in order, and ``shown`` as :func:`fitted` does, for one message of any number of rows.

    Places come by range and sums by blocks of places, so no task sees all rows; two numbers reach the driver.
    """
    folder = folder or work_folder(rows.sparkSession, "fitted")
    found = stored(placed(rows, [], order, f"{folder}/order", "__place").withColumn("__used", (F.col(length) + 1).cast("long")), f"{folder}/placed")
    sums = found.agg(F.sum("__used").alias("total"), F.count(F.lit(1)).alias("n")).first()
    note = len(f"{sums['n']} more rows did not fit.") + 1
    room = most if (sums["total"] or 0) + header + footer <= most else most - note
    ran = summed(found, "__place", ["__used"])
    return ran.withColumns({"n": F.col("__place") + 1, "shown": F.col("__used") + header + footer <= room}).drop("__place", "__used")


def withheld(fit: DataFrame, group: list[str]) -> DataFrame:
    return fit.groupBy(*group).agg(F.count_if("shown").alias("shown"), F.count_if(~F.col("shown")).alias("withheld"))


def eligibility_order(code: Column, codes: list[str]) -> Column:
    place = F.array_position(F.array(*map(F.lit, codes)), code)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(codes) + 1).otherwise(place)
