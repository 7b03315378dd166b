"""Places of rows in an order, and running sums over places, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import stored

SUM_BLOCK = 1 << 13


def placed(rows: DataFrame, group: list[str], order: list[Column], folder: str, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 0) in ``order`` among the rows of their group; written below ``folder``.

    Rows are dealt by range of group and order and written with the number of their
    partition, which a reread keeps. Within a partition places are row numbers. Only
    the first group of a partition can have rows in an earlier one, so the rows
    before are one number for each partition at most: that table is broadcast.
    Equal rows in ``group`` and ``order`` get places of their own; give a
    last column that parts them, or one range holds them all.
    """
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order]
    part = F.spark_partition_id().alias("_part")
    held = stored(rows.repartitionByRange(*keys).select("*", part), f"{folder}/ranges")
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)).cast("long") - 1
    counts = held.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("_before", before).where("_before > 0").drop("_n")
    here = held.withColumn("_inside", inside).alias("h").join(F.broadcast(carried).alias("c"), [F.col("h._part") == F.col("c._part"), *[F.col(f"h.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group]], "left")
    return here.select(*[F.col(f"h.{c}").alias(c) for c in rows.columns], (F.col("h._inside") + F.coalesce("c._before", F.lit(0))).alias(name))


def summed(rows: DataFrame, place: str, values: list[str], block: int = SUM_BLOCK) -> DataFrame:
    """``rows`` with each of ``values`` replaced by its sum over all places up to the row's.

    Places are unique numbers from 0. Sums run within blocks of ``block`` places; the
    blocks' totals, one row for each, run on in a window and come back by merge join.
    """
    rows = rows.withColumn("_block", F.floor(F.col(place) / block))
    totals = rows.groupBy("_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("_block").orderBy(place)
    ran = rows.withColumns({v: F.sum(v).over(inside) for v in values})
    joined = ran.hint("merge").join(starts, "_block")
    return joined.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_block", *[f"_{v}" for v in values])
