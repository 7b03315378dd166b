"""Snapshots of listings, their differences, and the guards around them.

A snapshot row is (source_id, section, key, value, url); its identity is section and
key. Sections are a table of their own, since an empty section is a fact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import keys
from tidewatch.packs import recruiting

# Headers of the two blocks of a stored snapshot.
SECTIONS, ROWS = "# sections", "# rows"
KIND_ORDER = {"section": 0, "added": 1, "removed": 2, "changed": 3}


def flagged(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?iu)" + pattern), F.lit(False))


def with_ordinals(rows: DataFrame, order: list[Column], group=("source_id", "section", "key")) -> DataFrame:
    """Second and later rows of one key get `` #n``, so that identities are unique."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("key", F.when(n > 1, F.concat("key", F.lit(" #"), n.cast("string"))).otherwise(F.col("key")))


def carried_entity(cells: DataFrame, group: list[str], order: list[Column], column: str, arrow: str = "↳") -> DataFrame:
    """A cell of an arrow takes the last entity above it in its table; a blank cell stays blank."""
    cell = F.trim(F.col(column))
    named = F.when((cell != "") & (cell != arrow), cell)
    above = F.last(named, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn(column, F.when(cell == arrow, F.coalesce(above, F.lit(""))).otherwise(cell))


def section_changes(old_sections: DataFrame, new_sections: DataFrame) -> DataFrame:
    """Sections that the previous snapshot did not have."""
    new = new_sections.where("section <> ''").join(old_sections, ["source_id", "section"], "left_anti").distinct()
    return new.select(
        "source_id",
        F.lit("section").alias("kind"),
        F.concat(F.lit("section :: "), "section").alias("identity"),
        F.concat(F.lit("new section: "), "section").alias("key"),
        F.concat(F.lit('A section that was not in the previous snapshot: "'), "section", F.lit('".')).alias("detail"),
        F.lit("").alias("url"),
        F.lit(True).alias("structural"),
        F.lit(True).alias("discovery"),
        flagged(F.col("section"), recruiting.ROLLING).alias("rolling"),
    )


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added, removed, and changed in value, by identity: one full outer join."""
    side = lambda df, p: df.select("source_id", keys.identity(F.col("section"), F.col("key")).alias("identity"), *[F.col(c).alias(f"{p}_{c}") for c in ("key", "value", "url")])
    both = side(old, "old").join(side(new, "new"), ["source_id", "identity"], "full_outer")
    kind = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    key, url = F.coalesce("new_key", "old_key"), F.coalesce("new_url", "old_url")
    detail = (
        F.when(F.col("kind") == "added", F.concat(F.lit("New row: "), "new_value"))
        .when(F.col("kind") == "removed", F.concat(F.lit("Row disappeared. It previously read: "), "old_value"))
        .otherwise(F.concat(F.lit("Was: "), "old_value", F.lit("\nNow: "), "new_value"))
    )
    text = F.concat_ws(" ", F.when(F.col("kind") == "added", key).otherwise(F.col("identity")), F.coalesce("new_value", "old_value"))
    rows = both.withColumn("kind", kind).where("kind IS NOT NULL")
    return rows.select(
        "source_id",
        "kind",
        "identity",
        key.alias("key"),
        detail.alias("detail"),
        url.alias("url"),
        F.lit(False).alias("structural"),
        ((F.col("kind") != "removed") & flagged(text, recruiting.DISCOVERY)).alias("discovery"),
        flagged(text, recruiting.ROLLING).alias("rolling"),
    )


def diff(old: DataFrame, new: DataFrame, old_sections: DataFrame | None = None, new_sections: DataFrame | None = None) -> DataFrame:
    """Changes between two snapshots of all sources; a source without a previous snapshot reports none."""
    if old_sections is None:
        old_sections, new_sections = (x.select("source_id", "section").distinct() for x in (old, new))
        seen = old.select("source_id").distinct()
    else:
        # a shuffle of its own: a union of tables that are partitioned alike passes for partitioned, also where AQE has split one of them
        seen = old_sections.select("source_id").union(old.select("source_id")).repartition("source_id").distinct()
    changes = row_changes(old, new.join(seen, "source_id", "left_semi")).unionByName(section_changes(old_sections, new_sections.join(seen, "source_id", "left_semi")))
    return changes.withColumn("change_id", keys.change_id(F.col("source_id"), F.col("identity")))


def ordered(changes: DataFrame) -> DataFrame:
    rank = F.create_map(*[x for k, v in KIND_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return changes.orderBy("source_id", rank[F.col("kind")], "identity")


def sampled_names(group: list[str], rows: DataFrame, column: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` values of each group, by a rank, so that no group is collected whole."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    few = rows.withColumn("__n", n).where(F.col("__n") <= most)
    return few.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", column))), lambda x: x[column]).alias("samples"))


def collapsed(changes: DataFrame, group: list[str], limit: int = 25, sizes: DataFrame | None = None, share: float = 0.25, samples: int = 10) -> DataFrame:
    """Groups with more changes than a busy day's become one structural change with samples.

    Without ``sizes`` the limit is flat: more than ``limit``. With ``sizes`` (group,
    old_rows, new_rows) it is proportional: at least ``limit`` and more than ``share``
    of the larger snapshot.
    """
    counts = changes.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    if sizes is None:
        over = counts.withColumn("over", F.col("total") > limit)
    else:
        base = F.greatest(F.coalesce("old_rows", F.lit(0)), F.coalesce("new_rows", F.lit(0)), F.lit(1))
        over = counts.join(sizes, group, "left").select(*group, "total", ((F.col("total") >= limit) & (F.col("total") > base * share)).alias("over"))
    marked = changes.join(over, group)
    names = sampled_names(group, marked.where("over"), "key", ["identity"], samples)
    structural = over.where("over").join(names, group).select(
        *group,
        F.lit("changed").alias("kind"),
        F.concat(F.concat_ws("/", *group), F.lit(": "), F.col("total").cast("string"), F.lit(" rows changed at once")).alias("key"),
        F.lit(True).alias("structural"),
        "total",
        "samples",
    )
    rest = marked.where("NOT over").select(*group, "kind", "key", "structural", F.lit(None).cast("long").alias("total"), F.lit(None).cast("array<string>").alias("samples"))
    return rest.unionByName(structural)


def carried_forward(old: DataFrame, new: DataFrame, unreadable: DataFrame, on: list[str]) -> DataFrame:
    """Rows of unreadable boards as they were yesterday, with today's rows of the others."""
    return new.join(unreadable, on, "left_anti").unionByName(old.join(unreadable, on, "left_semi"))


def committed(old: DataFrame, new: DataFrame, metrics: DataFrame) -> DataFrame:
    """The next baseline: new rows of sources that are ok, old rows of all others."""
    ok = metrics.where("coalesce(ok, false)").select("source_id").distinct()
    return new.join(ok, "source_id", "left_semi").unionByName(old.join(ok, "source_id", "left_anti"))


def overlaid(stored: DataFrame, today: DataFrame) -> DataFrame:
    """Today's snapshots, and the stored ones of sources without any today."""
    return stored.join(today.select("source_id").distinct(), "source_id", "left_anti").unionByName(today)


def snapshot_hash(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """source_id, hash: the SHA-256 of each source's stored text, its headers, sorted sections and sorted rows.

    The distinct lines of a source come sorted as a stream, so a source of any size is hashed in
    constant memory and without its text being made.
    """
    line = F.concat_ws("\t", "section", "key", "value")
    every = rows.select("source_id").unionByName(sections.select("source_id"))
    heads = every.distinct().select("source_id", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.lit(x).alias("line")) for k, x in ((0, SECTIONS), (2, ROWS))])).alias("x")).select("source_id", "x.*")
    body = sections.select("source_id", F.lit(1).alias("block"), F.col("section").alias("line")).unionByName(rows.select("source_id", F.lit(3).alias("block"), line.alias("line")))
    lines = heads.unionByName(body.distinct()).repartition("source_id").sortWithinPartitions("source_id", "block", "line")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done = lambda found: pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([h for _, h in found], pa.string())], names=["source_id", "hash"])
        for batch in batches:
            found = []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if source != now or state is None:
                    if state is not None:
                        found.append((now, state.hexdigest()))
                    now, state = source, hashlib.sha256()
                state.update(text.encode() + b"\n")
            yield done(found)
        if state is not None:
            yield done([(now, state.hexdigest())])

    return lines.select("source_id", "line").mapInArrow(stream, "source_id string, hash string")
