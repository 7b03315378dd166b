"""Exact dedup against history through a minimal perfect hash.

The digests of a history table are dealt into shards by their first bytes. For
each shard a minimal perfect hash is built as a cascade of bit maps: a digest
takes the first level whose cell no other digest of its level hits, and its slot
is the number of bits set before that cell. Slots hold the full digest and the
locator of the group's winner. An arriving digest is looked up by slot and
belongs to the group only if all 32 bytes in the slot agree; digests that are no
members are grouped among themselves.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. The row with
the most code points stays, then the smallest ``doc_id`` (null last), then the
row read first. Null texts count as empty; empty texts are one group. An empty
table gives no rows. Columns besides ``doc_id`` and ``text`` are not read, so
clashing names do no harm. A long text is one value of its task, hashed in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import chosen, numbered
from tidewatch.session import released, removed, stored, work_folder

SPACES = " \t\n\x0b\x0c\r"
SHARD_DIGESTS = 100_000
_GAMMA = 2.0
_BIT_BYTES = 32


def digested(docs: DataFrame, row_id: str) -> DataFrame:
    """row_id, doc_id, digest, n_chars for each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col(row_id).alias("row_id"),
        "doc_id",
        F.unhex(F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
    )


def best_of(rows: DataFrame) -> DataFrame:
    """One row for each digest: its winner and the size of its group.

    ``~doc_id`` turns the smallest id into the largest without overflow, and a
    null compares as smallest, so it loses.
    """
    rank = F.struct("n_chars", F.bitwise_not("doc_id").alias("r_doc"), F.bitwise_not("row_id").alias("r_row"))
    return rows.groupBy("digest").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))


def with_shard(rows: DataFrame, shards: int) -> DataFrame:
    head = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    return rows.withColumn("shard", F.pmod(head, F.lit(shards)).cast("int"))


def _keys(digests) -> np.ndarray:
    """Bytes 8 to 24 of each digest as two 64-bit numbers; the first bytes chose the shard."""
    raw = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)
    return np.ascontiguousarray(raw[:, 8:24]).view("<u8")


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Cells of one level by double hashing."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] + np.uint64(level + 1) * (keys[:, 1] | np.uint64(1))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def build_levels(digests) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit maps by level and each digest's slot, a number below their count."""
    keys, slots = _keys(digests), np.full(len(digests), -1, np.int64)
    left, levels, before = np.arange(len(digests)), [], 0
    while len(left):
        size = -(-max(int(_GAMMA * len(left)), 8) // 8) * 8
        cells = _cells(keys[left], len(levels), size)
        alone = np.bincount(cells, minlength=size) == 1
        hit = alone[cells]
        rank = np.cumsum(alone) - 1
        slots[left[hit]] = before + rank[cells[hit]]
        levels.append(np.packbits(alone, bitorder="little"))
        before, left = before + int(alone.sum()), left[~hit]
    return levels, slots


def slot_of(levels: list[np.ndarray], digests) -> np.ndarray:
    """The slot of each digest; -1 where no level has its bit, so it is no member."""
    keys, slots = _keys(digests), np.full(len(digests), -1, np.int64)
    left, before = np.arange(len(digests)), 0
    for k, packed in enumerate(levels):
        bits = np.unpackbits(packed, bitorder="little").astype(bool)
        cells = _cells(keys[left], k, len(bits))
        hit, rank = bits[cells], np.cumsum(bits) - 1
        slots[left[hit]] = before + rank[cells[hit]]
        before, left = before + int(bits.sum()), left[~hit]
        if not len(left):
            break
    return slots


def build_hash(groups: DataFrame, shards: int) -> DataFrame:
    """The history's hash: a row for each slot, and rows with slot -1 - level that hold the bit maps."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, slots = build_levels(pdf["digest"].tolist())
        pdf = pdf[["shard", "digest", "n_chars", "r_doc", "r_row", "n"]].assign(slot=slots, bits=None)
        maps = pd.DataFrame({"shard": pdf["shard"].iloc[0], "slot": [-1 - k for k in range(len(levels))], "bits": [x.tobytes() for x in levels]})
        return pd.concat([pdf, maps.reindex(columns=pdf.columns)], ignore_index=True).astype({c: "Int64" for c in ("n_chars", "r_doc", "r_row", "n")})

    flat = with_shard(groups, shards).select("shard", "digest", "best.*", "n")
    return flat.groupBy("shard").applyInPandas(build, "shard int, slot long, digest binary, n_chars long, r_doc long, r_row long, n long, bits binary")


def looked_up(arrivals: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """Arriving digests with the slot that the history's hash gives them."""

    def probe(maps: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        levels = [np.frombuffer(x, np.uint8) for x in maps.sort_values("slot", ascending=False)["bits"]]
        out = news[["shard", "digest"]]
        return out.assign(slot=slot_of(levels, out["digest"].tolist()) if len(out) else np.zeros(0, np.int64))

    maps = table.where("slot < 0").select("shard", "slot", "bits").groupBy("shard")
    news = with_shard(arrivals.select("digest"), shards).groupBy("shard")
    return maps.cogroup(news).applyInPandas(probe, "shard int, digest binary, slot long")


def grouped(history: DataFrame, arrivals: DataFrame, folder: str) -> DataFrame:
    """digest, best, n over both tables of :func:`digested` rows."""
    past = stored(best_of(history), f"{folder}/past")
    shards = max(1, -(-past.count() // SHARD_DIGESTS), past.sparkSession.sparkContext.defaultParallelism)
    table = stored(build_hash(past, shards), f"{folder}/hash")
    news = stored(best_of(arrivals), f"{folder}/news")
    found = looked_up(news, table, shards).where("slot >= 0")
    members = table.where("slot >= 0").select("shard", "slot", F.col("digest").alias("held"), F.struct("n_chars", "r_doc", "r_row").alias("past_best"), F.col("n").alias("past_n"))
    checked = found.hint("merge").join(members, ["shard", "slot"]).where(F.col("held") == F.col("digest")).select("digest", "past_best", "past_n")
    slots = table.where("slot >= 0").select("digest", F.struct("n_chars", "r_doc", "r_row").alias("best"), "n")
    news_part = news.hint("merge").join(checked, "digest", "left").select("digest", F.greatest("best", F.coalesce("past_best", "best")).alias("best"), (F.col("n") + F.coalesce("past_n", F.lit(0))).alias("n"))
    return slots.hint("merge").join(checked.select("digest"), "digest", "left_anti").unionByName(news_part)


def exact_groups(docs: DataFrame, is_history=None, folder: str | None = None, row_id: str | None = None) -> DataFrame:
    """Each row of ``docs`` with its group: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    is_history: a condition on ``doc_id`` that names the rows seen before; without
    one, half of the ids by their hash.
    """
    folder = folder or work_folder(docs.sparkSession, "exact")
    old = F.coalesce(is_history, F.lit(False)) if is_history is not None else F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    docs, row_id = numbered(docs, row_id)
    rows = stored(digested(docs, row_id).withColumn("old", old), f"{folder}/rows")
    groups = stored(grouped(rows.where("old"), rows.where("NOT old"), folder), f"{folder}/groups")
    removed(docs.sparkSession, *[f"{folder}/{x}" for x in ("past", "hash", "news")])
    released(docs.sparkSession)
    # a digest may stand on a third of the rows: a merge join, whose large partitions Spark splits
    joined = rows.hint("merge").join(groups, "digest")
    return joined.select(
        "row_id",
        "doc_id",
        F.bitwise_not("best.r_doc").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row_id") == F.bitwise_not("best.r_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated texts, columns as they were."""
    docs, row_id = numbered(docs)
    own = work_folder(docs.sparkSession, "exact")
    marks = stored(exact_groups(docs, folder=own, row_id=row_id).select("row_id", "kept"), work_folder(docs.sparkSession, "marks"))
    removed(docs.sparkSession, own)
    released(docs.sparkSession)
    return chosen(docs, row_id, marks.where("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).drop("row_id")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY chars DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM n JOIN w USING (text_sha256)
"""
