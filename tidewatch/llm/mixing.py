"""Mixing sources to target weights by subset-sum budget fitting.

The size of a document is its number of ``[^\\x20\\x09-\\x0D]+`` words (null text: 0).
Sources share ``epochs`` times all words by weight. A source may be read ``cap``
times at most: what is above is shared again among the others by weight, until
none is above. That is the level at which ``min(cap * size, level * weight)`` adds
up to the total, found by one pass over the sources in order of ``cap * size / weight``.

Each source takes whole copies of everything as often as its target allows. For
what is left, documents are counted by exact length, each length gives its share
rounded up or down by a seeded draw, and a bounded-knapsack dynamic programme over the
lengths chooses the counts that fill the last ``FIT_WORDS`` words as closely as possible. Which documents of a length are
taken follows from a seeded hash of ``doc_id`` (ties by text hash), found by a
histogram of hash buckets and the ranks within each. So nothing sorts a whole source.

Null sources are one source, ordered last. Documents of size 0 take nothing. An
empty table gives no rows; other columns are neither read nor returned. Rows that
agree in all of doc_id, source and text are taken in the order of their files. A very long
text is one length like others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.flat import numbered
from tidewatch.session import stored, work_folder

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 256
#: The dynamic programme fits this many words and what the last document given back is above them.
FIT_WORDS = 1 << 12


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), epochs: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target for each source of ``sizes`` (source, source_size).

    ``sizes`` has a row for each source, so its windows see few rows, whatever the corpus has.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), k + 1))
    full = F.col("source_size") * F.lit(cap)
    everything = Window.partitionBy()
    by_level = Window.orderBy((full / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    stepped = weighed.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(epochs),
        "spent": F.coalesce(F.sum(full).over(by_level), F.lit(0.0)),
        "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0)),
    })
    # the level, were this source the first that isn't full; the true one is the least at which its source isn't
    level = (F.col("budget") - F.col("spent")) / F.col("w_left")
    first = F.min(F.when(level * F.col("w") <= full, F.struct((full / F.col("w")).alias("at"), level.alias("level")))).over(everything)
    return stepped.withColumn("first", first).select("source", "source_size", F.when(F.col("first").isNull(), full).otherwise(F.least(full, F.col("first.level") * F.col("w"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest to the budget from below.

    Each length takes its share rounded up or down by a draw of its own, so that lengths which few
    documents have are taken as often as others. What the draws are off is evened out by
    single documents in a drawn order of lengths, and so are ``FIT_WORDS`` words given back, which
    the programme fits.
    """
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.copy()
    draw = np.random.default_rng(seed)
    share = counts * (budget / total)
    taken = np.minimum(np.floor(share + draw.random(len(lengths))).astype(np.int64), counts)
    left = budget - int((lengths * taken).sum())
    order = draw.permutation(len(lengths))
    more = True
    while left > 0 and more:
        more = False
        for i in order:
            if lengths[i] <= left and taken[i] < counts[i]:
                taken[i] += 1
                left -= int(lengths[i])
                more = True
    while left < FIT_WORDS and taken.any():
        for i in order:
            if left < FIT_WORDS and taken[i]:
                taken[i] -= 1
                left += int(lengths[i])
    free = counts - taken
    reach, by, parts = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int64), []
    reach[0] = True
    for i in order:
        size, n, step = int(lengths[i]), int(min(free[i], left // int(lengths[i]))), 1
        while n > 0 and not reach[left]:  # n copies as powers of two
            part = min(step, n)
            new = np.zeros_like(reach)
            new[part * size :] = reach[: left + 1 - part * size]
            new &= ~reach
            by[new] = len(parts)
            parts.append((i, part))
            reach |= new
            n, step = n - part, step * 2
    at = int(np.flatnonzero(reach)[-1])
    while at:  # a sum's part came later than those of the sum before it, so none is used twice
        i, part = parts[by[at]]
        taken[i] += part
        at -= part * int(lengths[i])
    return taken


def _fitted(seed: int):
    def fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's counts by length; as many rows as there are lengths, not documents."""
        pdf = pdf.sort_values("size")
        own = zlib.crc32(f"{seed} {pdf['key'].iloc[0]}".encode("utf-8", "surrogatepass"))
        n = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["left"].iloc[0]), own)
        return pdf[["key", "size"]].assign(n_take=n)

    return fit_source


def mixed(docs: DataFrame, seed: int = 17, weights=(3, 1, 2), epochs: float = 1.5, cap: float = 2.0, folder: str | None = None) -> DataFrame:
    """row_id, doc_id, size, source_size, target, taken for each row of ``docs``."""
    folder = folder or work_folder(docs.sparkSession, "mixing")
    docs, row_id = numbered(docs)
    rows = docs.select(
        F.col(row_id).alias("row_id"),
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"),
        n_words(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("h"),
        F.xxhash64("text").alias("h_text"),
    )
    rows = stored(rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(BUCKETS)).cast("int")), f"{folder}/rows")
    counts = stored(rows.groupBy("key", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), f"{folder}/counts")
    sizes = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = stored(_keyed_targets(sizes, weights, epochs, cap), f"{folder}/aims")
    lengths = counts.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n"))
    fitted = lengths.hint("merge").join(aims.select("key", "left"), "key").groupBy("key").applyInPandas(_fitted(seed), "key string, size long, n_take long")
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket")) - F.col("n")
    plan = counts.withColumn("before", before).hint("merge").join(fitted, ["key", "size"], "left")
    plan = plan.select("key", "size", "bucket", F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("n_take", F.lit(0)) - F.col("before"))).alias("take"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "h_text", "row_id"))
    ranked = rows.hint("merge").join(plan, ["key", "size", "bucket"]).withColumn("more", (rank <= F.col("take")).cast("long"))
    # a source may hold a third of all rows; the few rows of aims go to every task when their number is small
    aims = F.broadcast(aims) if aims.count() <= 10_000 else aims.hint("merge")
    return ranked.join(aims, "key").select("row_id", "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken"))


def _keyed_targets(sizes: DataFrame, weights, epochs, cap) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = targets(sizes.select("source", "source_size"), weights, epochs, cap)
    return aims.select(key.alias("key"), "source_size", "target", whole.alias("whole"), (F.floor("target") - whole * F.col("source_size")).cast("long").alias("left"))


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")
