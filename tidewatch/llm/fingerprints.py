r"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The 64-bit hash of each five-word shingle is computed once. Its first ``BIN_BITS`` bits
name one of ``BINS`` bins, and a bin keeps the least hash that falls in it. Sorting
the hashes together with one largest value for each bin puts every bin's least
value first in its run, so one pass over the sorted hashes takes them all out.

An empty bin borrows from one that isn't (optimal densification): it looks at bins in an
order of its own, the same for all documents, until one is occupied. The first
``PROBES`` bins of that order are drawn by hash; after them comes the occupied bin whose
hash with the empty one is least, which is the first in a random order of all bins.

A fingerprint is the low ``BITS`` bits of each bin's value, hashed with its bin once more,
packed in 64-bit words and written in hex; without that hash, bins that borrow the same
two values would all agree by chance or none. Two bins agree by chance with probability ``2^-BITS``, which
:func:`likeness` takes out again: (agreeing - chance) / (1 - chance), between 0 and 1.

Words are maximal runs of characters outside ``[\x20\x09-\x0D]``, as they are written.
A text of one to four words has one shingle of all of them. A text without words, null
too, has the empty fingerprint: like another empty one 1, like any other 0. Repeated
rows have equal fingerprints. Columns besides ``doc_id`` and ``text`` aren't read, so
clashing names do no harm. Empty tables give no rows. A text is held whole by its
task, with some 200 bytes for each word while it is hashed.

For the document that follows, rows are dealt to blocks by range of ``doc_id`` (null
first; equal ids in order of reading). The ranges begin at rows of a hash sample of at
most some ``SAMPLE`` rows for each of at most ``MOST_BLOCKS`` blocks, so their first rows
are known in the scan: each goes to its own block and, as a guest, to the end of the block before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.flat import numbered

WORDS = 5
BIN_BITS, BITS, KEPT, PROBES = 9, 4, 16, 24
BINS = 1 << BIN_BITS
PER_WORD = 64 // BITS
BLOCK_ROWS, MOST_BLOCKS, SAMPLE = 256, 16384, 20
SPACES = " \t\n\x0b\x0c\r"
_REST = (1 << 64 - BIN_BITS) - 1
_ENDS = [(k << 64 - BIN_BITS) | _REST for k in range(-BINS // 2, BINS // 2)]
_LOW = sum(1 << BITS * k for k in range(PER_WORD))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a variable that holds ``value``; where a column stands in a lambda, it is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """The hashes of a text's shingles, one for each place, as a long array; none without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    # beyond the last word get() is null, which the hash passes over
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > 0, runs(h)).otherwise(F.array().cast("array<bigint>")))


def least_of_bins(hashes: Column) -> Column:
    """The least hash of each bin, null for an empty one, in order of the (signed) first bits."""
    ends = F.array(*map(F.lit, _ENDS))
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, F.greatest(i - 1, F.lit(0))))))
    found = bound(F.sort_array(F.concat(hashes, ends)), firsts)
    return F.transform(found, lambda x: F.when(x.bitwiseAND(F.lit(_REST)) != _REST, x))


def densified(bins: Column) -> Column:
    """The low bits of each bin's value (at least one has one), an empty bin's from an occupied one. ``KEPT`` bits stand for a value."""
    low = (1 << KEPT) - 1
    probe = lambda i, t: F.pmod(F.xxhash64(F.lit(t), i), F.lit(BINS)).cast("int")
    # occupied bins as one number each, its place above the low bits; the least hash of the places brings its low bits with it
    placed = lambda b: F.filter(F.transform(b, lambda x, i: x + (i * (low + 1)).cast("long")), lambda p: p.isNotNull())
    first = lambda i, held: F.array_min(F.transform(held, lambda p: F.xxhash64(i, F.shiftright(p, KEPT)).bitwiseAND(F.lit(~low)).bitwiseOR(p.bitwiseAND(F.lit(low))))).bitwiseAND(F.lit(low))
    full = lambda b, held, x, i: F.coalesce(x, *[F.get(b, probe(i, t)) for t in range(PROBES)], first(i, held))
    one = lambda b, held: F.transform(b, lambda x, i: F.xxhash64(full(b, held, x, i), i).bitwiseAND(F.lit((1 << BITS) - 1)))
    return bound(F.transform(bins, lambda x: x.bitwiseAND(F.lit(low))), lambda b: bound(placed(b), lambda held: one(b, held)))


def packed(bins: Column) -> Column:
    """The bins' low bits, ``PER_WORD`` bins to a long."""
    shift = lambda x, k: F.call_function("shiftleft", x, k)
    word = lambda b, j: F.aggregate(F.sequence(F.lit(0), F.lit(PER_WORD - 1)), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(shift(F.get(b, j * PER_WORD + k), k * BITS)))
    return bound(bins, lambda b: F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), lambda j: word(b, j)))


def fingerprint(text: Column) -> Column:
    """A text's fingerprint as an array of longs, empty for a text without words."""
    none = F.array().cast("array<bigint>")
    return bound(shingle_hashes(text), lambda h: F.when(F.size(h) > 0, packed(densified(least_of_bins(h)))).otherwise(none))


def written(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two fingerprints' shingle sets, corrected for bins that agree by chance."""

    def differing(x: Column) -> Column:
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        return F.bit_count(x.bitwiseAND(F.lit(_LOW)))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((1 - apart / F.lit(float(BINS))) - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def block_starts(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> list[tuple[int, int]]:
    """(key, row_id) of the rows that begin a block: the least row, and others from a hash sample of bounded size."""
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "row_id")).alias("least")).first()
    blocks = min(MOST_BLOCKS, -(-first["n"] // block_rows))
    if blocks <= 1:
        return [tuple(first["least"])] if first["n"] else []
    every = max(1, first["n"] // (blocks * SAMPLE))
    drawn = rows.where(F.pmod(F.xxhash64("key", "row_id"), F.lit(every)) == 0).orderBy("key", "row_id").collect()
    step = max(1, len(drawn) // blocks)
    return sorted({tuple(first["least"]), *(tuple(x) for x in drawn[step::step])})


def with_next(rows: DataFrame, starts: list[tuple[int, int]], made: dict[str, Column], columns: list[str]) -> DataFrame:
    """``rows`` (key, row_id, ...) and the columns ``made`` of them, with ``next_<column>`` of the row that follows; the first follows the last.

    ``made`` is computed when rows are dealt, as a scan may have few tasks.
    """
    if not starts:
        rows = rows.withColumns(made)
        return rows.withColumns({f"next_{c}": F.col(c) for c in columns})
    width = max(1, int(len(starts) ** 0.5))
    groups = [starts[k : k + width] for k in range(0, len(starts), width)]
    pair = lambda p: F.struct(F.lit(p[0]).cast("long").alias("key"), F.lit(p[1]).cast("long").alias("row_id"))
    own = F.struct("key", "row_id")
    upto = lambda found: F.size(F.filter(found, lambda p: (p["key"] < own["key"]) | (p["key"] == own["key"]) & (p["row_id"] <= own["row_id"])))
    heads, inner = F.array(*[pair(g[0]) for g in groups]), F.array(*[F.array(*map(pair, g)) for g in groups])
    at = rows.withColumn("_g", upto(heads) - 1)
    at = at.withColumn("_run", F.get(inner, F.col("_g"))).withColumn("_k", upto(F.col("_run")) - 1)
    block = F.col("_g") * width + F.col("_k")
    begins = F.get(F.col("_run"), F.col("_k")) == own
    guest = F.array(F.struct(F.pmod(block - 1, F.lit(len(starts))).alias("block"), F.lit(True).alias("guest")))
    dealt = F.concat(F.array(F.struct(block.alias("block"), F.lit(False).alias("guest"))), F.when(begins, guest).otherwise(F.slice(guest, 1, 0)))
    spread = at.withColumn("_to", dealt).drop("_g", "_run", "_k").select("*", F.explode("_to").alias("_at")).drop("_to")
    order = Window.partitionBy("_at.block").orderBy("_at.guest", "key", "row_id")
    spread = spread.select(*rows.columns, "_at").repartition("_at.block").withColumns(made)
    led = spread.withColumn("_next", F.lead(F.struct(*columns)).over(order)).where("NOT _at.guest")
    return led.select(*rows.columns, *made, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def fingerprinted(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, row_id, doc_id, text, print of each row, and next_text, next_print of the one that follows by ``doc_id``."""
    docs, row_id = numbered(docs)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col(row_id).alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts = block_starts(rows.select("key", "row_id"), block_rows)
    return with_next(rows, starts, {"print": fingerprint(F.col("text"))}, ["text", "print"])


def query(spark, sf_dir: str) -> DataFrame:
    rows = fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited).withColumn("edited_print", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"),
        written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
