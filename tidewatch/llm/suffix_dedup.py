"""Dedup of long repeated byte strings by a logarithmic family of sampled suffix arrays.

Wanted: every byte covered by a string of ``match`` bytes that also starts elsewhere,
in any document. Each window of ``match`` bytes has an anchor, the place in it where the
hash of ``seed`` bytes is least (leftmost of equals), so equal windows have equal
anchors at equal offsets. Only suffixes that begin at anchors are indexed, about one
for ``(match - seed) / 2`` bytes. Neighbouring windows with one anchor make a run.

A batch's suffix array has its sampled suffixes in order of their first 8 bytes, then
of the hash of their first ``seed`` bytes, so suffixes that share ``seed`` bytes stand
together; equal ones are one entry with their number and the least and greatest hash
of their runs. A new batch's array is merge-scanned against each level: what stands in
both is a shared suffix. Then it becomes a level, and levels of equal size merge, so
there are at most log2(batches) and an entry is rewritten as often.

Shared suffixes settle the rest. A run that occurs twice as a whole repeats all its
windows. Where suffixes are shared by different runs, one of each kind is fetched and
its windows are compared by hash within the suffix (128 bits together). Suffixes
with more than ``GROUP_RUNS`` kinds of runs don't go to one task: their windows are
counted by hash over all tasks and joined back.

Null texts are empty. Texts shorter than ``match`` keep all bytes. Repeated rows are
documents of their own and repeat each other. An empty table gives no rows; other
columns are not read. Text is read in pieces, so a document's length doesn't bound memory
beyond its own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import chunks, mixed, numbered, powers
from tidewatch.session import released, removed, stored, work_folder

MATCH = 400
SEED = 128
BATCHES = 4
GROUP_RUNS = 2000
PIECE = 1 << 19
_A = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte values times powers, and the powers that shift a difference back to 0."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def hashed(sums: np.ndarray, down: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each place; the same wherever the bytes stand."""
    return mixed((sums[at + size] - sums[at]) * down[at])


def pieces(data: np.ndarray, offsets: np.ndarray, match: int, piece: int, extra: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A long document alone in pieces that overlap, so that each window begins in one; other chunks as they are."""
    if len(offsets) > 2 or len(data) <= 2 * piece:
        yield 0, data, offsets
        return
    for a in range(0, len(data) - match + 1, piece):
        part = data[a : a + piece + match - 1 + extra]
        yield a, part, np.array([0, len(part)])


def runs(data: np.ndarray, offsets: np.ndarray, match: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first window, windows, anchor, first 8 bytes, suffix hash, run hash."""
    n, size = len(data), np.diff(offsets)
    if n < match or not (size >= match).any():
        return (np.zeros(0, np.int64),) * 7
    sums, down = prefix_sums(data)
    seeds = hashed(sums, down, np.arange(n - seed + 1), seed)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    least, span, have = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64), match - seed + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    place = np.flatnonzero(np.arange(n) + match <= np.repeat(offsets[1:], size))
    anchor = (least[place] & low).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    a, b, anchor = place[first], place[np.append(first[1:], len(place)) - 1], anchor[first]
    row = np.searchsorted(offsets, a, "right") - 1
    head = np.zeros(len(anchor), np.int64)
    for k in range(8):  # seven bits of the first, so that the order of numbers is that of bytes
        head = (head << 8) | data[anchor + k] if k else data[anchor].astype(np.int64) >> 1
    whole = mixed(hashed(sums, down, a, match) * _A + hashed(sums, down, b, match) + (b - a).astype(np.uint64))
    return row, a - offsets[row], b - a + 1, anchor - a, head, seeds[anchor].view(np.int64), whole.view(np.int64)


def sampled(rows: DataFrame, match: int, seed: int, piece: int = PIECE) -> DataFrame:
    """row_id, first, n, skip (anchor after the first window), head, suffix, run of each run of windows of ``rows`` (row_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, part = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for row0, data, offsets in chunks(batch.column(2), piece):
                for at, some, where in pieces(data, offsets, match, piece):
                    row, first, n, skip, head, suffix, run = runs(some, where, match, seed)
                    columns = [ids[row + row0], part[row + row0], first + at, n.astype(np.int32), skip.astype(np.int32), head, suffix, run]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row_id", "batch", "first", "n", "skip", "head", "suffix", "run"])

    return rows.mapInArrow(cut, "row_id long, batch int, first long, n int, skip int, head long, suffix long, run long")


def array_of(entries: DataFrame) -> DataFrame:
    """A batch's suffix array: one entry for each sampled suffix, in order."""
    grouped = entries.groupBy("head", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("least"), F.max("run").alias("most"))
    return grouped.sortWithinPartitions("head", "suffix")


def merged(*arrays: DataFrame) -> DataFrame:
    every = arrays[0]
    for other in arrays[1:]:
        every = every.unionByName(other)
    grouped = every.groupBy("head", "suffix").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return grouped.sortWithinPartitions("head", "suffix")


class Family:
    """Levels of suffix arrays below a folder; level k holds 2^k batches."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        self.levels: dict[int, tuple[str, DataFrame]] = {}
        self.shared: list[DataFrame] = []
        self.n = 0

    def _written(self, df: DataFrame, kind: str) -> tuple[str, DataFrame]:
        self.n += 1
        path = f"{self.folder}/{kind}{self.n}"
        return path, stored(df, path)

    def insert(self, entries: DataFrame) -> None:
        """Scan a new batch's array against every level, keep what is shared, and carry equal levels into one."""
        carried = 0
        while carried in self.levels:
            carried += 1
        others = [df for k, (_, df) in self.levels.items() if k > carried]
        new = array_of(entries)
        if others:  # its own file, as more than one scan reads it
            new = self._written(new, "array")[1]
        for level in others:
            both = new.hint("merge").join(level.select("head", "suffix", F.col("least").alias("l"), F.col("most").alias("m")), ["head", "suffix"])
            self.shared.append(self._written(both.select("head", "suffix", F.least("least", "l").alias("least"), F.greatest("most", "m").alias("most")), "shared")[1])
        # scanning against the levels that are due and merging them is one pass over their entries
        due = [self.levels.pop(k) for k in range(carried)]
        level = self._written(merged(new, *[df for _, df in due]) if due else new, "level")
        self.shared.append(level[1].where("n > 1").select("head", "suffix", "least", "most"))
        self.levels[carried] = level
        if not others:  # kept results that point to merged levels now follow from the new one
            self.shared = [self.shared[-1]]
            removed(self.spark, *[path for path, _ in due])
        released(self.spark)

    def repeats(self) -> DataFrame:
        """suffix, contested (different runs share it) of suffixes that occur more than once."""
        every = self.shared[0]
        for other in self.shared[1:]:
            every = every.unionByName(other)
        return every.groupBy("head", "suffix").agg((F.min("least") < F.max("most")).alias("contested"))


def _windows(rows: DataFrame, match: int, piece: int) -> DataFrame:
    """The window hashes of the fetched runs (first, n, skip, suffix, solo in ``wanted``) of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), batch.column(2)
            flat, where = wanted.flatten(), np.concatenate([[0], np.cumsum(np.diff(wanted.offsets.to_numpy()))])
            first, n, skip, suffix, solo = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            owner = np.repeat(np.arange(len(ids)), np.diff(where))
            for row0, data, offsets in chunks(batch.column(1), piece):
                for at, some, off in pieces(data, offsets, match, piece, extra=1024):
                    pick = np.flatnonzero((owner >= row0) & (owner < row0 + len(offsets) - 1) & (first >= at) & ((first < at + piece) | (len(offsets) > 2) | (len(data) <= 2 * piece)))
                    if not len(pick):
                        continue
                    sums, down = prefix_sums(some)
                    start, size = off[owner[pick] - row0] + first[pick] - at, n[pick].astype(np.int64)
                    ends = np.cumsum(size)
                    places = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(start, size)
                    hashes = hashed(sums, down, places, match).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(hashes))
                    columns = [pa.array(x) for x in (suffix[pick], ids[owner[pick]], first[pick], skip[pick], solo[pick])]
                    yield pa.RecordBatch.from_arrays([*columns, lists], ["suffix", "row_id", "first", "skip", "solo", "hashes"])

    return rows.mapInArrow(cut, "suffix long, row_id long, first long, skip int, solo boolean, hashes array<long>")


def _settled(windows: DataFrame) -> DataFrame:
    """row_id, first, n of windows that occur in more than one run of their suffix; each suffix's runs are in one task."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def resolved(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            suffix, row, first, skip, solo = (table.column(k).to_numpy() for k in range(5))
            lists = table.column(5).combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(row)), size)
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            key = np.empty(len(owner), [("s", "i8"), ("o", "i8"), ("w", "i8")])
            key["s"], key["o"], key["w"] = suffix[owner], skip[owner] - nth, lists.flatten().to_numpy()
            order = np.argsort(key, order=("s", "o", "w"))
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(owner), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            twice &= solo[owner]
            begin = twice.copy()
            begin[1:] &= ~(twice[:-1] & (owner[1:] == owner[:-1]))
            stop = twice.copy()
            stop[:-1] &= ~(twice[1:] & (owner[1:] == owner[:-1]))
            a, b = np.flatnonzero(begin), np.flatnonzero(stop)
            return pa.RecordBatch.from_arrays([pa.array(row[owner[a]]), pa.array(first[owner[a]] + nth[a]), pa.array(b - a + 1)], ["row_id", "first", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            suffix = batch.column(0).to_numpy()
            cut = int(np.searchsorted(suffix, suffix[-1]))  # the last suffix may go on in the next batch
            if cut:
                yield resolved(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield resolved(pa.Table.from_batches(held))

    return windows.repartition("suffix").sortWithinPartitions("suffix").mapInArrow(settle, "row_id long, first long, n long")


def _settled_apart(windows: DataFrame) -> DataFrame:
    """The same for suffixes with very many runs: windows are counted over all tasks and joined back."""
    each = windows.select("suffix", "row_id", "first", "skip", "solo", F.posexplode("hashes").alias("k", "w")).withColumn("o", F.col("skip") - F.col("k"))
    twice = each.groupBy("suffix", "o", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    found = each.where("solo").hint("merge").join(twice, ["suffix", "o", "w"])
    return found.select("row_id", (F.col("first") + F.col("k")).alias("first"), F.lit(1).cast("long").alias("n"))


def repeated_windows(rows: DataFrame, folder: str, match: int = MATCH, seed: int = SEED, batches: int = BATCHES, group_runs: int = GROUP_RUNS, piece: int = PIECE) -> DataFrame:
    """row_id, first, n: runs of ``n`` windows of ``match`` bytes from ``first`` that occur elsewhere too."""
    spark = rows.sparkSession
    sampled(rows, match, seed, piece).write.partitionBy("batch").parquet(f"{folder}/samples")
    samples = spark.read.schema("row_id long, first long, n int, skip int, head long, suffix long, run long, batch int").parquet(f"{folder}/samples")
    family = Family(spark, f"{folder}/family")
    for k in range(batches):
        family.insert(samples.where(F.col("batch") == k))
    repeats = stored(family.repeats(), f"{folder}/repeats")
    hits = stored(samples.drop("batch").hint("merge").join(repeats, ["head", "suffix"]).drop("head"), f"{folder}/hits")
    removed(spark, f"{folder}/family", f"{folder}/samples")
    released(spark)
    kinds = hits.where("contested").groupBy("suffix", "run").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row_id", "first", "n", "skip")).alias("one"))
    kinds = stored(kinds, f"{folder}/kinds")
    whole = kinds.where("c > 1").select("suffix", "run")
    plain = hits.where("NOT contested").select("row_id", "first", F.col("n").cast("long").alias("n"))
    copied = hits.where("contested").hint("merge").join(whole, ["suffix", "run"]).select("row_id", "first", F.col("n").cast("long").alias("n"))
    crowded = kinds.groupBy("suffix").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > group_runs).select("suffix", F.lit(True).alias("crowded"))
    wanted = kinds.select("one.row_id", F.struct("one.first", "one.n", "one.skip", "suffix", (F.col("c") == 1).alias("solo")).alias("x")).groupBy("row_id").agg(F.collect_list("x").alias("wanted"))
    fetched = rows.select("row_id", "text").join(wanted.hint("shuffle_hash"), "row_id")
    windows = stored(_windows(fetched, match, piece), f"{folder}/windows")
    released(spark)
    crowded = stored(crowded, f"{folder}/crowded")
    spans = plain.unionByName(copied)
    if crowded.isEmpty():
        spans = spans.unionByName(_settled(windows))
    else:
        split = windows.hint("merge").join(crowded, "suffix", "left")
        spans = spans.unionByName(_settled(split.where("crowded IS NULL").drop("crowded"))).unionByName(_settled_apart(split.where("crowded").drop("crowded")))
    out = stored(spans, f"{folder}/spans")
    removed(spark, *[f"{folder}/{x}" for x in ("hits", "kinds", "windows", "repeats")])
    released(spark)
    return out


def cut_out(texts: DataFrame, match: int) -> DataFrame:
    """row_id, doc_id, n_bytes, n_removed, spans, kept (bytes), kept_sha256 from texts with their windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, windows in zip(batch.column(2).cast(pa.large_binary()), batch.column(3), strict=True):
                data, spans = text.as_py() or b"", []
                if windows.is_valid:
                    for x in sorted((w["first"], w["first"] + w["n"] - 1 + match) for w in windows.as_py()):
                        if spans and x[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], x[1])
                        else:
                            spans.append([*x])
                edges = [0, *[e for s in spans for e in s], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in spans], kept, hashlib.sha256(kept).hexdigest()))
            n, gone, spans, kept, digest = zip(*rows, strict=True) if rows else ((),) * 5
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], ["row_id", "doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return texts.mapInArrow(cut, "row_id long, doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")


def substring_deduplicated(docs: DataFrame, match: int = MATCH, seed: int = SEED, batches: int = BATCHES, group_runs: int = GROUP_RUNS, piece: int = PIECE, folder: str | None = None) -> DataFrame:
    """Each row of ``docs`` without its repeated strings: see :func:`cut_out`."""
    if not 8 <= seed < match or match - seed + 1 >= 1024:
        raise ValueError("seed must be at least 8 and less than match, by less than 1024")
    folder = folder or work_folder(docs.sparkSession, "suffix")
    docs, row_id = numbered(docs)
    texts = docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select("row_id", F.pmod(F.xxhash64("row_id"), F.lit(batches)).cast("int").alias("batch"), "text")
    found = repeated_windows(rows, folder, match, seed, batches, group_runs, piece)
    by_row = found.groupBy("row_id").agg(F.collect_list(F.struct("first", "n")).alias("windows"))
    return cut_out(texts.join(by_row.hint("shuffle_hash"), "row_id", "left").select("row_id", "doc_id", "text", "windows"), match)


def query(spark, sf_dir: str) -> DataFrame:
    out = substring_deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # a cut may part a character; what is left of it shows as U+FFFD in the remaining text
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", text.alias("text"), (F.col("n_removed") > 0).alias("repeated"), "spans")
