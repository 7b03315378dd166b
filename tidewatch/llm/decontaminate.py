"""Benchmark decontamination by greedy string tiling.

Texts become lower-case words. A benchmark item and a document share a seed where
``MIN_WORDS`` words in a row have the same Karp-Rabin fingerprint. Seeds on one
diagonal join to maximal runs. Then the longest run between unmarked words is marked
as a tile, in both texts, again and again, until none of ``MIN_WORDS`` is left; runs
that a tile cuts compete again with what is left of them. So moved passages count in
any order and no word counts twice. A document is contaminated if tiles cover at least
``coverage`` of an item's words.

The benchmark goes to the tasks in blocks of at most ``BLOCK_WORDS`` words, each block
against all documents, so what is broadcast has a bound whatever the benchmark's size.
Documents aren't shuffled for a single block.

Null and empty texts are clean. Items of fewer than ``MIN_WORDS`` words are in a document
that has all their words in a row; items without words are in none. A very long text is
matched in portions, so that its memory is its words and its matches. Items with equal texts are each reported; null item ids are
left out of the list but still contaminate. Repeated documents are judged each for
itself. An empty benchmark leaves all documents clean; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import chosen, chunks, normal_words, numbered, shingles, words
from tidewatch.session import stored, work_folder

MIN_WORDS = 5
COVERAGE = 0.8
BLOCK_WORDS = 2_000_000
#: Pairs of equal seeds that are made at a time.
PAIRS = 1 << 21
_FILTER = 1 << 20


def joined(item: np.ndarray, item_at: np.ndarray, doc_at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches of n seeds, item by item, with those that follow each other on a diagonal made one."""
    order = np.lexsort((item_at, doc_at - item_at, item))
    x, i, d, n = item[order], item_at[order], doc_at[order], n[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] - i[1:] != d[:-1] - i[:-1]) | (i[1:] != i[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return x[first], i[first], d[first], np.add.reduceat(n, first) if len(n) else n


def tiles(matches: list[tuple[int, int, int]], n_item: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest unmarked match first, then the one earliest in the document, then in the item."""
    heap = [(-n, d, i) for n, i, d in matches]
    heapq.heapify(heap)
    item, doc, out = np.zeros(n_item, bool), {}, []
    room = n_item >= least
    while heap and room:
        n, d, i = heapq.heappop(heap)
        taken = item[i : i - n] | np.fromiter((d + x in doc for x in range(-n)), bool, -n)
        if not taken.any():
            item[i : i - n] = True
            doc.update((d + x, True) for x in range(-n))
            out.append((-n, i, d))
            free = np.flatnonzero(np.diff(np.concatenate(([1], item.astype(np.int8), [1]))))
            room = bool((free[1::2] - free[::2] >= least).any())
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([1], taken.astype(np.int8), [1]))))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), d + int(a), i + int(a)))
    return out


class Seeds:
    """The seeds of a block of items: sorted fingerprints, their items and positions, and a small first filter."""

    def __init__(self, items: list[tuple], k: int = MIN_WORDS):
        texts = pa.array([x[1] for x in items], pa.large_string())
        prints, item, at, self.n_words = [], [], [], []
        short: dict[int, list[tuple]] = {}
        for _, data, offsets in chunks(texts):
            hashes, first = words(data, offsets)
            for a, b in zip(first[:-1], first[1:], strict=True):
                if 0 < b - a < k:  # fewer words than a seed has: the item is found as a whole
                    short.setdefault(int(b - a), []).append((shingles(hashes[a:b], int(b - a))[0], len(self.n_words)))
                got = shingles(hashes[a:b], k)
                prints.append(got)
                item.append(np.full(len(got), len(self.n_words)))
                at.append(np.arange(len(got)))
                self.n_words.append(int(b - a))
        self.ids, self.k = [x[0] for x in items], k
        self.short = {n: (np.array([x[0] for x in some], np.uint64), [x[1] for x in some]) for n, some in short.items()}
        prints = np.concatenate([np.zeros(0, np.uint64), *prints])
        order = np.argsort(prints, kind="stable")
        self.prints, self.item, self.at = prints[order], np.concatenate([np.zeros(0, np.int64), *item])[order], np.concatenate([np.zeros(0, np.int64), *at])[order]
        self.filter = np.zeros(_FILTER, bool)
        self.filter[self.prints & np.uint64(_FILTER - 1)] = True

    def covered(self, hashes: np.ndarray, prints: np.ndarray, coverage: float) -> list[tuple[int, float]]:
        """Items that tiles cover well enough, with how much of them."""
        out = [(item, 1.0) for n, (whole, items) in self.short.items() for item, hit in zip(items, np.isin(whole, shingles(hashes, n)), strict=True) if hit]
        item, item_at, doc_at, n = self._matches(prints)
        for x in np.unique(item):
            some, size = item == x, self.n_words[x]
            # no tiling covers more words than all seeds together
            if np.count_nonzero(np.cumsum(np.bincount(item_at[some], minlength=size + 1) - np.bincount(item_at[some] + n[some] + self.k - 1, minlength=size + 1)) > 0) < coverage * size:
                continue
            length = n[some] + self.k - 1
            if length.max() == size:  # the longest match there can be is the first tile, and no word is left
                out.append((int(x), 1.0))
                continue
            got = sum(t[0] for t in tiles(list(zip(length.tolist(), item_at[some].tolist(), doc_at[some].tolist(), strict=True)), size, self.k)) / size
            if got >= coverage:
                out.append((int(x), got))
        return out

    def _matches(self, prints: np.ndarray) -> tuple[np.ndarray, ...]:
        """Items, places in item and document, and seeds in a row, of all maximal matches.

        Pairs of equal seeds are many where words repeat, matches are few: pairs are made for
        ``PAIRS`` at a time and become matches at once.
        """
        place = np.flatnonzero(self.filter[prints & np.uint64(_FILTER - 1)])
        a, b = np.searchsorted(self.prints, prints[place]), np.searchsorted(self.prints, prints[place], "right")
        found, ends = [], np.cumsum(b - a)
        begin = 0
        while begin < len(place):
            before = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            n = (b - a)[begin:stop]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[begin:stop], n)
            found.append(joined(self.item[entry], self.at[entry], np.repeat(place[begin:stop], n), np.ones(len(entry), np.int64)))
            begin = stop
        none = np.zeros(0, np.int64)
        return joined(*[np.concatenate([none, *x]) for x in zip(*found, strict=True)]) if found else (none,) * 4


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_words`` words; the driver holds one block at a time."""
    block, n = [], 0
    for item_id, text in benchmark.select("item_id", normal_words(F.col("text"))).toLocalIterator():
        block.append((item_id, text))
        n += text.count(" ") + 1
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def _judged(docs: DataFrame, items: list[tuple], coverage: float, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Seeds(items, k))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            found, most = [], []
            for _, data, offsets in chunks(batch.column(2)):
                hashes, first = words(data, offsets)
                prints = shingles(hashes, k)
                hit = np.flatnonzero(seeds.filter[prints & np.uint64(_FILTER - 1)])
                rows = np.searchsorted(first, hit, "right") - 1
                at = set(rows.tolist())
                for row in range(len(offsets) - 1):
                    a, b = first[row], first[row + 1]
                    got = seeds.covered(hashes[a:b], prints[a : max(a, b - k + 1)], coverage) if row in at or seeds.short else []
                    found.append(sorted(seeds.ids[i] for i, _ in got if seeds.ids[i] is not None))
                    most.append(max((c for _, c in got), default=None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(most, pa.float64())], ["row_id", "doc_id", "items", "coverage"])

    return docs.mapInArrow(judge, "row_id long, doc_id long, items array<long>, coverage double")


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, folder: str | None = None, row_id: str | None = None) -> DataFrame:
    """row_id, doc_id, contaminated, items, coverage (null if clean) for each row of ``docs``."""
    docs, row_id = numbered(docs, row_id)
    rows = docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), normal_words(F.col("text")).alias("words"))
    parts = [_judged(rows, items, coverage, min_words) for items in item_blocks(benchmark, block_words)] or [_judged(rows, [], coverage, min_words)]
    if len(parts) == 1:
        out = parts[0]
    else:
        folder = folder or work_folder(docs.sparkSession, "tiling")
        for k, part in enumerate(parts):
            part.write.parquet(f"{folder}/blocks/block={k}")
        every = docs.sparkSession.read.parquet(f"{folder}/blocks")
        out = every.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.max("coverage").alias("coverage"))
    return out.select("row_id", "doc_id", F.isnotnull("coverage").alias("contaminated"), "items", "coverage")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated rows, columns as they were."""
    docs, row_id = numbered(docs)
    marks = stored(contamination(docs, benchmark, row_id=row_id, **options), work_folder(docs.sparkSession, "marks"))
    return chosen(docs, row_id, marks.where("contaminated"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row_id")
