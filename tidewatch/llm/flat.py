"""Helpers inside tasks: Arrow string columns as flat byte arrays, hashes of their words, files by URI."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import stored, work_folder

MAX_FILES = 100_000
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, row_id: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the number's column; as it is if that column is named.

    Each scan must give a row the same number, also one that is split otherwise or
    runs with fewer executors. So the number is the file's place in the sorted list of files and
    the row's index in it. A DataFrame that isn't a plain scan, or one of more than
    ``MAX_FILES`` files, whose list would be too long for every task, is numbered once and written.
    """
    if row_id is not None:
        return docs, row_id
    name = free_name(docs, "row_id")
    files = docs.inputFiles()
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"])
        plain = _is_scan(docs) and 0 < len(files) <= MAX_FILES
    except AnalysisException:
        plain = False
    if not plain:
        made = docs.withColumn(name, F.monotonically_increasing_id())
        return stored(made, work_folder(docs.sparkSession, "numbered")), name
    path, place = free_name(docs, "path_of_file"), free_name(docs, "place_of_file")
    places = docs.sparkSession.createDataFrame([(x, k) for k, x in enumerate(sorted({_path(x) for x in files}))], f"{path} string, {place} long")
    indexed = docs.withColumns({path: F.regexp_replace(meta["file_path"], r"^(\w+):/+", "$1:/"), name: meta["row_index"]})
    known = F.coalesce(F.col(place), F.raise_error(F.concat(F.lit("a file that was not listed: "), F.col(path))).cast("long"))
    number = F.shiftleft(known, 40) + F.col(name)
    return indexed.join(F.broadcast(places), path, "left").withColumn(name, number).drop(path, place), name


def _is_scan(docs: DataFrame) -> bool:
    """Whether only projections and filters stand above one scan, so that a row of ``docs`` is a row of a file."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation"


def _path(uri: str) -> str:
    scheme, _, rest = uri.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}"


def chosen(docs: DataFrame, row_id: str, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose numbers are (``left_semi``) or aren't (``left_anti``) in ``rows`` (row_id), without the number."""
    some = rows.select(F.col("row_id").alias(row_id)).hint("shuffle_hash")
    return docs.join(some, row_id, how).drop(row_id)


def normal_words(text: Column) -> Column:
    """Lower-case words of letters, marks and digits with one space between; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets (from 0) of runs of rows of about ``most`` bytes; a longer row comes alone. Null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, every[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64, i below n or more; kept by the worker for chunks of the usual size."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, CHUNK_BYTES + 1)
    up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    if size <= 4 * CHUNK_BYTES:
        _powers[:] = [up, down]
    return up, down


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between spaces, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if n > 2 * CHUNK_BYTES:
        return _long_words(data, offsets)
    return _words(data, offsets)


def _long_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``words`` of a long row in pieces that end at spaces, so that the numbers for each byte are those of a piece."""
    n, a, parts, counts = len(data), 0, [], np.zeros(len(offsets), np.int64)
    while a < n:
        b = min(n, a + CHUNK_BYTES)
        while b < n and data[b] != 32 and not (space := np.flatnonzero(data[b : b + CHUNK_BYTES] == 32)).size:
            b = min(n, b + CHUNK_BYTES)
        b = b + int(space[0]) if b < n and data[b] != 32 else b
        inside = np.clip(offsets, a, b) - a
        hashes, first = _words(data[a:b], inside)
        parts.append(hashes)
        counts += first
        a = b
    return np.concatenate(parts), counts


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    letter = data != 32
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = letter[inner]
    ends[inner - 1] = letter[inner - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * up[:n], out=sums[1:])
    hashes = mixed((sums[b] - sums[a]) * down[a] + np.uint64(0x51ED270B))
    return hashes, np.searchsorted(a, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, one for each place that has k words after it."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mixed(out + hashes[i : i + n]) + np.uint64(i)
    return out


def file_at(uri: str):
    """An Arrow file system and the path in it, for local, HDFS and object-store addresses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
