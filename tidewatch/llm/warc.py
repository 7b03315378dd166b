"""WARC archives with a two-level capture index.

Records are gzip members, so that a range of a file is a whole record. Of captures
with equal payloads of at least ``least`` bytes the one with the largest ``page_id``
(then the row read first) is a response, others are revisits of it.

The index: lines sorted by reversed-host key and page id, range-partitioned over
files of about ``PART_LINES``; each file is a row of gzip blocks of ``BLOCK_LINES`` lines. A directory has one
entry for each block: its first key, offset and length. A lookup finds the index part
among the parts' first keys, the block by binary search in that part's directory, and
reads one block, then one record, by range.

Null html is an empty payload, a null url is written as ``urn:page:<id>``, a null
page_id loses ties and refers as null. Repeated rows are records of their own. Empty
tables give no rows; other columns are not read. Control characters in urls are
percent-encoded in headers. Files belong to one task attempt and count only through
the tables that name them. A very long payload is one record, held whole by its task.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import file_at, numbered
from tidewatch.session import stored, work_folder

BLOCK_LINES = 500
#: Lines of an index part, and so lookups that one task holds.
PART_LINES = 200_000
RANGE_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("8c0d4c1e-7c55-4d5f-9f0e-3f5a5f0f5b11")


def surt(url: str | None) -> str:
    """Reversed-host key: ``https://www.a.b.org/x?y#z`` gives ``org,b,a)/x?y``."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    try:
        at = urlsplit(url)
        host = (at.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (at.path or "/") + (f"?{at.query}" if at.query else "")


def record_id(row_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(row_id))}>"


def record(kind: str, row_id: int, page_id, url, payload: bytes, n_bytes: int, digest: str, refers=None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head, whose length is the full payload's, and no payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(row_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers[0])}", f"X-Refers-To-Page: {'' if refers[1] is None else refers[1]}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Headers, HTTP head's length and payload of one record, by its lengths."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"headers": headers, "n_bytes": n, "payload": payload}


def _number(x):
    return None if x is None or pd.isna(x) else int(x)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the records; a row for each: row_id, page_id, key, file, offset, length, digest, kind."""
    html = F.coalesce("html", F.lit(""))
    pages, row_id = numbered(pages)
    rows = pages.select(F.col(row_id).alias("row_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("n_bytes"))
    rank = F.struct("page_id", F.bitwise_not("row_id").alias("r_row"))
    best = rows.where(F.col("n_bytes") >= least).groupBy("sha1").agg(F.max(rank).alias("best"))
    # the side without payloads is held in memory; one payload may be that of a third of the pages, whose partition Spark splits
    marked = rows.join(best.hint("shuffle_hash"), "sha1", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{folder}/archives/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fs, path = file_at(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        at = 0
        with fs.open_output_stream(path, compression=None) as f:
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    page, first, best_page = _number(r.page_id), _number(r.best_row), _number(r.best_page)
                    digest = base64.b32encode(bytes.fromhex(r.sha1)).decode()
                    again = first is not None and first != r.row_id
                    whole = record("revisit" if again else "response", r.row_id, page, r.url, b"" if again else r.html.encode(), r.n_bytes, digest, (first, best_page) if again else None)
                    member = gzip.compress(whole, 6, mtime=0)
                    f.write(member)
                    out.append((r.row_id, page, surt(r.url or f"urn:page:{page}"), name, at, len(member), digest, "revisit" if again else "response"))
                    at += len(member)
                yield pd.DataFrame(out, columns=["row_id", "page_id", "key", "file", "offset", "length", "digest", "kind"]).astype({"page_id": "Int64"})

    flat = marked.select("row_id", "page_id", "url", "html", "sha1", "n_bytes", F.bitwise_not("best.r_row").alias("best_row"), F.col("best.page_id").alias("best_page"))
    return stored(flat.mapInPandas(write, "row_id long, page_id long, key string, file string, offset long, length long, digest string, kind string"), f"{folder}/records")


def line_key(key, page_id, row_id):
    """Sort key of an index line: the page id and row after the url's key split a url with very many captures."""
    return F.concat_ws(" ", key, F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")), F.lpad(row_id.cast("string"), 20, "0"))


def build_index(records: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write index files; the directory has a row for each block: part, file, first, offset, length."""
    parts = max(records.sparkSession.sparkContext.defaultParallelism, -(-records.count() // PART_LINES))
    lines = records.select(line_key(F.col("key"), F.col("page_id"), F.col("row_id")).alias("line"), "file", "offset", "length", "digest", "kind")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{folder}/index/part-{task.partitionId():06d}-{task.taskAttemptId()}.cdx.gz"
        fs, path = file_at(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        at, held, out = 0, [], []
        with fs.open_output_stream(path, compression=None) as f:

            def flush(lines: list[tuple]) -> None:
                nonlocal at
                block = gzip.compress("".join("\t".join(map(str, x)) + "\n" for x in lines).encode(), 6, mtime=0)
                f.write(block)
                out.append((task.partitionId(), name, lines[0][0], at, len(block)))
                at += len(block)

            for batch in batches:
                held += batch.itertuples(index=False, name=None)
                while len(held) >= block_lines:
                    flush(held[:block_lines])
                    del held[:block_lines]
            if held:
                flush(held)
        yield pd.DataFrame(out, columns=["part", "file", "first", "offset", "length"])

    dealt = lines.repartitionByRange(parts, "line").sortWithinPartitions("line")
    return stored(dealt.mapInPandas(write, "part int, file string, first string, offset long, length long"), f"{folder}/directory")


def located(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """row_id, file, offset, length of the record that each wanted index line names.

    The parts' first keys, one for each index file, go to every task; a part's
    directory goes only to the task with that part's lookups.
    """
    tops = [tuple(x) for x in directory.groupBy("part").agg(F.min("first").alias("first")).orderBy("first").collect()]
    ids, firsts = [x[0] for x in tops], [x[1] for x in tops]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(part=[ids[max(0, bisect.bisect_right(firsts, x) - 1)] for x in batch["line"]])

    def search(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values("first")
        keys, out = entries["first"].tolist(), []
        asked = asked.sort_values("line")
        asked = asked.assign(block=[bisect.bisect_right(keys, x) - 1 for x in asked["line"]])
        for block, some in asked.groupby("block"):
            if block < 0:
                continue
            e = entries.iloc[block]
            fs, path = file_at(e["file"])
            with fs.open_input_file(path) as f:
                lines = gzip.decompress(f.read_at(int(e["length"]), int(e["offset"]))).decode().split("\n")[:-1]
            first = [x[: x.index("\t")] for x in lines]
            for row_id, line in zip(some["row_id"], some["line"], strict=True):
                k = bisect.bisect_left(first, line)
                if k < len(first) and first[k] == line:
                    _, file, offset, length, _, _ = lines[k].split("\t")
                    out.append((row_id, file, int(offset), int(length)))
        return pd.DataFrame(out, columns=["row_id", "file", "offset", "length"])

    asked = wanted.mapInPandas(deal, "row_id long, line string, part int").groupBy("part")
    return directory.groupBy("part").cogroup(asked).applyInPandas(search, "row_id long, file string, offset long, length long")


def read_records(places: DataFrame, tasks: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records at file, offset, length."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, some in batch.groupby("file", sort=False):
                fs, path = file_at(file)
                with fs.open_input_file(path) as f:
                    for offset, length in zip(some["offset"], some["length"], strict=True):
                        got = parsed(gzip.decompress(f.read_at(int(length), int(offset))))
                        head, kind = got["headers"], got["headers"]["WARC-Type"]
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(got["payload"]) != got["n_bytes"] or base64.b32encode(hashlib.sha1(got["payload"]).digest()).decode() != digest):
                            raise ValueError(f"record at {file}:{offset} does not match its digest")
                        out.append((_number(head["X-Page-Id"] or None), got["n_bytes"], digest, kind, _number(head.get("X-Refers-To-Page") or None)))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    near = places.repartition(tasks, "file", F.floor(F.col("offset") / F.lit(RANGE_BYTES))).sortWithinPartitions("file", "offset")
    return near.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives and an index, look every page up and read its record back."""
    folder = folder or work_folder(pages.sparkSession, "warc")
    records = write_archives(pages, folder, least)
    directory = build_index(records, folder)
    wanted = records.select("row_id", line_key(F.col("key"), F.col("page_id"), F.col("row_id")).alias("line"))
    # index rows are small but stand for payloads: the number of tasks follows the bytes that they name
    n_bytes = records.agg(F.sum("length")).first()[0] or 0
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // RANGE_BYTES))
    return read_records(located(wanted, directory), tasks)


def query(spark, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
