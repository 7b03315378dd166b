"""Token counts by a separator scan over flat, unindexed token files.

``write_tokens`` puts each task's documents one after the other into a flat file of
16- or 32-bit token ids, an end-of-document id after each; a manifest says which
document has which place in which file. A file belongs to one task attempt and counts
only through the manifest, so retried or lost tasks leave no wrong tokens.

``separators`` knows nothing but the files: it reads them in blocks of equal size,
finds the end-of-document ids of a block with one vector comparison, and stitches
blocks together with a prefix scan: separators before the block give a document's
place, the last separator before it where the first document began.

Null texts are empty and have 0 tokens; a text that spells the end-of-document token is
ordinary text. Empty tables give no rows; other columns are not read; repeated rows
and null ids each get their count. A very long text is encoded whole in its task, also one of
white space alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.flat import file_at
from tidewatch.session import stored, work_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of the pattern's ``\\s`` of more than this many characters are cut out before splitting.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{500,}")
BLOCK_TOKENS = 1 << 20


@lru_cache(maxsize=1)
def _encoding(ranks: bytes, split: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=split, mergeable_ranks=table, special_tokens={})


def tokens_of(encoding, text: str) -> list[int]:
    """The tokens of a text. Long runs of white space, on which the splitting pattern would overflow its stack, are pieces cut out before.

    The pattern makes one piece of all white space but the last character before a word, and of
    all of it at the text's end, so these tokens are those of the uncut text.
    """
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def id_type(end_id: int) -> str:
    return "<u2" if end_id < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, split: str = SPLIT, end_id: int = 50256) -> DataFrame:
    """Write the flat files below ``folder``; the manifest: file, place, doc_id, and per file a row with place -1 and n_bytes."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()  # the driver reads it, tasks get its bytes: about a megabyte
    kind = id_type(end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, split)
        task = TaskContext.get()
        name = f"{folder}/tokens/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        fs, path = file_at(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        place = size = 0
        with fs.open_output_stream(path, compression=None) as out:
            for batch in batches:
                texts = batch.column(1)
                for a in range(0, len(texts), 256):
                    some = []
                    for text in texts.slice(a, 256).to_pylist():
                        some += tokens_of(encoding, text or "")
                        some.append(end_id)
                    size += out.write(np.array(some, kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array(range(place, place + len(texts)), pa.int64()), batch.column(0), pa.array([None] * len(texts), pa.int64())], ["file", "place", "doc_id", "n_bytes"])
                place += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([size], pa.int64())], ["file", "place", "doc_id", "n_bytes"])

    return stored(docs.select("doc_id", "text").mapInArrow(write, "file string, place long, doc_id long, n_bytes long"), f"{folder}/manifest")


def separators(files: DataFrame, end_id: int = 50256, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, place, n_tokens for each document in ``files`` (file, n_bytes)."""
    kind = id_type(end_id)
    width = np.dtype(kind).itemsize

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for file, block in zip(batch["file"], batch["block"], strict=True):
                fs, path = file_at(file)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(block_tokens * width, block * block_tokens * width), kind)
                found.append(np.flatnonzero(ids == end_id) + block * block_tokens)
            yield pd.DataFrame({"file": batch["file"], "block": batch["block"], "ends": found})

    n = F.ceil(F.col("n_bytes") / F.lit(block_tokens * width))
    blocks = files.where("n_bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    dealt = blocks.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "file", "block")
    scanned = dealt.mapInPandas(scan, "file string, block long, ends array<long>").where(F.size("ends") > 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.withColumns({
        "first_place": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        "carried": F.coalesce(F.last(F.element_at("ends", -1)).over(before), F.lit(-1)),
    })
    starts = F.concat(F.array("carried"), F.slice("ends", F.lit(1), F.size("ends") - 1))
    pairs = F.arrays_zip(starts.alias("a"), F.col("ends").alias("b"))
    return stitched.select("file", "first_place", F.posexplode(pairs).alias("k", "x")).select("file", (F.col("first_place") + F.col("k")).alias("place"), (F.col("x.b") - F.col("x.a") - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, folder: str | None = None, block_tokens: int = BLOCK_TOKENS, **options) -> DataFrame:
    """doc_id, n_tokens for each row of ``docs``."""
    folder = folder or work_folder(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, folder, **options)
    files = manifest.where("place < 0").select("file", "n_bytes")
    counted = separators(files, options.get("end_id", 50256), block_tokens)
    return manifest.where("place >= 0").select("file", "place", "doc_id").hint("merge").join(counted, ["file", "place"], "left").select("doc_id", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
