"""From raw documents to a weighted mix: quality, exact and near duplicates, leaks, then the mix.

Each stage works on all rows that its predecessor kept. All but the last return the
columns they were given; the last returns each document's part in the mix.

A null text counts as empty, and empty texts are one document after exact dedup. Nulls in
other columns stay as they are; a row without ``doc_id`` has no label and goes through all
stages like any other, but loses to an equal row that has one. Rows that repeat, also under one ``doc_id``, are copies
of each other. An empty table gives no rows. Columns besides those of documents are carried
along, whatever their names. Each stage takes a very long text whole; see the operators for what it costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, exact_dedup, kneser_ney, mixing, order_minhash
from tidewatch.session import released, removed, stored, work_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's limit."""
    return kneser_ney.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space apart."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return order_minhash.deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document that is left."""
    return mixing.mixed(docs).drop("row_id")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("benchmark decontamination", clean),
    ("mixing", mix),
]

#: No SQL says what the classifier and the sketches decide; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{k}")
            if k:
                removed(spark, f"{folder}/{k - 1}")
            released(spark)
    return docs
