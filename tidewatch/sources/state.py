"""Dimensions, snapshots, bodies and state tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.functions.urls import first_url
from tidewatch.operators.snapshot import ROWS, SECTIONS

VERSION = "schema_version"


def read_dimension(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with exactly ``columns``: missing values are "", stray columns go."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in columns]).na.fill("")


def write_dimension(df: DataFrame, path: str, columns: list[str], sort: list[str] | None = None) -> None:
    """A CSV table with exactly ``columns``, missing values "". With ``sort`` its parts, by name, hold one order; none is gathered in a task."""
    out = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).na.fill("")
    (out.orderBy(*sort) if sort else out).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_marker(spark: SparkSession, folder: str, name: str, value: str, version: int) -> None:
    """A one-row table of a name's value, by version; a rerun of a version replaces its own."""
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/name={name}/version={version}")


def read_marker(spark: SparkSession, folder: str, name: str) -> str | None:
    """The value of a name's last version; None where it was never written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/name={name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.parquet(f"{folder}/name={name}").orderBy(F.col("version").desc()).select("value").first()
    return None if row is None else row[0]


def read_mute_list(spark: SparkSession, path: str) -> DataFrame:
    """mute_key, marked_at, title of a list of tab-separated lines; blank lines, lines without a key and those that begin with # go, the last of a key stays."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    rows = lines.select(part(0).alias("mute_key"), part(1).alias("marked_at"), part(2).alias("title"), F.monotonically_increasing_id().alias("at")).where("mute_key <> ''")
    return rows.groupBy("mute_key").agg(F.max_by("marked_at", "at").alias("marked_at"), F.max_by("title", "at").alias("title"))


def write_mute_list(df: DataFrame, path: str) -> None:
    """The stored form of a mute list (mute_key, marked_at, title), in order of the keys over the parts' names."""
    line = F.concat_ws("\t", "mute_key", F.coalesce("marked_at", F.lit("")), F.coalesce("title", F.lit("")))
    df.orderBy("mute_key").select(line.alias("value")).write.mode("overwrite").text(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One value a line; blank lines and lines that begin with # go."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("name")).where((F.col("name") != "") & ~F.startswith("name", F.lit("#")))


def parse_snapshots(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and sections of stored snapshots (source_id, text); a file without headers is rows, lines of fewer than three parts go."""
    lines = texts.select("source_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    w = Window.partitionBy("source_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    block = F.coalesce(F.last(F.when(F.col("line").isin(SECTIONS, ROWS), F.col("line")), ignorenulls=True).over(w), F.lit(ROWS))
    marked = lines.withColumn("block", block).where(~F.col("line").isin(SECTIONS, ROWS))
    parts = F.split("line", "\t", 3)
    rows = marked.where((F.col("block") == ROWS) & (F.size(parts) == 3)).select("source_id", *[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("section", "key", "value"))])
    return rows.withColumn("url", F.coalesce(first_url(F.col("value")), F.lit(""))), marked.where(F.col("block") == SECTIONS).select("source_id", F.col("line").alias("section"))


def read_snapshots(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]+$", 1)
    return parse_snapshots(spark.read.text(glob, wholetext=True).select(name.alias("source_id"), F.col("value").alias("text")))


def render_snapshots(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """source_id, text in the stored form: distinct and sorted, the same for the same snapshot. Each source is one small file."""
    line = F.concat_ws("\t", "section", "key", "value")
    a = sections.select("source_id", F.lit(0).alias("b"), F.col("section").alias("line"))
    b = rows.select("source_id", F.lit(1).alias("b"), line.alias("line"))
    every = a.unionByName(b).distinct().groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("b", "line"))).alias("x"))
    of = lambda k: F.transform(F.filter("x", lambda y: y["b"] == k), lambda y: y["line"])
    return every.select("source_id", F.concat(F.array_join(F.concat(F.array(F.lit(SECTIONS)), of(0), F.array(F.lit(ROWS)), of(1)), "\n"), F.lit("\n")).alias("text"))


def write_snapshots(rows: DataFrame, path: str, date: str) -> None:
    """Canonical snapshot rows of one date; a rerun replaces its date only."""
    out = rows.dropDuplicates(["source_id", "section", "key", "value"]).withColumn("snap_date", F.lit(date).cast("date"))
    out.repartition("snap_date", "source_id").sortWithinPartitions("source_id", "section", "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snap_date").parquet(path)


def decoded(content: Column) -> Column:
    """UTF-8 with replacement of what isn't."""
    return F.make_valid_utf8(content.cast("string"))


def read_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """source_id, body, size, sha256 of fetched files, undecoded bytes decoded with replacement."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("source_id"), decoded(F.col("content")).alias("body"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def attempt_facts(attempts: DataFrame, bodies: DataFrame) -> DataFrame:
    """source_id, body, size, sha256, final_url of attempts (source_id, size, requested and final if there are): no body is null, one of no bytes is "".

    The final address is the requested one where no redirect is known.

    Spark's file sources pass over files without bytes, so those follow from the attempt's own size.
    """
    empty_body = F.col("fetched") == 0
    there = [F.nullif(F.trim(c), F.lit("")) for c in ("final", "requested") if c in attempts.columns]
    final = F.coalesce(*there) if there else F.lit(None).cast("string")
    both = attempts.select("source_id", F.col("size").alias("fetched"), final.alias("final_url")).hint("merge").join(bodies.select("source_id", "body", "size", "sha256"), "source_id", "left")
    return both.select("source_id", "final_url", F.coalesce("body", F.when(empty_body, "")).alias("body"), F.coalesce("size", "fetched").alias("size"), F.coalesce("sha256", F.when(empty_body, F.sha2(F.lit("").cast("binary"), 256))).alias("sha256"))


def write_stage(df: DataFrame, path: str, run_date: str, version: int) -> None:
    """A stage's table of one run: replaces that run's rows only and says its version."""
    df.withColumns({VERSION: F.lit(version), "run_date": F.lit(run_date).cast("date")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def read_stage(spark: SparkSession, path: str, run_date: str, version: int, columns: list[str]) -> DataFrame:
    """A run's table; another version, a missing run or missing columns are refused."""
    df = spark.read.parquet(path).where(F.col("run_date") == F.lit(run_date).cast("date"))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    found = df.agg(F.min(VERSION).alias("a"), F.max(VERSION).alias("b")).first()
    if found["a"] is None:
        raise ValueError(f"{path} has no run of {run_date}")
    if (found["a"], found["b"]) != (version, version):
        raise ValueError(f"{path} is of version {found['a']}, not {version}")
    return df.select(*columns)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def record_history(df: DataFrame, path: str) -> None:
    """Rows by ``date``; a rerun of a date replaces its own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def with_cache(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """URLs with their cached text and whether it is a hit: a miss isn't an empty body."""
    hit = cache.select("url_key", "text", F.lit(True).alias("hit"))
    out = wanted.withColumn("url_key", F.sha1(F.col("url").cast("binary"))).join(hit, "url_key", "left")
    return out.select("url", "text", F.coalesce("hit", F.lit(False)).alias("hit"))


def empty(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
