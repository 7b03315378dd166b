"""Incremental snapshot diff and once-a-date delivery by micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import snapshot as SN
from tidewatch.session import removed, stored

BUCKETS = 256
COLUMNS = ["source_id", "section", "key", "value", "url"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers n of a folder's entries version=n; the names are listed, nothing is read."""
    p, fs = _path(spark, folder)
    return sorted(int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(p)) if fs.exists(p) else []


class Baseline:
    """The last good snapshot of each source, by hash bucket of the source, below one folder.

    Bucket b of version n is data/version=n/bucket=b. The manifest of a version, a row for
    each bucket, names the version in which the bucket was last written, so a new version
    rewrites only the buckets that it touches. ``buckets`` is fixed when a folder is begun.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("source_id"), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket to version, of the last version, or of the last one before ``before``: what a retry of that batch saw."""
        found = [n for n in _versions(self.spark, f"{self.folder}/manifest") if before is None or n < before]
        if not found:
            return {}
        rows = self.spark.read.schema("bucket int, written long").parquet(f"{self.folder}/manifest/version={found[-1]}")
        return {r["bucket"]: r["written"] for r in rows.collect()}

    def rows(self, manifest: dict[int, int], buckets=None) -> DataFrame:
        """Snapshot rows of all buckets of a manifest, or of some; others aren't opened."""
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(manifest.items()) if buckets is None or b in buckets]
        # a bucket whose rows have all gone has no folder
        paths = [p for p in paths if _there(self.spark, p)]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def commit(self, rows: DataFrame, touched: list[int], manifest: dict[int, int], version: int) -> None:
        """Write ``rows``, all of the touched buckets, then the manifest that makes them current."""
        out = rows.select(*COLUMNS, self.bucket().alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "source_id", "section", "key")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={version}")
        entries = sorted({**manifest, **dict.fromkeys(touched, version)}.items())
        self.spark.createDataFrame(entries, "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the last ``keep``, and the buckets that none of those names."""
        manifests = _versions(self.spark, f"{self.folder}/manifest")
        removed(self.spark, *[f"{self.folder}/manifest/version={n}" for n in manifests[:-keep]])
        named = {(v, b) for n in manifests[-keep:] for b, v in self.manifest(n + 1).items()}
        for v in _versions(self.spark, f"{self.folder}/data"):
            if manifests and v <= manifests[-1]:
                p, fs = _path(self.spark, f"{self.folder}/data/version={v}")
                own = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket=")]
                gone = [x for x in own if (v, int(x.getName().partition("=")[2])) not in named]
                removed(self.spark, *([p.toString()] if len(gone) == len(own) else [x.toString() for x in gone]))


def diff_stream(rows: DataFrame, folder: str, checkpoint: str, ok_sources=None, buckets: int = BUCKETS) -> StreamingQuery:
    """Diff each batch of new source versions (source_id, section, key, value, url) with the last good ones.

    Changes of batch n go to changes/version=n, the touched buckets of the next baseline
    to its version n; a retry overwrites both with equal rows. ``ok_sources`` (batch to
    source_ids) names the sources whose version is good; without it all are.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        base = Baseline(spark, folder, buckets)
        # read by several steps, so they are written
        work = f"{folder}/batches/version={n}"
        new = stored(batch.select(*COLUMNS), f"{work}/rows", "overwrite")
        good = stored((ok_sources(new) if ok_sources else new.select("source_id")).select("source_id").distinct(), f"{work}/good", "overwrite")
        # at most one number for each bucket
        touched = sorted(r["b"] for r in good.select(base.bucket().alias("b")).distinct().collect())
        manifest = base.manifest(n)
        old = base.rows(manifest, set(touched))
        new_good = new.hint("merge").join(good, "source_id", "left_semi")
        before = old.hint("merge").join(good, "source_id", "left_semi")
        SN.diff(before, new_good).write.mode("overwrite").parquet(f"{folder}/changes/version={n}")
        base.commit(SN.committed(old, new_good, good.withColumn("ok", F.lit(True))), touched, manifest, n)
        removed(spark, work)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliver_once(digests: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """At most one digest a date (date, body): dates delivered by earlier batches are skipped, a retry rewrites its own."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("date").agg(F.min("body").alias("body"))
        if _there(spark, f"{folder}/delivered"):
            done = spark.read.parquet(f"{folder}/delivered").where(F.col("batch") < n).select("date").distinct()
            new = new.join(done, "date", "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/delivered/batch={n}")

    return digests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
