r"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Each version of a file is a row (path, text). Its blob is named by the SHA-256 of
its content. The ledger holds the pairs of blob and rule version scanned so far,
the findings table what those scans found. A scan takes from new versions the
distinct blobs whose pair with any rule version isn't in the ledger, runs those
rules, appends to both tables, and joins findings back to all paths of a blob.

Positions come from two built-ins of the same regex engine: ``split`` gives the
text between matches, ``regexp_extract_all`` the matches; their running lengths
are the starts. All counts are code points, ends exclusive.

Null text counts as empty and has no findings; a null path stays a path of its
own. Repeated rows share one blob and each get its findings. Empty tables give no
rows; other columns are not read. A very long text is scanned whole in one task; its
findings are gathered in portions of ``PORTION``, so their number squared is never copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import numbered
from tidewatch.session import stored, work_folder

#: Kind, version, hint that every match holds (lower case), pattern, group to measure, least length of it.
RULES = [
    ("assign", 1, None, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, "AKIA", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 1, None, r"[0-9a-f]{24,}", 0, 24),
    ("pem", 1, "-----BEGIN", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("grant", 1, "gh", r"gh[opsur]_[A-Za-z0-9]+", 0, 36),
]
BASE = ("assign", "access", "hex")
ORDER = {kind: k for k, (kind, *_) in enumerate(RULES)}
PORTION = 512
FINDING = "array<struct<start:bigint,k:int,kind:string,end:bigint>>"
SCANS = f"blob string, rules array<string>, found {FINDING}"


def _none() -> Column:
    return F.expr(f"CAST(array() AS {FINDING})")


def rule_key(rule) -> str:
    return f"{rule[0]}:{rule[1]}"


def matches(text: Column, rule) -> Column:
    """The rule's matches in ``text`` as an array of start, k, kind, end."""
    kind, _, hint, pattern, group, least = rule
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"),
        whole.alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.array(F.struct(begin.alias("start"), F.lit(ORDER[kind]).alias("k"), F.lit(kind).alias("kind"), end.alias("end"))).cast(FINDING)
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def gather(acc: Column, portion: Column) -> Column:
        return F.struct(portion["at"].alias("at"), F.concat(acc["found"], portion["found"]).alias("found"))

    def folded(hits: Column) -> Column:
        fold = lambda acc, at: F.aggregate(F.slice(hits, at, F.lit(PORTION)), F.struct(acc["at"].alias("at"), _none().alias("found")), step)
        begins = F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(PORTION))
        # a portion is bound by a lambda of its own, as an expression that stands twice is evaluated twice
        return F.aggregate(begins, start, lambda acc, at: F.get(F.transform(F.array(fold(acc, at)), lambda x: gather(acc, x)), F.lit(0)))

    likely = text.rlike(pattern) if hint is None else F.contains(text, F.lit(hint)) & text.rlike(pattern)
    return F.when(likely, F.get(F.transform(F.array(parts), folded), F.lit(0))["found"]).otherwise(_none())


class Ledger:
    """A table below one folder: each row is a blob, the rule versions it was scanned with, and what they found.

    One append commits the pairs and their findings together.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.path = spark, f"{folder}/scans"

    def scans(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(SCANS).parquet(self.path) if there else self.spark.createDataFrame([], SCANS)

    def findings(self) -> DataFrame:
        """blob, found: what all scans of a blob found, by start."""
        hits = self.scans().where(F.size("found") > 0)
        return hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))

    def scan(self, texts: DataFrame, blobs: DataFrame, rules=RULES) -> None:
        """Scan the blobs' unseen pairs. texts: row_id, text; blobs: row_id, blob of the same rows."""
        keys = F.array(*[F.lit(rule_key(r)) for r in rules])
        done = self.scans().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        one = blobs.groupBy("blob").agg(F.min("row_id").alias("row_id"))
        todo = F.array_except(keys, F.coalesce("done", F.expr("CAST(array() AS array<string>)")))
        fresh = one.hint("merge").join(done, "blob", "left").select("row_id", "blob", todo.alias("todo")).where(F.size("todo") > 0)
        # the side without texts is the one that is held in memory, so no text is sorted
        named = texts.join(fresh.hint("shuffle_hash"), "row_id")
        found = [F.when(F.array_contains("todo", rule_key(r)), matches(F.col("text"), r)).otherwise(_none()) for r in rules]
        named.select("blob", F.col("todo").alias("rules"), F.array_sort(F.concat(*found)).alias("found")).write.mode("append").parquet(self.path)


def versions_of(docs: DataFrame) -> DataFrame:
    docs, row_id = numbered(docs)
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col(row_id).alias("row_id"), "doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))


def scanned(docs: DataFrame, folder: str, increments: int = 2, rules=RULES) -> DataFrame:
    """row_id, doc_id, blob, found for each row of ``docs``, scanned in increments into the ledger at ``folder``."""
    spark = docs.sparkSession
    versions = versions_of(docs)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(increments)).alias("part")
    paths = stored(versions.select("row_id", "doc_id", "blob", part), work_folder(spark, "paths"))
    ledger = Ledger(spark, folder)
    for k in range(increments):
        texts = versions.select("row_id", "text", part).where(F.col("part") == k).drop("part")
        ledger.scan(texts, paths.where(F.col("part") == k), rules)
    # one blob may be the content of a third of all paths: a merge join, whose large partitions Spark splits
    found = paths.hint("merge").join(ledger.findings(), "blob", "left")
    return found.select("row_id", "doc_id", "blob", F.coalesce("found", _none()).alias("found"))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scanned(docs, work_folder(spark, "ledger"))
    count = [F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in BASE]  # noqa: B023
    base = F.filter("found", lambda x: x["k"] < len(BASE))
    return found.select("doc_id", *count, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))


def _sql() -> str:
    def found(rule) -> str:
        kind, _, _, pattern, group, least = rule
        p = pattern.replace("'", "''")
        hits = f"regexp_extract_all(text, '{p}', 0)"
        return f"""
  SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
      'start': list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0),
      'n': length(hits[i]), 'part': length(parts[i])}})) AS m, {ORDER[kind]} AS k, '{kind}' AS kind, {least} AS least
  FROM (SELECT doc_id, {hits} AS hits, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', {group}) AS parts
        FROM documents WHERE regexp_matches(text, '{p}'))"""

    spans = " UNION ALL ".join(found(r) for r in RULES)
    return f"""
WITH m AS ({spans}),
f AS (SELECT doc_id, k, kind, m['start']::BIGINT AS s, kind || ':' || m['start']::BIGINT || ':' || (m['start'] + m['n'])::BIGINT AS t FROM m WHERE m['part'] >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(t, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base, string_agg(t, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
