"""Which watched page covers which program, candidates for new sources, and batch additions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.functions.text import slug
from tidewatch.operators.places import placed
from tidewatch.packs import recruiting
from tidewatch.session import stored, work_folder


def covering(targets: DataFrame, watched: DataFrame) -> DataFrame:
    """target_id, source_id, how: an explicit source first, then the longest watched path that is the target's or a parent of it.

    targets: target_id, url, source_id; watched: source_id, url, ord. Parent paths are
    exploded, so the join is an equality.
    """
    known = watched.select(F.col("source_id").alias("known"), F.lit(True).alias("there"))
    named = targets.where("coalesce(source_id, '') <> ''").hint("merge").join(known, F.col("source_id") == F.col("known"), "left")
    explicit = named.select("target_id", "source_id", F.when(F.col("there"), "explicit").otherwise("dangling").alias("how"))
    parents = targets.where("coalesce(source_id, '') = ''").select("target_id", F.posexplode(urls.prefixes(urls.canonical(F.col("url")))).alias("up", "path"))
    pages = watched.select("source_id", "ord", urls.canonical(F.col("url")).alias("path")).where(F.contains("path", F.lit("/")))
    # of the pages of one path only the first can cover anything, so no path pairs all of its targets with all of its pages
    first = pages.groupBy("path").agg(F.min_by("source_id", "ord").alias("source_id"))
    met = parents.where("path <> ''").hint("merge").join(first, "path").groupBy("target_id").agg(F.min_by(F.struct("source_id", "up"), "up").alias("x")).select("target_id", "x.*")
    return explicit.unionByName(met.select("target_id", "source_id", F.when(F.col("up") == 0, "same page").otherwise("parent page").alias("how")))


def partitioned(targets: DataFrame, covered: DataFrame) -> DataFrame:
    """Every target with why it is left out of hand checking (covered) or kept ("" or a warning); none vanishes."""
    out = targets.hint("merge").join(covered.withColumnRenamed("source_id", "by"), "target_id", "left")
    why = F.when(F.col("how").isNull(), "").when(F.col("how") == "dangling", "kept: names a source that is not there").otherwise(F.concat(F.lit("covered by "), "by"))
    return out.withColumn("why", why)


def reasons(parts: DataFrame) -> DataFrame:
    kind = F.when(F.col("why") == "", "hand check").when(F.startswith("why", F.lit("kept")), "kept with warning").otherwise("covered")
    return parts.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def first_finds(found: DataFrame, order: list[str]) -> DataFrame:
    """One row of each candidate key: the first find, with its evidence."""
    return found.withColumn("__n", F.row_number().over(Window.partitionBy("kind", "key").orderBy(*order))).where("__n = 1").drop("__n")


def fingerprints(pages: DataFrame, boards=recruiting.BOARDS, not_slugs=recruiting.NOT_SLUGS, text: str = "html") -> DataFrame:
    """page_id, method, slug, first: every board that a page's text names, with the spelling of its first mention.

    boards: method, a part of an address that each of its patterns holds, and the
    pattern, whose group 1 is the slug. A page's text is cut at quotes and white space once;
    only the pieces that hold one of those parts are tried, each by the patterns of its part.
    """
    hints = list(dict.fromkeys(hint for _, hint, _ in boards))
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), r"""[\s"']+"""), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(h)) for h in hints]))
    some = pages.select("page_id", F.posexplode(F.array_distinct(pieces)).alias("at", "piece"))
    none = F.array().cast("array<struct<method:string,slug:string,ord:int>>")
    one = lambda k, method, hint, pattern: F.when(F.contains("piece", F.lit(hint)), F.transform(F.regexp_extract_all("piece", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(method).alias("method"), x.alias("slug"), F.lit(k).alias("ord")))).otherwise(none)
    hits = some.select("page_id", "at", F.explode(F.concat(*[one(k, *x) for k, x in enumerate(boards)])).alias("x")).select("page_id", "at", "x.*")
    good = hits.where((F.col("slug") != "") & ~F.lower("slug").isin(*not_slugs))
    return good.groupBy("page_id", "method", F.lower("slug").alias("key")).agg(F.min_by("slug", F.struct("ord", "at")).alias("first")).select("page_id", "method", F.col("key").alias("slug"), "first")


def fresh(candidates: DataFrame, *known: DataFrame) -> DataFrame:
    """Candidates that no table of known keys (kind, key) has."""
    for table in known:
        candidates = candidates.hint("merge").join(table.select("kind", "key").distinct(), ["kind", "key"], "left_anti")
    return candidates


def triaged(candidates: DataFrame, judgments: DataFrame) -> DataFrame:
    """Adds status: discarded only for a literal "low"; a missing or malformed judgment keeps."""
    joined = candidates.hint("merge").join(judgments.select("kind", "key", "priority"), ["kind", "key"], "left")
    low = F.coalesce(F.lower(F.trim("priority")) == "low", F.lit(False))
    return joined.withColumn("status", F.when(low, "discarded").otherwise("proposed"))


def repositories(found: DataFrame, as_of: Column, stars: int = 25, days: int = 120) -> DataFrame:
    """Live repositories: neither archived nor a fork, starred and pushed to lately; a bad date drops."""
    age = F.datediff(as_of, F.try_to_date(F.substring("pushed_at", 1, 10), "yyyy-MM-dd"))
    return found.where(~F.coalesce("archived", F.lit(False)) & ~F.coalesce("fork", F.lit(False)) & (F.coalesce("stars", F.lit(0)) >= stars) & F.coalesce(age <= days, F.lit(False)))


def due(last_run: Column, as_of: Column, days: int = 7) -> Column:
    """On every Monday; else a week after the last run, if that can be read."""
    since = F.datediff(as_of, F.try_to_date(last_run, "yyyy-MM-dd"))
    return (F.dayofweek(as_of) == 2) | F.coalesce(since >= days, F.lit(False))


def problems(entries: DataFrame) -> DataFrame:
    """Entries (name, url, status, by_agent) with all that is wrong with each; an agent may not assert YES."""
    said = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "no name"),
        F.when(~F.coalesce(F.col("url").rlike("^https?://[^/]+"), F.lit(False)), "no web address"),
        F.when(F.coalesce("by_agent", F.lit(False)) & (F.upper(F.coalesce("status", F.lit(""))) == "YES"), "an agent may not assert YES"),
    ))
    return entries.withColumn("problems", said)


ROUTES = ("programs", "sources", "manual", "priority")


def new_entries(existing: DataFrame, entries: DataFrame) -> DataFrame:
    """The first of the entries of each trimmed lower-case name that ``existing`` (name) doesn't have; adds ``name_key``."""
    key = F.lower(F.trim("name"))
    first = entries.withColumn("name_key", key).withColumn("n", F.row_number().over(Window.partitionBy("name_key").orderBy("ord"))).where("n = 1").drop("n")
    return first.hint("merge").join(existing.select(key.alias("name_key")).distinct(), "name_key", "left_anti")


def added(existing: DataFrame, entries: DataFrame, folder: str | None = None) -> DataFrame:
    """Entries that are new by trimmed lower-case name, once each, ranked on from the existing ones; none at all if any has a problem."""
    if problems(entries).where(F.size("problems") > 0).take(1):
        entries = entries.limit(0)
    new = new_entries(existing, entries).drop("name_key")
    top = existing.agg(F.max("rank")).first()[0] or 0
    return ranked_on(new, top, folder)


def ranked_on(new: DataFrame, top: int, folder: str | None = None) -> DataFrame:
    """Adds ``rank``: top + 1 and on, in order of ``ord``."""
    folder = folder or work_folder(new.sparkSession, "ranks")
    found = placed(new, [], [F.col("ord").asc()], folder, "rank")
    return found.withColumn("rank", (F.col("rank") + top + 1).cast("int"))


def routed(entries: DataFrame, tables: dict[str, DataFrame], today: Column, folder: str | None = None) -> dict[str, DataFrame]:
    """The rows that a batch of entries adds to each table of ``ROUTES``, by table; existing rows are never touched.

    entries: ord, name, url, category, notes, eligible, status, by_agent, and source
    (struct<source_id, method, tier, signal>), manual (struct<why_manual, how_to_check, when_to_check>)
    and priority (struct<band, value, why>), null where the entry isn't meant for that table. A program is
    new by trimmed lower-case name; only new programs go on to the other tables, there again by
    name, sources by id. A source without an id gets the program's slug, numbered on where
    it is taken. Priority rows are ranked on from the greatest rank. Any problem of any entry refuses the batch.
    """
    folder = folder or work_folder(entries.sparkSession, "routes")
    if problems(entries).where(F.size("problems") > 0).take(1):
        entries = entries.limit(0)
    new = stored(new_entries(tables["programs"], entries), f"{folder}/new")
    name = F.trim("name").alias("name")
    sources = with_source_ids(new.where("source IS NOT NULL"), tables["sources"])
    ids = stored(sources, f"{folder}/sources")
    programs = new.hint("merge").join(ids.select("name_key", "source_id"), "name_key", "left")
    manual = new_entries(tables["manual"], new.where("manual IS NOT NULL"))
    first = tables["priority"].agg(F.max(F.expr("try_cast(rank AS int)"))).first()[0] or 0
    ranked = ranked_on(new_entries(tables["priority"], new.where("priority IS NOT NULL")), first, f"{folder}/ranks")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return {
        "programs": programs.select("ord", name, F.col("url").alias("website"), "category", F.coalesce(F.nullif(F.trim("eligible"), F.lit("")), F.lit("CHECK")).alias("eligible"), text("notes").alias("notes"), text("source_id").alias("source_id"), F.lit("unknown").alias("status"), today.cast("string").alias("first_seen"), F.lit("false").alias("muted")),
        "sources": ids.where("is_new").select("ord", "source_id", F.coalesce("source.tier", F.lit("3")).alias("tier"), F.coalesce("source.method", F.lit("page_text")).alias("method"), "url", name.alias("program_names"), F.coalesce("source.signal", F.lit("high")).alias("signal"), F.lit("0").alias("consecutive_failures")),
        "manual": manual.select("ord", name, "category", "url", text("manual.why_manual").alias("why_manual"), F.coalesce("manual.how_to_check", F.lit("Open the page in your browser.")).alias("how_to_check"), text("manual.when_to_check").alias("when_to_check")),
        "priority": ranked.select("ord", F.col("rank").cast("string").alias("rank"), text("priority.band").alias("band"), name, "category", F.coalesce("priority.value", F.lit("Medium")).alias("value"), text("priority.why").alias("why"), "url"),
    }


def with_source_ids(new: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``source_id`` and ``is_new`` to entries: a stated id that is known, or that an earlier entry states, adds no source; a slug that is taken is numbered on."""
    stated = F.nullif(F.trim("source.source_id"), F.lit(""))
    base = F.when(slug(F.col("name")) == "", "source").otherwise(slug(F.col("name")))
    known = sources.select(F.col("source_id").alias("base")).distinct()
    rows = new.withColumns({"stated": stated.isNotNull(), "base": F.coalesce(stated, base)})
    # ids that the entries state are taken too, before any slug
    said = rows.where("stated").select("base").distinct()
    used = known.unionByName(said).select(F.regexp_extract("base", r"^(.*?)(?:-(\d+))?$", 1).alias("stem"), "base").unionByName(known.unionByName(said).select(F.col("base").alias("stem"), "base"))
    names = used.groupBy("stem").agg(F.collect_set("base").alias("used"))
    first = F.row_number().over(Window.partitionBy("stated", "base").orderBy("ord"))
    met = rows.withColumn("nth", first).hint("merge").join(known.withColumn("known", F.lit(True)), "base", "left").hint("merge").join(names, F.col("base") == F.col("stem"), "left")
    free = F.filter(F.concat(F.array("base"), F.transform(F.sequence(F.lit(2), F.coalesce(F.size("used"), F.lit(0)) + F.col("nth") + 1), lambda k: F.concat("base", F.lit("-"), k.cast("string")))), lambda x: ~F.array_contains(F.coalesce("used", F.array().cast("array<string>")), x))
    chosen = F.when(F.col("stated"), F.col("base")).otherwise(F.get(free, F.col("nth") - 1))
    is_new = F.when(F.col("stated"), F.col("known").isNull() & (F.col("nth") == 1)).otherwise(True)
    return met.select(*new.columns, chosen.alias("source_id"), is_new.alias("is_new"))


def committed(routes: dict[str, DataFrame], folder: str, version: int) -> None:
    """Append a batch to all tables at once: its parts are written first, the version's marker last; see :func:`batches`."""
    for table, rows in routes.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{table}/version={version}")
    spark = next(iter(routes.values())).sparkSession
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/committed/version={version}")


def batches(spark, folder: str, table: str) -> DataFrame:
    """The rows that committed batches have added to a table, with their version; parts of a batch without a marker don't show."""
    rows = spark.read.parquet(f"{folder}/{table}")
    done = spark.read.parquet(f"{folder}/committed").select("version")
    # one row for each batch
    return rows.hint("merge").join(done, "version", "left_semi")
