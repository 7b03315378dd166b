"""A day from raw bodies to the digest and the state of tomorrow.

Tables in: sources (source_id, method, url, program_names, signal, min_rows, min_sections),
attempts (source_id, ok, quarantined, error, ts, requested, final), bodies (source_id,
page_no, body), and what yesterday left. The parser is chosen by method inside one plan; a
failure of any step is a row of ``results``, never a quiet day.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import keys
from tidewatch.functions.text import employer_position, page_lines
from tidewatch.functions.urls import redirect_verdict
from tidewatch.operators import coverage as C
from tidewatch.operators import health as HL
from tidewatch.operators import judgments as J
from tidewatch.operators import pages as P
from tidewatch.operators import pins as PN
from tidewatch.operators import programs as PG
from tidewatch.operators import rank as R
from tidewatch.operators import screens as S
from tidewatch.operators import snapshot as SN
from tidewatch.operators import tracking as T
from tidewatch.packs import recruiting
from tidewatch.plans import jobs
from tidewatch.session import stored, work_folder
from tidewatch.sources import feeds, tables

TABLES, PAGE = "github_readme", "page_text"
METHODS = [*feeds.COLLECTIONS, TABLES, PAGE]
#: Columns that name the employer, the role and the place in a list's tables.
ENTITY, ROLE, QUALIFIERS = ["Company", "Firm", "Employer", "Organization", "Name"], ["Role", "Position", "Title", "Program", "Programme"], ["Location", "Locations"]


@dataclass
class Parsed:
    """rows and sections of listings, lines of pages, and a result for each source and attempt."""

    rows: DataFrame
    sections: DataFrame
    lines: DataFrame
    results: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def parsed(sources: DataFrame, attempts: DataFrame, bodies: DataFrame, old_rows: DataFrame, old_lines: DataFrame, folder: str | None = None) -> Parsed:
    """Every fetched body by its source's method, with screens counted and floors applied.

    results: source_id, ord, ok, quarantined, error, baseline, rows, sections, not_wanted,
    not_home, redirected. The first of these is the error: quarantined or failed fetch, a method
    that nothing reads, a source that isn't listed, a malformed feed, a page's or a source's floor.
    """
    folder = folder or work_folder(sources.sparkSession, "parsed")
    spark = sources.sparkSession
    known = sources.select("source_id", "method")
    fetched = attempts.where("coalesce(ok, false) AND NOT coalesce(quarantined, false)").select("source_id", "requested", "final")
    raw = bodies.hint("merge").join(known, "source_id").hint("merge").join(fetched, "source_id")
    # dealt into folders by method, so that each parser's branch reads its own, with the error of its shape, which is looked for once
    shape = reduce(lambda out, x: out.when(F.col("method") == x[0], feeds.shape_error(F.col("body"), x[1])), feeds.COLLECTIONS.items(), F.when(F.lit(False), ""))
    raw = raw.withColumn("shape", shape)
    raw.write.partitionBy("method").parquet(f"{folder}/raw")
    schema = [f for f in raw.schema.fields if f.name != "method"]
    raw = spark.read.schema(type(raw.schema)([*schema, raw.schema["method"]])).parquet(f"{folder}/raw")

    found, shapes, listed = [], [], []
    for method in feeds.COLLECTIONS:
        mine = raw.where(F.col("method") == method)
        shapes.append(mine.select("source_id", F.col("shape").alias("error")))
        good = mine.where("shape = ''")
        listed.append(feeds.listed(good, method))
        found.append(feeds.postings(good, method).drop("ord"))
    # the text is for judges; the snapshot doesn't need it, so it is cut from the scan
    postings = _union([x.drop("text") for x in found])
    wanted, home = S.wanted_title(F.col("title"), F.col("employment_type")), S.at_home(F.col("location"))
    postings = stored(postings.withColumns({"wanted": wanted, "home": home}), f"{folder}/postings")
    screened = postings.groupBy("source_id").agg(F.count(F.lit(1)).alias("parsed"), F.count_if(~F.col("wanted")).alias("not_wanted"), F.count_if(F.col("wanted") & ~F.col("home")).alias("not_home"))
    # what the parsers' own screens took out is listed and not parsed
    screened = _union(listed).hint("merge").join(screened, "source_id", "left").withColumn("pre_screened", F.col("listed") - F.coalesce("parsed", F.lit(0)))
    feed_rows = feeds.posting_rows(postings.where("wanted AND home"))

    lists = raw.where(F.col("method") == TABLES).select("source_id", F.col("body").alias("text"))
    cells = [x.withColumn("table_id", F.col("table_id").cast("string")).withColumn("row_no", F.col("row_no").cast("long")) for x in (tables.markdown_tables(lists), tables.html_tables(lists))]
    list_rows = tables.listings(_union(cells), ENTITY, ROLE, QUALIFIERS)[0]
    rows = stored(feed_rows.unionByName(list_rows), f"{folder}/rows")
    sections = rows.select("source_id", "section").distinct()

    cut = raw.where(F.col("method") == PAGE).select("source_id", "requested", "final", F.length("body").alias("html_chars"), page_lines(F.coalesce("body", F.lit(""))).alias("lines"))
    pages = stored(cut, f"{folder}/pages")
    before = old_lines.select("source_id", F.col("lines").alias("old"))
    both = pages.hint("merge").join(before, "source_id", "left")
    text = F.array_join("lines", "\n")
    exempt = F.col("old").isNotNull() & P.shrink_exempt(F.coalesce("old", F.array().cast("array<string>")), F.col("lines"))
    floors = P.floors(both.select("source_id", "requested", "final", "html_chars", text.alias("text"), F.lit(False).alias("rendered"), F.length(F.array_join("old", "\n")).alias("old_chars"), exempt.alias("exempt")))
    page_facts = floors.select("source_id", "error", F.when(redirect_verdict(F.col("requested"), F.col("final")) == "warn", F.concat(F.lit("now at "), "final")).alias("redirected"))

    shape = _union(shapes).unionByName(page_facts.select("source_id", "error")).groupBy("source_id").agg(F.max("error").alias("shape"))
    counts = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("section").alias("sections"))
    previous = old_rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("previous"))
    seen = previous.select("source_id").unionByName(before.select("source_id")).distinct().withColumn("seen", F.lit(True))
    tried = attempts.select("source_id", "ok", "quarantined", F.col("error").alias("fetch_error"))
    out = HL.outcomes(sources, attempts, METHODS).hint("merge").join(tried, "source_id", "left")
    for more in (known, shape, counts, previous, screened, page_facts.select("source_id", "redirected"), seen):
        out = out.hint("merge").join(more, "source_id", "left")
    out = out.where("outcome <> 'not tried'")
    first = (
        F.when(F.col("outcome").isin("quarantined", "failed"), F.coalesce(F.nullif("fetch_error", F.lit("")), "outcome"))
        .when(F.col("outcome") == "not listed", "fetched, but no longer among the sources")
        .when(F.col("outcome") == "unknown method", F.concat(F.lit("nothing reads method "), F.coalesce("method", F.lit(""))))
        .otherwise(F.coalesce("shape", F.lit("")))
    )
    listed = F.col("method") != PAGE
    facts = out.select("source_id", F.coalesce("quarantined", F.lit(False)).alias("quarantined"), first.alias("first"), F.when(listed, F.coalesce("rows", F.lit(0))).alias("rows"), "sections", "previous", (F.coalesce("pre_screened", F.lit(0)) + F.coalesce("not_wanted", F.lit(0)) + F.coalesce("not_home", F.lit(0))).alias("pre_screened"), F.lit(0).alias("boards"), F.lit(0).alias("unreadable"), F.coalesce("not_wanted", F.lit(0)).alias("not_wanted"), F.coalesce("not_home", F.lit(0)).alias("not_home"), "redirected", F.col("seen").isNull().alias("fresh"))
    checked = HL.plausible(facts, sources)
    error = F.when(F.col("first") != "", F.col("first")).otherwise(F.col("error"))
    results = checked.select("source_id", F.xxhash64("source_id").alias("ord"), (error == "").alias("ok"), "quarantined", error.alias("error"), ((error == "") & F.col("fresh")).alias("baseline"), "rows", "sections", "not_wanted", "not_home", "redirected")
    return Parsed(rows, sections, pages.select("source_id", "lines"), stored(results, f"{folder}/results"))


def page_changes(old_lines: DataFrame, new_lines: DataFrame, folder: str) -> DataFrame:
    """Changes of pages (source_id, lines) in the form of row changes."""
    side = lambda df: df.withColumnRenamed("source_id", "page_id")
    found = P.changes(side(old_lines), side(new_lines), folder)
    identity = F.lit("page :: text")
    return found.select(F.col("page_id").alias("source_id"), F.lit("changed").alias("kind"), identity.alias("identity"), "key", "detail", F.lit("").alias("url"), F.lit(False).alias("structural"), "discovery", "rolling", keys.change_id(F.col("page_id"), identity).alias("change_id"))


@dataclass
class Replay:
    """What a day's raw data says, before any judgment."""

    parsed: Parsed
    day: jobs.Processed
    lines: DataFrame


def process_raw(sources: DataFrame, attempts: DataFrame, bodies: DataFrame, old_rows: DataFrame, old_lines: DataFrame, muted: DataFrame, applied: DataFrame, as_of: Column, folder: str | None = None) -> Replay:
    """Raw bodies to changes, reports and the next baseline. Equal inputs give equal tables.

    A source that failed keeps its rows and lines; lists that others keep (``TABLES``) are aggregators.
    """
    folder = folder or work_folder(sources.sparkSession, "raw")
    read = parsed(sources, attempts, bodies, old_rows, old_lines, f"{folder}/parsed")
    names = F.get(F.split(F.coalesce("program_names", F.lit("")), r"\|"), F.lit(0))
    metrics = read.results.select("source_id", "ok").hint("merge").join(sources.select("source_id", F.coalesce("program_names", F.lit("")).alias("program_name"), names.alias("first_name")), "source_id", "left")
    good = metrics.where("ok").select("source_id")
    new_lines = read.lines.hint("merge").join(good, "source_id", "left_semi")
    moved = page_changes(old_lines, new_lines, f"{folder}/pages")
    aggregators = sources.where(F.col("method") == TABLES).select("source_id")
    day = jobs.process(read.rows, old_rows, metrics, aggregators, muted, applied, as_of, f"{folder}/process", more=moved)
    lines = new_lines.unionByName(old_lines.hint("merge").join(new_lines.select("source_id"), "source_id", "left_anti"))
    return Replay(read, day, lines)


@dataclass
class Day:
    """Everything a day leaves: ranked rows, pins, states and programs of tomorrow, the log of proposals, and the next baseline."""

    replay: Replay
    rows: DataFrame
    pins: DataFrame
    states: DataFrame
    programs: DataFrame
    proposals: DataFrame


def judged_rows(changes: DataFrame, sources: DataFrame, texts: DataFrame, judgments: DataFrame, as_of: Column, most: int = R.MAX_JUDGED, folder: str | None = None) -> DataFrame:
    """Changes with their outcome, rank, notes, employer and position: screened by rules, then judged within the budget.

    texts: change_id, text; judgments: as from ``judgments.parsed``, with change_id. Only changes that
    no rule settles count against the budget, rolling firms and discovery programmes first.
    """
    folder = folder or work_folder(changes.sparkSession, "judged")
    told = changes.hint("merge").join(texts.select("change_id", "text"), "change_id", "left")
    ruled = stored(told.withColumn("v", S.verdict(F.col("key"), F.col("text"))).drop("text"), f"{folder}/ruled").withColumnRenamed("row", "ord")
    asked = R.within_budget(ruled.where("v IS NULL"), R.judging_order(), most, folder=f"{folder}/budget")
    verdicts = ruled.where("v IS NOT NULL").select("change_id", F.col("v.rule").alias("rule"), F.col("v.quote").alias("quote"))
    over = asked.where("NOT judged").select("change_id")
    said = judgments.hint("merge").join(asked.where("judged").select("change_id"), "change_id", "left_semi")
    out = J.joined(ruled.drop("v"), verdicts, said, over)
    more = said.select("change_id", "why", "deadline", "class_year", "location", "employer_size")
    out = out.hint("merge").join(more, "change_id", "left").hint("merge").join(sources.select("source_id", "method", "program_names"), "source_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    classified = F.col("outcome") == "model"
    names = employer_position(F.col("key"), text(F.nullif(F.get(F.split(text("program_names"), r"\|"), F.lit(0)), F.lit(""))), (F.col("method") == TABLES) & ~F.col("structural"))
    ranked = R.rank(text("deadline"), as_of, F.col("rolling"), F.col("discovery"), classified, F.col("confidence"))
    notes = T.notes(text("deadline"), F.col("rolling"), text("class_year"), text("location"), text("employer_size"), classified, F.col("confidence"), F.col("kind"))
    why = F.when(F.col("outcome") == "over_budget", "over the budget of this run").otherwise(text("why"))
    top = S.aimed_at_first_years(F.col("key"), text("class_year"), F.col("structural")) & F.col("relevant")
    return out.select("change_id", "source_id", "kind", "key", "url", "ord", "outcome", "relevant", "rule", "quote", why.alias("why"), "confidence", text("deadline").alias("deadline"), text("employer_size").alias("employer_size"), classified.alias("classified"), names["company"].alias("company"), names["position"].alias("position"), ranked["tier"].alias("tier"), ranked["reason"].alias("reason"), notes.alias("notes"), top.alias("top"))


def run_day(sources: DataFrame, attempts: DataFrame, bodies: DataFrame, old_rows: DataFrame, old_lines: DataFrame, muted: DataFrame, applied: DataFrame, texts: DataFrame, judgments: DataFrame, pins: DataFrame, states: DataFrame, programs: DataFrame, as_of: Column, now: Column, most: int = R.MAX_JUDGED, folder: str | None = None) -> Day:
    """The whole day: :func:`process_raw`, judged rows, pins, source states with their backoff, and program states."""
    folder = folder or work_folder(sources.sparkSession, "day")
    replay = process_raw(sources, attempts, bodies, old_rows, old_lines, muted, applied, as_of, folder)
    rows = stored(judged_rows(replay.day.changes, sources, texts, judgments, as_of, most, f"{folder}/judged"), f"{folder}/rows")
    checked = replay.parsed.results.where("ok").select("source_id")
    ids = lambda df: df.select("source_id", keys.change_id(F.col("source_id"), keys.identity(F.col("section"), F.col("key"))).alias("change_id"))
    fresh = rows.where("top AND kind <> 'removed'").select("change_id", "source_id", "company", "position", "deadline")
    kept = PN.refreshed(pins, fresh, PN.live_ids(ids(old_rows), ids(replay.parsed.rows), checked), checked, as_of)
    tried = attempts.hint("merge").join(replay.parsed.results.select("source_id", F.col("ok").alias("good")), "source_id").withColumn("ok", F.col("good"))
    after = HL.quarantine(HL.next_state(states, tried), now)
    hashes = SN.snapshot_hash(replay.parsed.rows, replay.parsed.sections)
    counts = HL.metrics(replay.parsed.results, replay.day.changes).withColumnRenamed("change_count", "changes")
    results = replay.parsed.results.select("source_id", "ord", "ok").hint("merge").join(hashes.withColumnRenamed("hash", "snapshot_hash"), "source_id", "left").hint("merge").join(counts, "source_id", "left")
    said = rows.hint("merge").join(sources.select("source_id", F.get(F.split("program_names", r"\|"), F.lit(0)).alias("program_name")), "source_id").withColumn("new_status", F.lit(None).cast("string"))
    if "new_status" in judgments.columns:
        said = said.drop("new_status").hint("merge").join(judgments.select("change_id", "new_status"), "change_id", "left")
    tracked, proposals = T.tracked(programs, sources, results, said, now.cast(programs.schema["last_checked"].dataType))
    return Day(replay, rows, kept, after, tracked, proposals)


def digest(rows: DataFrame, pins: DataFrame, results: DataFrame, states: DataFrame, header: int = 1000, footer: int = 6789, most: int = R.MAX_CHARS, folder: str | None = None) -> DataFrame:
    """part, n, company, position, priority, note, shown: the rows of one message in order.

    Part 0 is what is built for first-years, today's before the pins that didn't move; part 1 the
    blind sources, then High, then Medium; part 2 what was ruled out. ``shown`` is false for rows of
    part 1 that don't fit with all of the others.
    """
    folder = folder or work_folder(rows.sparkSession, "digest")
    said = F.array_join(F.transform("notes", lambda x: F.when(x["label"] == "", x["value"]).otherwise(F.concat(x["label"], F.lit(": "), x["value"]))), "; ")
    ruled = J.label(F.coalesce("rule", F.when(~F.col("relevant"), F.nullif("why", F.lit("")))), F.col("quote"), recruiting.RULE_LABELS)
    part = F.when(~F.col("relevant"), 2).when(F.col("top"), 0).otherwise(1)
    today = rows.select(part.alias("part"), F.lit(1).alias("sort"), "company", "position", F.concat("tier", F.lit(": "), "reason").alias("priority"), F.when(part == 2, ruled).otherwise(said).alias("note"), "relevant", "top", "tier", "reason", "employer_size", "ord")
    moved = rows.select("change_id").distinct()
    old = pins.hint("merge").join(moved, "change_id", "left_anti")
    blank = {"relevant": F.lit(True), "top": F.lit(True), "tier": F.lit(""), "reason": F.lit(""), "employer_size": F.lit("")}
    standing = old.select(F.lit(0).alias("part"), F.lit(2).alias("sort"), "company", "position", F.lit("").alias("priority"), F.concat(F.lit("since "), "first_pinned").alias("note"), *[v.alias(k) for k, v in blank.items()], F.xxhash64("first_pinned", "company", "position", "change_id").alias("ord"), "first_pinned")
    blind = HL.blind(results, states).select(F.lit(1).alias("part"), F.lit(0).alias("sort"), F.col("source_id").alias("company"), "position", F.lit("High: source blind").alias("priority"), "note", *[v.alias(k) for k, v in blank.items()], F.xxhash64("source_id").alias("ord"))
    every = today.unionByName(standing, allowMissingColumns=True).unionByName(blind, allowMissingColumns=True)
    pinned = [F.col("first_pinned").asc_nulls_first(), F.lower("company").asc(), F.lower("position").asc()]
    order = [F.col("part").asc(), F.col("sort").asc(), *R.digest_order(every)[:-1], F.when(F.col("sort") == 1, F.col("ord")).asc_nulls_first(), *pinned, F.col("ord").asc()]
    sized = stored(every.withColumn("length", F.length(F.concat_ws(" | ", "priority", "company", "position", "note"))), f"{folder}/sized")
    # the table is what can be trimmed; the other parts always stand
    rest = sized.where("part <> 1").agg(F.coalesce(F.sum(F.col("length") + 1), F.lit(0))).first()[0]
    table = R.fitted_one(sized.where("part = 1"), order, "length", header + rest, footer, most, f"{folder}/table")
    others = R.fitted_one(sized.where("part <> 1"), order, "length", 0, 0, 1 << 62, f"{folder}/others")
    columns = ["part", "n", "company", "position", "priority", "note", "shown"]
    return table.select(*columns).unionByName(others.select(*columns))


def coverage_of(snapshots: DataFrame, sources: DataFrame, listings: DataFrame, date: str, folder: str | None = None) -> DataFrame:
    """Coverage of a published list (``listings``: body, JSON) by the stored snapshots, for all fields and quant alone, of one date.

    Rows of lists name the employer themselves; bulk boards are named by their section, others by their source's program.
    """
    folder = folder or work_folder(snapshots.sparkSession, "coverage")
    names = sources.select("source_id", "method", F.get(F.split(F.coalesce("program_names", F.lit("")), r"\|"), F.lit(0)).alias("program"))
    # one published list may have half of the rows: they are dealt anew, or one task would read all of its titles
    rows = snapshots.hint("merge").join(names, "source_id").repartition("section", "key")
    is_list = F.col("method") == TABLES
    # a row's title and place: "Title @ Place"
    title = F.regexp_replace("key", r"\s@\s.*$", "")
    rows = rows.select("*", title.alias("title")).withColumn("who", employer_position(F.col("title"), F.coalesce("program", F.lit("")), is_list))
    flat = rows.select(
        F.xxhash64("source_id", "section", "key").bitwiseAND(F.lit((1 << 62) - 1)).alias("row"),
        "url",
        F.col("who.company").alias("company"),
        F.when(is_list, F.col("who.position")).otherwise(F.col("title")).alias("title"),
        F.when(F.contains("key", F.lit(" @ ")), F.regexp_extract("key", r"\s@\s(.*)$", 1)).otherwise("").alias("location"),
        is_list.alias("is_aggregator"),
    )
    # written, as the filter would find each row's title anew for each of its patterns
    ours = C.comparable(stored(flat, f"{folder}/named")).drop("location")
    theirs = feeds.reference_postings(listings).where(F.col("title").rlike("(?iu)" + recruiting.COVERAGE_STUDENT))
    theirs = theirs.distinct().withColumn("row", F.xxhash64("company", "title", "url").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1)))
    scopes = {"fields": F.col("title").rlike("(?iu)" + recruiting.COVERAGE_FIELDS), "quant": F.col("title").rlike("(?iu)" + recruiting.COVERAGE_QUANT)}
    return jobs.measure_coverage(ours, theirs, scopes, date, folder)
