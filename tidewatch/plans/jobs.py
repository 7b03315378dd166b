"""Composite jobs: what a user runs in one call. Each takes and returns DataFrames and an explicit date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import keys, urls
from tidewatch.operators import coverage as C
from tidewatch.operators import health as HL
from tidewatch.operators import identity as I
from tidewatch.operators import pins as PN
from tidewatch.operators import programs as PG
from tidewatch.operators import rank as R
from tidewatch.operators import screens as S
from tidewatch.operators import snapshot as SN
from tidewatch.operators import tracking as T
from tidewatch.packs import recruiting
from tidewatch.session import stored, work_folder
from tidewatch.sources import feeds


@dataclass
class Processed:
    """What a day's raw data says: changes to act on, reports of what was removed, and the next baseline."""

    changes: DataFrame
    reports: DataFrame
    snapshots: DataFrame


def process(new: DataFrame, baseline: DataFrame, metrics: DataFrame, aggregators: DataFrame, muted: DataFrame, applied: DataFrame, as_of: Column, folder: str | None = None, more: DataFrame | None = None) -> Processed:
    """Diff, collapse, suppress and commit one day. Replayable: equal inputs give equal tables.

    new, baseline: snapshot rows; metrics: source_id, ok, program_name; a failed source
    keeps its baseline and reports no change. more: changes of other kinds, which join after the collapse.
    """
    folder = folder or work_folder(new.sparkSession, "process")
    ok = metrics.where("coalesce(ok, false)").select("source_id").distinct()
    good = new.join(ok, "source_id", "left_semi")
    old = baseline.join(ok, "source_id", "left_semi")
    changes = stored(SN.diff(old, good), f"{folder}/changes")
    counts = changes.where("NOT structural").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    size = lambda df, name: df.groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
    over = counts.join(size(old, "a"), "source_id", "left").join(size(good, "b"), "source_id", "left")
    over = over.where((F.col("n") >= 25) & (F.col("n") > 0.25 * F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)), F.lit(1)))).select("source_id", "n")
    collapsed = over.select("source_id", F.lit("changed").alias("kind"), F.lit("").alias("identity"), F.concat("source_id", F.lit(": "), F.col("n").cast("string"), F.lit(" rows changed at once")).alias("key"), F.lit("").alias("detail"), F.lit("").alias("url"), F.lit(True).alias("structural"), F.lit(False).alias("discovery"), F.lit(False).alias("rolling"), keys.change_id(F.col("source_id"), F.lit("collapsed")).alias("change_id"))
    kept = changes.join(over, "source_id", "left_anti").unionByName(collapsed)
    if more is not None:
        kept = kept.unionByName(more)
    names = metrics.select("source_id", "program_name").dropDuplicates(["source_id"])
    named = kept.join(names, "source_id", "left").join(aggregators.select("source_id", F.lit(True).alias("agg")).distinct(), "source_id", "left")
    # a row's number is a hash of what it is, so that equal inputs give equal tables without one sort of everything
    numbered = named.withColumn("row", F.xxhash64("source_id", "identity", "kind").bitwiseAND(F.lit((1 << 62) - 1)))
    ids = urls.posting_identities(F.col("detail"), F.col("url"), F.col("key"))
    ready = numbered.select("*", ids.alias("ids"), F.coalesce("agg", F.lit(False)).alias("is_aggregator"), keys.change_key(F.col("source_id"), F.col("key"), as_of).alias("mute_key")).drop("agg")
    out, reports = I.suppressed(stored(ready, f"{folder}/ready"), muted, applied, f"{folder}/suppress")
    return Processed(out, reports, SN.committed(baseline, good, metrics))


def run_daily(new: DataFrame, baseline: DataFrame, metrics: DataFrame, aggregators: DataFrame, muted: DataFrame, applied: DataFrame, bodies: DataFrame, judgments: DataFrame, as_of: Column, folder: str | None = None) -> tuple[Processed, DataFrame]:
    """The day's process and its digest rows: screened by rules, judged, ranked, in order and within the budget."""
    folder = folder or work_folder(new.sparkSession, "daily")
    day = process(new, baseline, metrics, aggregators, muted, applied, as_of, folder)
    texts = day.changes.join(bodies.select("change_id", "text"), "change_id", "left")
    v = S.verdict(F.col("key"), F.col("text"))
    joined = texts.withColumn("v", v).join(judgments.select("change_id", F.col("relevant").alias("said"), "confidence", "deadline", "employer_size"), "change_id", "left")
    relevant = F.when(F.col("v").isNotNull(), False).otherwise(F.coalesce("said", F.lit(True)))
    rank = R.rank(F.coalesce("deadline", F.lit("")), as_of, F.col("rolling"), F.col("discovery"), F.col("said").isNotNull(), F.coalesce("confidence", F.lit("low")))
    rows = joined.select("change_id", "source_id", "key", F.col("row").alias("ord"), relevant.alias("relevant"), F.col("v.rule").alias("rule"), F.col("v.quote").alias("quote"), rank.alias("r"), F.coalesce("employer_size", F.lit("")).alias("employer_size"), S.aimed_at_first_years(F.col("key"), F.lit(""), F.col("structural")).alias("top"))
    rows = rows.select("*", "r.tier", "r.reason").drop("r")
    return day, R.within_budget(rows, R.digest_order(rows), folder=f"{folder}/budget")


def digest_rows(rows: DataFrame, header: int = 1000, footer: int = 6789) -> DataFrame:
    """Digest rows in their order with whether they fit one message."""
    sized = rows.withColumn("length", F.length(F.concat_ws(" | ", "key", "reason", "source_id")))
    return R.fitted_one(sized, R.digest_order(sized), "length", header, footer)


def digest_lines(judgments: DataFrame, results: DataFrame, states: DataFrame, by_month: DataFrame, always: DataFrame, as_of: Column) -> DataFrame:
    """part, block, ord, line of what stands around a digest's rows: the run's note, blind sources, health, then reminders.

    judgments: classified, why; the others as in ``health.health_lines`` and ``tracking.reminders``.
    """
    line = lambda df, part, block, order, text: df.select(F.lit(part).alias("part"), block.alias("block"), order.cast("long").alias("ord"), text.alias("line"))
    zero = F.lit(0)
    note = line(T.run_note(judgments).where("note IS NOT NULL"), 0, zero, zero, F.col("note"))
    blind = HL.blind(results, states).join(results.select("source_id", "ord").hint("merge"), "source_id")
    top = line(blind, 1, zero, F.col("ord"), F.concat_ws(" | ", "source_id", "position", "note"))
    health = line(HL.health_lines(results, states), 2, F.col("block"), F.col("ord"), F.col("line"))
    months = line(T.reminders(by_month, always, as_of), 3, F.col("every"), F.col("ord"), F.col("reminder"))
    return note.unionByName(top).unionByName(health).unionByName(months)


def measure_coverage(rows: DataFrame, reference: DataFrame, scopes: dict[str, Column], date: str, folder: str | None = None) -> DataFrame:
    """Coverage by scope of one date. rows: row, url, company, title, is_aggregator; reference: row, company, title, url."""
    from tidewatch.functions.text import first_letters, title_words, without_zero_width

    one = lambda df, ref: df.select("row", urls.posting_identities(F.col("url")).alias("ids"), first_letters(without_zero_width(F.col("company"))).alias("block"), title_words(without_zero_width(F.col("title"))).alias("words"), "title", F.lit(ref).alias("is_reference"), (F.lit(True) if ref else F.col("is_aggregator")).alias("is_aggregator"))
    out = C.coverage(one(rows, False).unionByName(one(reference, True)), scopes, folder=folder)
    return out.withColumn("date", F.lit(date).cast("date"))


def discover(pages: DataFrame, known: DataFrame, proposed: DataFrame, judgments: DataFrame, repositories: DataFrame | None = None, as_of: Column | None = None, boards=recruiting.BOARDS, not_slugs=recruiting.NOT_SLUGS) -> DataFrame:
    """Candidates for new sources, once each, without known and proposed ones, with their triage status.

    Three kinds: boards that a page's text names; pages that a watched page (page_id, url, html) links
    to as its list of openings; and live repositories (name, url, stars, archived, fork, pushed_at).
    """
    evidence = F.col("page_id").cast("string").alias("evidence")
    found = PG.fingerprints(pages, boards, not_slugs).select(F.col("method").alias("kind"), F.col("slug").alias("key"), evidence)
    if "url" in pages.columns:
        links = pages.select(evidence, F.explode(urls.links_out(F.col("html"), F.col("url"), recruiting.JOB_LINK)).alias("key"))
        found = found.unionByName(links.select(F.lit("page").alias("kind"), "key", "evidence"))
    if repositories is not None:
        live = PG.repositories(repositories, as_of)
        found = found.unionByName(live.select(F.lit("repository").alias("kind"), F.lower("name").alias("key"), F.col("url").alias("evidence")))
    return PG.triaged(PG.fresh(PG.first_finds(found, ["evidence"]), known, proposed), judgments)


def partition_programs(programs: DataFrame, watched: DataFrame, codes: list[str]) -> DataFrame:
    """Programs with whether a watched page covers them, those to check by hand in order of eligibility."""
    parts = PG.partitioned(programs, PG.covering(programs.select("target_id", "url", "source_id"), watched))
    return parts.withColumn("check_order", R.eligibility_order(F.col("eligible"), codes))


def add_entries(entries: DataFrame, programs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated new programs to append, and all problems by entry; any problem refuses the batch."""
    return PG.added(programs, entries), PG.problems(entries).where(F.size("problems") > 0)


def board_snapshots(raw: DataFrame, method: str) -> DataFrame:
    """Snapshot rows of one method's feeds: wanted roles at home only."""
    found = feeds.postings(raw, method)
    kept = found.where(S.wanted_title(F.col("title"), F.col("employment_type")) & S.at_home(F.col("location")))
    return feeds.posting_rows(kept)


def pins_of_day(pins: DataFrame, fresh: DataFrame, previous: DataFrame, new: DataFrame, checked: DataFrame, as_of: Column) -> DataFrame:
    return PN.refreshed(pins, fresh, PN.live_ids(previous, new, checked), checked, as_of)


def states_of_day(states: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    return HL.quarantine(HL.next_state(states, attempts), now)
