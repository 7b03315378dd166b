"""Source health from the log of attempts: failure runs, backoff, outcomes, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Failures before a source waits, hours by further failure, and the most hours.
AFTER, HOURS, MOST_HOURS = 3, (6, 12, 24, 48), 72


def failure_runs(attempts: DataFrame, tie: str = "attempt_id") -> DataFrame:
    """source_id, failures (since the last success), last_success, last_attempt; quarantined attempts don't count.

    The last success is a maximum and the run a count after it: two sums by source, no
    ordered window over a source's whole log.
    """
    tried = attempts.where("NOT coalesce(quarantined, false)")
    at = F.struct("ts", tie)
    last = tried.groupBy("source_id").agg(F.max(F.when(F.col("ok"), at)).alias("good"), F.max("ts").alias("last_attempt"))
    joined = tried.join(last, "source_id")
    failed = ~F.col("ok") & (F.col("good").isNull() | (at > F.col("good")))
    return joined.groupBy("source_id").agg(F.count_if(failed).alias("failures"), F.max("good.ts").alias("last_success"), F.max("last_attempt").alias("last_attempt"))


def backoff_hours(failures: Column) -> Column:
    hours = F.get(F.array(*map(F.lit, HOURS)), F.greatest(failures - AFTER, F.lit(0)).cast("int"))
    return F.when(failures < AFTER, 0).otherwise(F.coalesce(hours, F.lit(MOST_HOURS)))


def quarantine(states: DataFrame, now: Column) -> DataFrame:
    """Adds hours, retry_after, skip and never_succeeded; without a readable last attempt a source is tried."""
    hours = backoff_hours(F.coalesce("failures", F.lit(0)))
    until = F.when(hours > 0, F.timestamp_add("HOUR", hours, F.col("last_attempt")))
    return states.withColumns({"hours": hours, "retry_after": until, "skip": F.coalesce(now < until, F.lit(False)), "never_succeeded": F.col("last_success").isNull()})


def next_state(states: DataFrame, attempts: DataFrame) -> DataFrame:
    """Counters after a run with one attempt a source: success resets, failure adds one, quarantine moves nothing."""
    joined = states.join(attempts.select("source_id", "ok", "quarantined", F.col("ts").alias("at")), "source_id", "left")
    still = F.col("ok").isNull() | F.coalesce("quarantined", F.lit(False))
    return joined.select(
        "source_id",
        F.when(still, F.col("failures")).when(F.col("ok"), F.lit(0)).otherwise(F.coalesce("failures", F.lit(0)) + 1).alias("failures"),
        F.when(~still & F.col("ok"), F.col("at")).otherwise(F.col("last_success")).alias("last_success"),
        F.when(still, F.col("last_attempt")).otherwise(F.col("at")).alias("last_attempt"),
    )


def outcomes(sources: DataFrame, attempts: DataFrame, methods: list[str]) -> DataFrame:
    """source_id, outcome of every source and every attempt: quarantined, failed, unknown method, not listed, not tried and ok stay apart."""
    both = sources.select("source_id", "method").join(attempts.select("source_id", "ok", "quarantined", F.lit(True).alias("tried")), "source_id", "full_outer")
    known = F.col("method").isin(*methods)
    outcome = (
        F.when(F.col("method").isNull(), "not listed")
        .when(~known, "unknown method")
        .when(F.col("tried").isNull(), "not tried")
        .when(F.coalesce("quarantined", F.lit(False)), "quarantined")
        .when(F.coalesce("ok", F.lit(False)), "ok")
        .otherwise("failed")
    )
    return both.select("source_id", outcome.alias("outcome"))


def health_counts(states: DataFrame, escalate: int = AFTER) -> DataFrame:
    """One row: checked, healthy, failing, quarantined, escalated."""
    skip, failing = F.col("skip"), F.col("failures") > 0
    return states.agg(
        F.count_if(~skip).alias("checked"),
        F.count_if(~skip & ~failing).alias("healthy"),
        F.count_if(~skip & failing).alias("failing"),
        F.count_if(skip).alias("quarantined"),
        F.count_if(F.col("failures") >= escalate).alias("escalated"),
    )


def board_health(boards: DataFrame, most: float = 0.5) -> DataFrame:
    """By source: boards, unreadable ones, and whether too many of them fail the source."""
    counts = boards.groupBy("source_id").agg(F.count(F.lit(1)).alias("boards"), F.count_if(F.col("error") != "").alias("unreadable"))
    return counts.withColumns({"share": F.col("unreadable") / F.col("boards"), "failed": F.col("unreadable") > F.col("boards") * most})


def metrics(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """change_count of every source, also 0."""
    counts = changes.groupBy("source_id").agg(F.count(F.lit(1)).alias("change_count"))
    return sources.select("source_id").distinct().join(counts, "source_id", "left").select("source_id", F.coalesce("change_count", F.lit(0)).alias("change_count"))


def without_handler(sources: DataFrame, handlers: DataFrame) -> DataFrame:
    """Methods that some source uses and nothing handles, and the reverse."""
    used = sources.select("method").distinct()
    return used.join(handlers, "method", "left_anti").select("method", F.lit("no handler").alias("problem")).unionByName(handlers.join(used, "method", "left_anti").select("method", F.lit("no source").alias("problem")))


def plausible(counts: DataFrame, floors: DataFrame, most: float = 0.5) -> DataFrame:
    """Adds ok and error to each source's counts: a redesign that yields next to nothing must not pass as a quiet day.

    counts: source_id, rows, sections, pre_screened (rows that a screen took out),
    previous (rows of the last good version, null without one), boards, unreadable;
    nulls count as 0. floors: source_id, min_rows, min_sections, one row a source, null
    where there is none. The first of: too few rows, too few sections, no rows where
    there were some and none was screened out, more than ``most`` of the boards unreadable.
    """
    n = lambda c: F.coalesce(c, F.lit(0))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows, sections, boards, unreadable = n("rows"), n("sections"), n("boards"), n("unreadable")
    error = (
        F.when(rows < n("min_rows"), said("parsed only ", rows, " rows, expected at least ", F.col("min_rows")))
        .when(sections < n("min_sections"), said("parsed only ", sections, " sections, expected at least ", F.col("min_sections")))
        .when((n("previous") > 0) & (rows == 0) & (n("pre_screened") == 0), said("returned 0 rows, down from ", F.col("previous"), " tracked rows"))
        .when((boards > 0) & (unreadable > boards * most), said(unreadable, " of ", boards, " boards could not be read"))
        .otherwise("")
    )
    joined = counts.hint("merge").join(floors.select("source_id", "min_rows", "min_sections"), "source_id", "left")
    return joined.select(*[c for c in counts.columns if c not in ("ok", "error")], (error == "").alias("ok"), error.alias("error"))


def health_lines(results: DataFrame, states: DataFrame) -> DataFrame:
    """source_id, block, ord, line: what the health part of a digest has to say, in order of block and ord.

    Block 0 counts all sources, 1 those that were not fetched, 2 names each of them, 3 has
    a line for each failing source, 4 first runs, 5 pages that redirect, 6 collapses, 7
    sums the postings that the role and place screens took out.
    results: source_id, ord, ok, quarantined, error, baseline, rows, redirected,
    collapsed, and not_wanted and not_home where postings were screened; states: source_id, failures, last_success (text).
    """
    known = states.select("source_id", F.col("failures").alias("run"), F.col("last_success").alias("since"))
    failing = ~F.coalesce("ok", F.lit(False))
    waits = failing & F.coalesce("quarantined", F.lit(False))
    joined = results.hint("merge").join(known, "source_id", "left")
    run, since = F.coalesce("run", F.lit(0)), F.coalesce(F.nullif(F.col("since"), F.lit("")), F.lit("never"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    row = lambda block, when, line: F.when(when, F.struct(F.lit(block).alias("block"), line.alias("line")))
    said = F.array_compact(F.array(
        row(2, waits, text("not fetched: ", F.col("source_id"))),
        row(3, failing, text(F.col("source_id"), ": ", run, F.when(run == 1, " consecutive failure").otherwise(" consecutive failures"), ", last success ", since, ". ", F.col("error"))),
        row(4, F.coalesce("baseline", F.lit(False)), text(F.col("source_id"), ": first run, recorded ", F.coalesce("rows", F.lit(0)), " rows as the baseline.")),
        row(5, F.coalesce(F.col("redirected") != "", F.lit(False)), text(F.col("source_id"), ": ", F.col("redirected"))),
        row(6, F.coalesce(F.col("collapsed") > 0, F.lit(False)), text(F.col("source_id"), ": ", F.col("collapsed"), " rows changed at once and were collapsed into one item")),
    ))
    lines = joined.select("source_id", "ord", F.explode(said).alias("x")).select("source_id", "x.block", "ord", "x.line")
    screened = lambda c: F.coalesce(F.sum(c), F.lit(0)) if c in results.columns else F.lit(0)
    sums = results.agg(F.count(F.lit(1)).alias("n"), F.count_if(failing).alias("bad"), F.count_if(waits).alias("out"), screened("not_wanted").alias("roles"), screened("not_home").alias("places"))
    first = text(F.col("n"), " sources checked, ", F.col("n") - F.col("bad"), " healthy", F.when(F.col("bad") > 0, text(", ", F.col("bad"), " failing")).otherwise(""))
    heads = F.array_compact(F.array(row(0, F.lit(True), first), row(1, F.col("out") > 0, text(F.col("out"), " sources were not fetched at all")), row(7, (F.col("roles") > 0) | (F.col("places") > 0), text("screened out: ", F.col("roles"), " postings of other roles, ", F.col("places"), " in other places"))))
    top = sums.select(F.lit("").alias("source_id"), F.explode(heads).alias("x")).select("source_id", "x.block", F.lit(0).cast(lines.schema["ord"].dataType).alias("ord"), "x.line")
    return top.unionByName(lines)


def blind(results: DataFrame, states: DataFrame, escalate: int = AFTER) -> DataFrame:
    """source_id, position, note of failing sources that have failed ``escalate`` times or more: they go among the top rows."""
    bad = results.where("NOT coalesce(ok, false)").select("source_id", "error").hint("merge")
    joined = bad.join(states.select("source_id", "failures", "last_success"), "source_id").where(F.col("failures") >= escalate)
    since = F.coalesce(F.nullif(F.col("last_success"), F.lit("")), F.lit("never"))
    return joined.select(
        "source_id",
        F.concat(F.lit("SOURCE BLIND: "), F.col("failures").cast("string"), F.lit(" failures running")).alias("position"),
        F.concat(F.lit("not quiet, blind. Last success "), since, F.lit(". "), F.coalesce("error", F.lit(""))).alias("note"),
    )
