"""What a day's results say about tracked programs, boards and employers, and about the run as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import keys

# The states a tracked program may be in.
STATUSES = ("dormant", "open", "closed", "unknown")


def _proposed(programs: DataFrame, sources: DataFrame, judgments: DataFrame) -> DataFrame:
    """Each judged change of a program's status: source_id, name, ord, was, status, why.

    Only relevant, classified judgments that aren't of low confidence count, never those of
    sources with a low signal (a source that isn't listed is none). A judgment is set
    against the one before it, the first against the program's own status; equal ones
    propose nothing.
    """
    noisy = sources.where(F.lower(F.trim("signal")) == "low").select("source_id").distinct()
    sure = F.coalesce("classified", F.lit(False)) & F.coalesce("relevant", F.lit(False)) & F.coalesce(F.col("confidence") != "low", F.lit(True))
    said = judgments.where(sure & F.col("new_status").isin(*STATUSES) & (F.col("new_status") != "unknown"))
    said = said.hint("merge").join(noisy, "source_id", "left_anti")
    told = said.select("source_id", F.col("program_name").alias("name"), "ord", F.col("new_status").alias("to"), "why")
    met = told.hint("merge").join(programs.select("name", "status"), "name")
    before = F.lag("to").over(Window.partitionBy("name").orderBy("ord"))
    return met.withColumn("was", F.coalesce(before, "status", F.lit(""))).where("was <> to").select("source_id", "name", "ord", "was", F.col("to").alias("status"), "why")


def tracked(programs: DataFrame, sources: DataFrame, results: DataFrame, judgments: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The programs after a day's results, and the proposals to log.

    programs: name (once each), status, last_checked, snapshot_hash, last_changed, and any
    other columns, which stay as they are; sources: source_id (once each), program_names
    (separated by a bar), signal; results: source_id, ord, ok, snapshot_hash, changes (a
    count); judgments: source_id, program_name, ord, relevant, classified, confidence,
    new_status, why. A program is checked when any of its sources was, whatever came of
    it; its hash is that of the last good result; it changed when rows did or when a
    judgment set another status.
    """
    proposals = _proposed(programs, sources, judgments)
    status = proposals.groupBy("name").agg(F.max_by("status", "ord").alias("to"))
    names = sources.select("source_id", F.explode(F.split("program_names", r"\|")).alias("name")).select("source_id", F.trim("name").alias("name"))
    of = results.hint("merge").join(names.where("name <> ''").distinct(), "source_id")
    good = F.coalesce("ok", F.lit(False)) & F.col("snapshot_hash").isNotNull()
    seen = of.groupBy("name").agg(
        F.max_by(F.when(good, F.col("snapshot_hash")), F.when(good, F.col("ord"))).alias("hash"),
        F.coalesce(F.bool_or(F.col("changes") > 0), F.lit(False)).alias("moved"),
        F.lit(True).alias("seen"),
    )
    joined = programs.hint("merge").join(seen, "name", "left").hint("merge").join(status, "name", "left")
    values = {
        "last_checked": F.when(F.col("seen"), now).otherwise(F.col("last_checked")),
        "snapshot_hash": F.coalesce("hash", "snapshot_hash"),
        "last_changed": F.when(F.col("moved") | F.col("to").isNotNull(), now).otherwise(F.col("last_changed")),
        "status": F.coalesce("to", "status"),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in programs.columns]), proposals


def boards_of(changes: DataFrame, previous: DataFrame, current: DataFrame, employers: DataFrame) -> DataFrame:
    """Adds board and employer to changes (source_id, identity): the section of the row that changed, and whose board it is.

    The current version's section goes before the previous one's; a change of no row has
    the board "". employers: board, company, ord, one row a posting: the first company
    that isn't blank names the board, else the board's own name does.
    """
    side = lambda rows, k: rows.select("source_id", keys.identity(F.col("section"), F.col("key")).alias("identity"), "section", F.lit(k).alias("side"))
    place = side(previous, 0).unionByName(side(current, 1)).groupBy("source_id", "identity").agg(F.max_by("section", "side").alias("board"))
    named = employers.where("trim(coalesce(company, '')) <> ''").groupBy("board").agg(F.min_by(F.trim("company"), "ord").alias("employer"))
    found = changes.hint("merge").join(place, ["source_id", "identity"], "left").withColumn("board", F.coalesce("board", F.lit("")))
    return found.hint("merge").join(named, "board", "left").withColumn("employer", F.coalesce("employer", "board"))


def reminders(by_month: DataFrame, always: DataFrame, as_of: Column) -> DataFrame:
    """month, ord, reminder for a date: those of its month (by_month: month, ord, reminder), then those of every month."""
    name = F.date_format(as_of, "MMMM").alias("month")
    now = by_month.where(F.col("month") == F.month(as_of)).select(name, F.lit(0).alias("every"), "ord", "reminder")
    return now.unionByName(always.select(name, F.lit(1).alias("every"), "ord", "reminder"))


def run_note(judgments: DataFrame) -> DataFrame:
    """One row, ``note``: the reason that all unclassified judgments give, if they give one and the same; else null."""
    why = F.when(~F.coalesce("classified", F.lit(False)) & (F.col("why") != ""), F.col("why"))
    return judgments.agg(F.min(why).alias("a"), F.max(why).alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a")).alias("note"))


def delivery(judgments: DataFrame, results: DataFrame, delivered: DataFrame, date: Column) -> DataFrame:
    """One row, send and status_only: once a date and no more, in short form without judgments, failures and first runs."""
    news = judgments.limit(1).select(F.lit(True).alias("news"))
    events = results.agg(F.bool_or(~F.coalesce("ok", F.lit(False)) | F.coalesce("baseline", F.lit(False))).alias("news"))
    done = delivered.agg(F.coalesce(F.bool_or(F.col("date") == date), F.lit(False)).alias("done"))
    flags = news.unionByName(events).agg(F.coalesce(F.bool_or("news"), F.lit(False)).alias("news")).select("news", F.lit(None).cast("boolean").alias("done"))
    both = flags.unionByName(done.select(F.lit(None).cast("boolean").alias("news"), "done")).agg(F.bool_or("news").alias("news"), F.bool_or("done").alias("done"))
    return both.select((~F.col("done")).alias("send"), (~F.col("done") & ~F.col("news")).alias("status_only"))


def cell(text: Column) -> Column:
    """Text that may stand in a table's cell: bars escaped, white space of any kind one space."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))


def notes(deadline: Column, rolling: Column, class_year: Column, location: Column, employer_size: Column, classified: Column, confidence: Column, kind: Column) -> Column:
    """array<struct<label, value>> of what a row's note says; empty fields go, and a row without any says what kind of change it is."""
    is_rolling = F.coalesce(rolling, F.lit(False)) | F.coalesce(F.lower(F.trim(deadline)) == "rolling", F.lit(False))
    known = F.coalesce(classified, F.lit(False))
    caveat = F.when(~known, "unverified, open the page").when(confidence == "low", "low confidence, kept deliberately")
    pairs = (
        ("Deadline", F.when(is_rolling, "rolling, closes when full").otherwise(deadline)),
        ("Year", class_year),
        ("Location", location),
        ("Size", F.when(employer_size == "small", "small firm")),
        ("", caveat),
    )
    fields = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_replace(cell(value), r"[ .;,]+$", "").alias("value")) for label, value in pairs])
    said = F.filter(fields, lambda x: x["value"] != "")
    plain = F.when(kind == "removed", "row disappeared from the source").when(kind == "changed", "page changed on the source").otherwise("no details stated on the posting")
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.struct(F.lit("").alias("label"), plain.alias("value"))))


def unsupported(pages: DataFrame, vendors: dict[str, str], text: str = "html", method: str = "page_text") -> DataFrame:
    """page_id, vendor of pages watched as text that name a vendor's board: the first of ``vendors`` (name to pattern, as written) that matches.

    Pages (page_id, text, and method if there is one) read by another method are passed over.
    """
    first = F.coalesce(*[F.when(F.col(text).rlike(pattern), name) for name, pattern in vendors.items()])
    if "method" in pages.columns:
        pages = pages.where(F.coalesce("method", F.lit("")) == method)
    return pages.select("page_id", first.alias("vendor")).where("vendor IS NOT NULL")
