"""Web pages as lines: floors that tell a page from a shell, and differences of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions import urls
from tidewatch.operators.lines import ordered_diff
from tidewatch.operators.snapshot import flagged
from tidewatch.packs import recruiting

MIN_CHARS, MIN_SHARE, SHRINK = 500, 0.0015, 0.4
MAX_LINES, MAX_FLAGGED, LINE_CHARS, QUOTE_CHARS = 12, 10, 400, 160
# Fixed value: a whole line that says that a listing is empty.
NO_OPENINGS = (
    r"(?i)^(?:there\s+are\s+)?(?:currently\s+)?no\s+(?:upcoming\s+|current\s+|open\s+|available\s+)?"
    r"(?:events?|positions?|openings?|jobs?|opportunities|postings?|programs?)"
    r"(?:\s+(?:are\s+)?(?:available|found|posted|scheduled|listed|open|currently|at\s+this\s+time))*\s*[.!]?$"
)


def lines_of(pages: DataFrame) -> DataFrame:
    """page_id, pos, line: normalised lines in order."""
    # a column of its own: the masking looks up the line before, and would clean the page anew for each
    cleaned = pages.select("page_id", T.page_lines(F.coalesce("html", F.lit(""))).alias("lines"))
    return cleaned.select("page_id", F.posexplode(T.countdowns(F.col("lines"))).alias("pos", "line"))


def floors(pages: DataFrame) -> DataFrame:
    """Adds ``error``: the first that holds of error page, too short, mostly markup, shrunken; else "".

    pages: text, html_chars, rendered, old_chars (null at first sight), requested, final,
    exempt (see :func:`shrink_exempt`).
    """
    chars = F.length("text")
    short = F.concat(chars.cast("string"), F.lit(" characters of text: "), F.substring("text", 1, QUOTE_CHARS))
    error = (
        F.when(urls.redirect_verdict(F.col("requested"), F.col("final")) == "fail", "redirected to an error page")
        .when(chars < MIN_CHARS, short)
        .when(~F.coalesce("rendered", F.lit(False)) & (chars < F.col("html_chars") * MIN_SHARE), "almost no text in its markup")
        .when(~F.coalesce("exempt", F.lit(False)) & F.coalesce(chars < F.col("old_chars") * SHRINK, F.lit(False)), "lost most of its text")
        .otherwise("")
    )
    return pages.withColumn("error", error)


def shrink_exempt(old_lines: Column, new_lines: Column) -> Column:
    """The same JSON feed on both sides (objects of equal keys, or arrays), or a page that newly says, in a line of its own, that nothing is open."""
    old, new = (F.array_join(x, "\n") for x in (old_lines, new_lines))
    keys = lambda x: F.array_sort(F.json_object_keys(x))
    objects = F.coalesce(keys(old) == keys(new), F.lit(False))
    arrays = F.json_array_length(old).isNotNull() & F.json_array_length(new).isNotNull()
    says = F.exists(new_lines, lambda x: x.rlike(NO_OPENINGS) & ~F.array_contains(old_lines, x))
    return objects | arrays | F.coalesce(says, F.lit(False))


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """page_id, kind, line: lines (page_id, line) on one side more often than on the other; moved lines don't show."""
    signed = lambda df, sign: df.select("page_id", "line", F.lit(sign).alias("n"))
    both = signed(old, -1).unionByName(signed(new, 1)).groupBy("page_id", "line").agg(F.sum("n").alias("more"))
    many = both.where("more <> 0").withColumn("kind", F.when(F.col("more") > 0, "added").otherwise("removed"))
    return many.select("page_id", "kind", F.explode(F.array_repeat("line", F.abs("more").cast("int"))).alias("line"))


def page_change(added: Column, removed: Column) -> dict[str, Column]:
    """Key, detail and flags of a page's one change from its lines; a page with very many new lines gets no flags."""
    some = lambda x, sign: F.transform(F.slice(x, 1, MAX_LINES), lambda y: F.concat(F.lit(sign), T.clipped(y, LINE_CHARS, note=True)))
    new = F.array_join(added, " ")
    few = F.size(added) <= MAX_FLAGGED
    return {
        "key": F.concat(F.lit("page changed: "), F.size(added).cast("string"), F.lit(" added, "), F.size(removed).cast("string"), F.lit(" removed")),
        "detail": F.array_join(F.concat(some(added, "+ "), some(removed, "- ")), "\n"),
        "discovery": few & flagged(new, recruiting.DISCOVERY),
        "rolling": few & flagged(new, recruiting.ROLLING),
    }


def changes(old: DataFrame, new: DataFrame, folder: str | None = None) -> DataFrame:
    """At most one change a page from (page_id, lines) of two versions; first sights and equal pages give none."""
    both = old.withColumnRenamed("lines", "a").hint("merge").join(new.withColumnRenamed("lines", "b"), "page_id").where(~F.col("a").eqNullSafe(F.col("b")))
    one = lambda c: both.select("page_id", F.posexplode(c).alias("pos", "line"))
    lines = ordered_diff(one("a"), one("b"), folder)
    at = F.struct("pos", "line")
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, at))), lambda x: x["line"]).alias(kind)
    d = lines.groupBy("page_id").agg(of("added"), of("removed"))
    return d.select("page_id", *[c.alias(n) for n, c in page_change(F.col("added"), F.col("removed")).items()], "added", "removed")


def previous_line(lines: DataFrame) -> DataFrame:
    """Lines with the one before, for masks that need it on very long pages."""
    return lines.withColumn("before", F.lag("line").over(Window.partitionBy("page_id").orderBy("pos")))
