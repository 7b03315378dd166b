"""Screens: positive and veto patterns, places, and rules that quote what they fired on.

Nulls and unknowns stay on the side that keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import squeezed
from tidewatch.operators.snapshot import flagged
from tidewatch.packs import recruiting

BEFORE, AFTER, QUOTE = 50, 75, 180


def wanted_title(title: Column, kind: Column | None = None, wanted=(recruiting.STUDENT_TITLE, recruiting.DISCOVERY_TITLE), veto: str = recruiting.NOT_STUDENT, wanted_kind: str = recruiting.STUDENT_TYPE) -> Column:
    """A veto in the title decides; else any wanted pattern in it, or the wanted kind."""
    hit = flagged(title, wanted[0])
    for pattern in wanted[1:]:
        hit = hit | flagged(title, pattern)
    if kind is not None:
        hit = hit | flagged(kind, wanted_kind)
    return ~flagged(title, veto) & hit


def at_home(place: Column, home: str = recruiting.HOME, abroad: str = recruiting.ABROAD) -> Column:
    """A place at home wins over one abroad; an empty or unknown place is kept."""
    empty = F.coalesce(F.trim(place), F.lit("")) == ""
    return empty | flagged(place, home) | ~flagged(place, abroad)


def worth_detail(title: Column, place: Column) -> Column:
    """Whether a listing without detail deserves a second request."""
    return wanted_title(title, None, (recruiting.STUDENT_TITLE_LIST, recruiting.DISCOVERY_TITLE)) & ~flagged(place, recruiting.ABROAD)


def in_category(category: Column, pattern: str = recruiting.STUDENT_CATEGORY) -> Column:
    return flagged(category, pattern)


def quoted(text: Column, most: int = QUOTE) -> Column:
    whole = squeezed(text)
    cut = F.regexp_replace(F.substring(whole, 1, most), r"\s\S*$", "")
    return F.when(F.length(whole) > most, F.concat(cut, F.lit("..."))).otherwise(whole)


def evidence(text: Column, pattern: str, guards: list[str]) -> Column:
    """The first match that no guard matches near it, or null.

    ``split`` and ``regexp_extract_all`` of one pattern give the gaps and the matches, so a
    running length is each match's place; the guards look around it.
    """
    pattern = "(?iu)" + pattern
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not guards:
        return F.try_element_at(hits, F.lit(1))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        low = F.greatest(a - BEFORE, F.lit(0))
        near = F.substring(text, low + 1, b + AFTER - low)
        vetoed = F.lit(False)
        for guard in guards:
            vetoed = vetoed | near.rlike("(?iu)" + guard)
        return F.struct(b.alias("at"), F.coalesce(acc["found"], F.when(~vetoed, x["hit"])).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step)["found"])


def verdict(title: Column, text: Column, title_rules=None, posting_rules=None) -> Column:
    """struct<rule, quote> of the first rule that fires, title rules first; null is no opinion."""
    rules = []
    for name, pattern, rescue in recruiting.TITLE_RULES if title_rules is None else title_rules:
        hit = F.when(~flagged(title, rescue), F.try_element_at(F.regexp_extract_all(title, F.lit("(?iu)" + pattern), F.lit(0)), F.lit(1)))
        rules.append(F.when(hit.isNotNull(), F.struct(F.lit(name).alias("rule"), hit.alias("quote"))))
    said = F.when(F.trim(text) != "", text)
    for name, pattern, guards in recruiting.POSTING_RULES if posting_rules is None else posting_rules:
        hit = evidence(said, pattern, guards)
        rules.append(F.when(hit.isNotNull(), F.struct(F.lit(name).alias("rule"), hit.alias("quote"))))
    return F.coalesce(*rules)


def verdicts(rows: DataFrame, title: str, text: str, **rules) -> DataFrame:
    """Rows with a verdict only, with ``rule`` and ``quote``."""
    found = rows.withColumn("__v", verdict(F.col(title), F.col(text), **rules)).where("__v IS NOT NULL")
    return found.select("*", F.col("__v.rule").alias("rule"), quoted(F.col("__v.quote")).alias("quote")).drop("__v")


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def on_host(url_host: Column, domain: str) -> Column:
    return (F.lower(url_host) == domain) | F.endswith(F.lower(url_host), F.lit("." + domain))


def aimed_at_first_years(title: Column, class_year: Column, structural: Column) -> Column:
    """A title of sophomores only decides against, one that names first-years for; else a class year that is no floor."""
    names = flagged(title, recruiting.FIRST_YEAR)
    only_later = flagged(title, recruiting.SOPHOMORE) & ~names
    floor = r"\b(or (above|later|higher)|and (above|up)|minimum|at least|any|all)\b"
    year = flagged(class_year, recruiting.FIRST_YEAR + r"|freshman|sophomore") & ~flagged(class_year, floor)
    return ~F.coalesce(structural, F.lit(False)) & ~only_later & (names | year)
