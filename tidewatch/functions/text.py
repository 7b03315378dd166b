"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.packs import recruiting

# Named entities; numeric ones follow from their number.
_ENTITIES = [
    ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&apos;", "'"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"),
    ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&bull;", "\u2022"), ("&middot;", "\u00b7"), ("&eacute;", "\u00e9"), ("&amp;", "&"),
]
# What a judge writes where a posting doesn't say.
UNSTATED = ("", "-", "n/a", "na", "none", "null", "unknown", "not specified", "not stated", "unspecified", "not listed", "tbd")
# What has no readable text, what ends a line, and the units of a countdown.
_DROPPED = r"(?is)<({0})\b[^>]*>.*?</\1>"
_BLOCK_END = r"(?is)</(p|div|li|tr|h[1-6]|section|article|header|footer|nav)\s*>|<br\s*/?>"
_COUNT_UNIT = r"(?i)^(days?|hours?|hrs?|minutes?|mins?|seconds?|secs?)$"
# Words that titles of any two postings share.
STOP_WORDS = ("intern", "internship", "internships", "summer", "the", "and", "for", "with", "2027", "2026", "program", "programme", "co-op", "coop")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it reads more than once, as a variable: the value is made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def entities(text: Column) -> Column:
    """Text without character references. The ampersand is last, so that what it makes isn't read again."""
    number = r"&#(?:[xX]([0-9a-fA-F]{1,5})|([0-9]{1,6}));"
    whole, hexes, decimals = (F.regexp_extract_all(text, F.lit(number), F.lit(k)) for k in (0, 1, 2))
    code = lambda x: F.coalesce(F.conv(F.nullif(x["h"], F.lit("")), 16, 10).cast("int"), F.try_to_number(F.nullif(x["d"], F.lit("")), F.lit("999999")).cast("int"))
    # four bytes big-endian are the character; references outside Unicode stay
    char = lambda x: F.when((code(x) > 0) & (code(x) < 0xD800) | (code(x) > 0xDFFF) & (code(x) <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code(x)), 8, "0")), "UTF-32"))
    # a struct with written names: those of aliases are lost where ``text`` is a variable of ``transform``
    found = F.array_distinct(F.transform(whole, lambda x, i: F.named_struct(F.lit("w"), x, F.lit("h"), F.get(hexes, i), F.lit("d"), F.get(decimals, i))))
    numbers = F.aggregate(found, text, lambda acc, x: F.replace(acc, x["w"], F.coalesce(char(x), x["w"])))
    text = F.when(F.contains(text, F.lit("&#")), numbers).otherwise(text)
    for name, char_ in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char_))
    return text


def plain_text(html: Column) -> Column:
    """Readable text of a page on one line."""
    text = F.regexp_replace(html, _DROPPED.format("script|style"), " ")
    return squeezed(entities(F.regexp_replace(text, r"<[^>]+>", " ")))


def masked(text: Column, noise=None) -> Column:
    """Text without what changes on each request."""
    for pattern, sign in noise or recruiting.NOISE:
        text = F.regexp_replace(text, pattern, sign.replace("$", "\\$"))
    return text


def page_lines(html: Column, noise=None) -> Column:
    """A page's lines in order: blocks end lines, tags and noise go, blank lines too; a feed in one line is cut at its records."""
    text = F.regexp_replace(html, _DROPPED.format("script|style|noscript|svg|iframe|template"), " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK_END, "\n"), r"(?s)<[^>]+>", " ")
    feed = F.substring(F.ltrim(text), 1, 1).isin("{", "[")
    text = F.when(feed, F.regexp_replace(text, r"\}, ?\{", "},\n{")).otherwise(text)
    lines = F.transform(F.split(masked(text, noise), "\n"), squeezed)
    return F.filter(lines, lambda x: x != "")


def countdowns(lines: Column) -> Column:
    """A bare number of up to three digits after a bare unit of time is a countdown, so it becomes ``<n>``."""
    before = lambda i: F.get(lines, i - 1)
    return F.transform(lines, lambda x, i: F.when((i > 0) & F.coalesce(before(F.greatest(i, F.lit(1))).rlike(_COUNT_UNIT), F.lit(False)) & x.rlike(r"^\d{1,3}$"), F.lit("<n>")).otherwise(x))


def without_tracking(text: Column) -> Column:
    return F.regexp_replace(text, r"[?&](utm_[a-z]+|ref)=[^\s&)]*", "")


def clean_cell(cell: Column) -> Column:
    """A table cell as text: comments and images go, anchors become ``[text](url)``."""
    text = F.regexp_replace(cell, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " "), r"(?i)<img\b[^>]*>", " ")
    text = F.regexp_replace(text, r"(?is)<a\b[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    text = entities(F.regexp_replace(text, r"<[^>]+>", " "))
    bare = squeezed(F.replace(without_tracking(text), F.lit("**"), F.lit("")))
    return F.btrim(bare, F.lit(" |"))


def stable_heading(text: Column) -> Column:
    """A heading without the tally in a parenthesis that ends it."""
    return F.regexp_replace(text, r"\s*\(\d[^)]*\)\s*$", "")


def without_markers(text: Column, markers: Column) -> Column:
    return F.aggregate(markers, text, lambda acc, m: F.replace(acc, m, F.lit("")))


_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"


def key_text(text: Column) -> Column:
    """A key without emoji; a cell of nothing else keeps them. Arrows stay."""
    bare = squeezed(F.regexp_replace(text, _EMOJI, ""))
    return F.when(bare == "", squeezed(text)).otherwise(bare)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def folded(text: Column) -> Column:
    """A title in which lookalike letters can't make a new row."""
    return F.translate(nfkc(text), *recruiting.LOOKALIKES)


def without_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")


def clipped(text: Column, most: int, note: bool = False) -> Column:
    more = F.concat(F.substring(text, 1, most), F.concat(F.lit(" [+"), (F.length(text) - most).cast("string"), F.lit(" chars]")) if note else F.lit("..."))
    return F.when(F.length(text) > most, more).otherwise(text)


def first_letters(name: Column, n: int = 5) -> Column:
    """A company's block key."""
    return F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), 1, n)


def title_words(title: Column, stop=STOP_WORDS) -> Column:
    """The set of a title's words of two or more characters, links unlinked."""
    text = F.lower(F.regexp_replace(title, r"\[([^\]]*)\]\([^)]*\)", "$1"))
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-z0-9]{2,}"), F.lit(0))), F.array(*map(F.lit, stop)))


def slug(text: Column, most: int = 40) -> Column:
    """Words joined by dashes, cut between words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    joined = lambda acc, w: F.when(acc == "", w).otherwise(F.when(F.length(acc) + F.length(w) + 1 <= most, F.concat(acc, F.lit("-"), w)).otherwise(acc))
    return F.aggregate(words, F.lit(""), joined)


def unstated(text: Column) -> Column:
    """Empty where the value only says that there is none."""
    bare = squeezed(text)
    return F.when(F.btrim(F.lower(bare), F.lit(" .")).isin(*UNSTATED), "").otherwise(bare)


def escaped_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\s*\n\s*", " ")


def unlinked(text: Column) -> Column:
    """Markdown links down to their labels."""
    return F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")


def employer_position(key: Column, company: Column, is_list: Column) -> Column:
    """company, position of a row. A list's rows (``is_list``) name the employer before the first " / ", others only by a link there.

    Else the company is the given one, whose name is taken off the key's beginning.
    """
    linked, plain = r"^\[([^\]]+)\]\([^)]*\)\s*/\s*(.+)$", r"^(.+?)\s+/\s+(.+)$"
    name = F.coalesce(company, F.lit(""))
    updated = F.lit("page updated")

    def pair(key: Column, pattern: str) -> Column:
        return F.named_struct(*[x for n, k in (("company", 1), ("position", 2)) for x in (F.lit(n), F.trim(unlinked(F.regexp_extract(key, pattern, k))))])

    def rest(bare: Column) -> Column:
        taken = (name != "") & F.startswith(F.lower(bare), F.lower(name))
        left = F.btrim(F.when(taken, F.regexp_replace(F.substring(bare, F.length(name) + 1, F.length(bare)), r"^[ \-\u2013\u2014:\u00b7,]+", "")).otherwise(bare))
        return named(left, lambda x: F.when(x == "", updated).when(F.startswith(x, F.lit("(")) & taken, F.concat(updated, F.lit(" "), x)).otherwise(x))

    def of(key: Column) -> Column:
        other = F.named_struct(F.lit("company"), name, F.lit("position"), named(unlinked(key), rest))
        # what a pattern can't match without is looked for first
        by_link = F.startswith(key, F.lit("[")) & key.rlike(linked)
        by_bar = F.coalesce(is_list, F.lit(False)) & F.contains(key, F.lit("/")) & key.rlike(plain)
        return F.when(by_link, pair(key, linked)).when(by_bar, pair(key, plain)).otherwise(other)

    return named(key, of)
