"""Registered queries of text functions, screens and small operators, over rows made of parts, orders and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text, urls
from tidewatch.operators import coverage as C
from tidewatch.operators import judgments as J
from tidewatch.operators import pages as P
from tidewatch.operators import programs as PG
from tidewatch.operators import screens as S
from tidewatch.plans.catalog import AS_OF, query, table

def number() -> Column:
    return F.col("p_partkey")


def parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part")


def cases(*values) -> Column:
    """The value of a part's number modulo the number of values; a string without spaces around is a column."""
    out = F.when(number() % len(values) == 0, values[0])
    for k, value in enumerate(values[1:], 1):
        out = out.when(number() % len(values) == k, value)
    return out


def joined(*parts_: str) -> Column:
    """Text and, in braces, columns."""
    return F.concat(*[F.col(x[1:-1]).cast("string") if x.startswith("{") else F.lit(x) for x in parts_])


@query("SELECT p_partkey, p_name || ' ' || p_brand || ' & \u2013 \u00e9 [Apply](https://x.org/j/' || p_partkey || ')' AS cell FROM part")
def clean_cells(spark, sf_dir):
    raw = joined("<!-- note -->", "{p_name}", "<br>", "{p_brand}", ' &amp; &ndash; &#233; ![b](https://b.org/i.png) <a href="https://x.org/j/', "{p_partkey}", '?utm_source=q">**Apply**</a> |')
    return parts(spark, sf_dir).select("p_partkey", text.clean_cell(raw).alias("cell"))


@query("SELECT p_partkey, 'https://x.org/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '?id=1' ELSE '?src=a' END AS url FROM part")
def without_tracking(spark, sf_dir):
    url = F.concat(joined("https://x.org/", "{p_partkey}"), cases("?ref=list", "?id=1&utm_medium=mail", "?src=a&utm_campaign=b"))
    return parts(spark, sf_dir).select("p_partkey", text.without_tracking(url).alias("url"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 8 = 7 THEN p_name ELSE '' END AS value, CASE WHEN p_partkey % 2 = 0 THEN 'Jobs in ' || p_name ELSE p_name || ' (Advanced)' END AS heading FROM part")
def unstated_values(spark, sf_dir):
    value = cases("TBD", "not listed", " Not stated. ", "n/a", "Unknown", "-", "  ", F.concat(F.lit(" "), "p_name", F.lit("  ")))
    heading = F.when(number() % 2 == 0, joined("Jobs in ", "{p_name}", " (300 rows)")).otherwise(joined("{p_name}", " (Advanced)"))
    return parts(spark, sf_dir).select("p_partkey", text.unstated(value).alias("value"), text.stable_heading(heading).alias("heading"))


@query("SELECT p_partkey, p_name AS key, p_name || p_brand AS bare, 'Role ' || p_name AS unmarked FROM part")
def keys_without_marks(spark, sf_dir):
    marks = F.array(F.lit("\U0001f512"), F.lit(" [closed]"))
    return parts(spark, sf_dir).select(
        "p_partkey",
        text.key_text(joined("\U0001f525 ", "{p_name}", " \u2705")).alias("key"),
        text.without_zero_width(joined("{p_name}", "\u200b\u2060", "{p_brand}", "\ufeff")).alias("bare"),
        text.without_markers(joined("Role ", "{p_name}", "\U0001f512 [closed]"), marks).alias("unmarked"),
    )


@query("SELECT p_partkey, 'Machine Learning ' || p_name AS title FROM part")
def folded_titles(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", text.folded(joined("\ua4dfachine \ua4e1earning ", "{p_name}")).alias("title"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS cut, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || ' [+' || (length(text) - 50) || ' chars]' ELSE text END AS noted FROM documents")
def clipped_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.clipped(F.col("text"), 200).alias("cut"), text.clipped(F.col("text"), 50, note=True).alias("noted"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g') AS slug, substr(regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), 1, 5) AS block FROM part")
def slugs(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", text.slug(joined("{p_name}", " / ", "{p_type}", "!")).alias("slug"), text.first_letters(F.col("p_brand")).alias("block"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'HRT' WHEN 1 THEN 'ABB' WHEN 3 THEN 'Acme Future' ELSE 'Acme' END AS company,
CASE p_partkey % 5 WHEN 0 THEN 'Quant ' || p_name WHEN 1 THEN 'AI ' || p_name || ' @ Milpitas' WHEN 2 THEN 'Engineer / ' || p_name WHEN 3 THEN 'page updated (2 added, 0 removed)' ELSE 'page updated' END AS position FROM part""")
def employer_positions(spark, sf_dir):
    key = cases(joined("[ HRT ](https://h.org) / Quant ", "{p_name}"), joined("ABB / AI ", "{p_name}", " @ Milpitas"), joined("Engineer / ", "{p_name}"), F.lit("Acme Future (2 added, 0 removed)"), F.lit("ACME"))
    company = F.when(number() % 5 == 3, "Acme Future").otherwise("Acme")
    found = text.employer_position(key, company, number() % 5 == 1)
    return parts(spark, sf_dir).select("p_partkey", found.alias("x")).select("p_partkey", "x.company", "x.position")


@query("SELECT p_partkey, 'https://a.org/x/' || p_partkey AS url, p_brand || '/' || p_name AS repository, CASE WHEN p_partkey % 2 = 0 THEN 'README.md' ELSE 'docs/list.md' END AS file FROM part")
def links_and_targets(spark, sf_dir):
    said = joined("see https://a.org/x/", "{p_partkey}", " or https://b.org/y")
    repository, file = urls.repository_path(F.concat(joined("{p_brand}", "/", "{p_name}"), F.when(number() % 2 == 0, "").otherwise("/docs/list.md")))
    return parts(spark, sf_dir).select("p_partkey", urls.first_url(said).alias("url"), repository.alias("repository"), file.alias("file"))


@query("SELECT p_partkey, p_partkey % 4 < 2 AS on_host, CASE p_partkey % 3 WHEN 0 THEN 'field: ' || p_name WHEN 1 THEN 'graduates only' ELSE 'not relevant' END AS label FROM part")
def hosts_and_labels(spark, sf_dir):
    host = cases("example.com", "jobs.Example.com", "notexample.com", "example.com.org")
    rule = F.when(number() % 3 == 0, "out-of-field-title").when(number() % 3 == 1, "graduate-only")
    label = J.label(rule, F.col("p_name"), {"graduate-only": "graduates only"})
    return parts(spark, sf_dir).select("p_partkey", S.on_host(host, "example.com").alias("on_host"), label.alias("label"))


@query("SELECT p_partkey, p_partkey % 6 IN (1, 2) AS aimed FROM part")
def aimed_at_first_years(spark, sf_dir):
    title = cases("Sophomore Insight", "First-Year Programme", "Engineer", "Engineer", "Engineer", "First Year Day")
    year = cases("", "", "freshman", "sophomore or above", "any year", "")
    return parts(spark, sf_dir).select("p_partkey", S.aimed_at_first_years(title, year, number() % 6 == 5).alias("aimed"))


@query("SELECT p_partkey, p_partkey % 8 IN (0, 4, 6) AS exempt FROM part")
def shrink_exemptions(spark, sf_dir):
    lines = lambda *x: F.array(*map(F.lit, x))
    old = cases(lines("a"), lines("No events available", "a"), lines("a"), lines("a"), lines('{"jobs": [1,', "2]}"), lines('{"jobs": [1]}'), lines("[1, 2]"), lines("{x", "y"))
    new = cases(lines("No events available"), lines("No events available"), lines("b"), lines("There are no events like the positions we hold"), lines('{"jobs": []}'), lines('{"error": "blocked"}'), lines("[]"), lines("{x"))
    return parts(spark, sf_dir).select("p_partkey", P.shrink_exempt(old, new).alias("exempt"))



@query("SELECT o_orderkey, isodow(CAST(o_orderdate AS DATE)) = 1 OR o_orderkey % 14 BETWEEN 7 AND 11 AS due FROM orders")
def discovery_due(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    last = F.when(k % 14 == 13, "soon").when(k % 14 < 12, F.date_format(F.date_sub(day, (k % 14).cast("int")), "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", PG.due(last, day).alias("due"))


@query(f"""SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_custkey % 60 >= 25 AND o_orderkey % 13 <> 0
AND date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') <= 120""")
def live_repositories(spark, sf_dir):
    k = F.col("o_orderkey")
    pushed = F.when(k % 13 == 0, "no date").otherwise(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd'T'00:00:00'Z'"))
    found = table(spark, sf_dir, "orders").select(k, pushed.alias("pushed_at"), (F.col("o_custkey") % 60).alias("stars"), (k % 7 == 0).alias("archived"), F.when(k % 11 == 0, True).alias("fork"))
    return PG.repositories(found, F.lit(AS_OF).cast("date")).select("o_orderkey")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'no name' END, CASE WHEN p_partkey % 4 = 0 THEN 'no web address' END, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 'an agent may not assert YES' END], lambda x: x IS NOT NULL), '; ') AS problems FROM part""")
def entry_problems(spark, sf_dir):
    name = F.when(number() % 3 == 0, F.when(number() % 2 == 0, "  ")).otherwise(F.col("p_name"))
    url = F.when(number() % 4 == 0, F.when(number() % 8 == 0, "ftp://x.org")).otherwise("https://x.org/p")
    rows = parts(spark, sf_dir).select(number(), name.alias("name"), url.alias("url"), F.when(number() % 5 == 0, "Yes").otherwise("no").alias("status"), (number() % 2 == 0).alias("by_agent"))
    return PG.problems(rows).select("p_partkey", F.array_join("problems", "; ").alias("problems"))


@query("SELECT p_brand AS key, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def candidate_first_finds(spark, sf_dir):
    found = parts(spark, sf_dir).select(F.lit("page").alias("kind"), F.col("p_brand").alias("key"), number())
    return PG.first_finds(found, ["p_partkey"]).select("key", "p_partkey")


@query("SELECT count(*) FILTER (p_partkey % 3 > 0) AS fetched, count(*) FILTER (p_partkey % 3 = 1) AS read, count(*) FILTER (p_partkey % 3 = 2) AS failed FROM part")
def body_health(spark, sf_dir):
    return J.body_health(parts(spark, sf_dir).select(F.when(number() % 3 == 0, "inline").otherwise("fetched").alias("origin"), F.when(number() % 3 == 2, "timeout").alias("error")))


@query("""SELECT p_partkey, 'Row: ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Detail: ' || p_brand ELSE '' END || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'Posting: ' || p_type WHEN 1 THEN 'Posting unavailable: timeout' ELSE 'Posting unavailable: not fetched' END AS input FROM part""")
def model_inputs(spark, sf_dir):
    detail = F.when(number() % 2 == 0, F.col("p_brand")).otherwise("")
    body, error = F.when(number() % 3 == 0, F.col("p_type")).when(number() % 3 == 1, " "), F.when(number() % 3 == 1, "timeout")
    return parts(spark, sf_dir).select("p_partkey", J.model_input(F.col("p_name"), detail, body, error).alias("input"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 6 IN (0, 5)")
def coverage_comparable(spark, sf_dir):
    title = cases("Software Intern", "PhD Intern", "Software Engineer", "Intern", "Student MBA", "Co-op")
    place = cases("Austin, TX", "Austin, TX", "Austin, TX", "Helsinki, Finland", "", "")
    return C.comparable(parts(spark, sf_dir).select(number(), title.alias("title"), place.alias("location"))).select("p_partkey")
