"""Job-board feeds: seven JSON shapes to one posting schema, and what a malformed or partial feed is.

raw: source_id, page_no, body (JSON text). Malformed is never empty: shapes add an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import clipped, folded, plain_text
from tidewatch.operators.snapshot import flagged, with_ordinals
from tidewatch.packs import recruiting

#: The collection of each method's feed; "" is a list at the root.
COLLECTIONS = {"greenhouse": "jobs", "lever": "", "ashby": "jobs", "workday": "jobPostings", "phenom": "jobs", "eightfold": "positions", "nsf": "response.award"}
_DIVISIONS = ("CCF", "CNS", "IIS", "OAC", "DMS")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _truthy(v: Column) -> Column:
    """A JSON value that isn't null, false, zero or empty."""
    empty = F.to_json(v).isin("null", "false", "0", "0.0", '""', "[]", "{}")
    return v.isNotNull() & ~F.coalesce(empty, F.lit(True))


def shape_error(body: Column, collection: str, paged: bool = False) -> Column:
    """"" for a feed of the right shape, else what is wrong with it. In a paged feed a missing collection is the end."""
    path = "$" + (f".{collection}" if collection else "")

    def said(v: Column) -> Column:
        members = F.try_variant_get(v, path, "variant")
        junk = F.exists(F.try_variant_get(v, path, "array<variant>"), lambda x: F.coalesce(_kind(x), F.lit("VOID")) != "OBJECT")
        out = F.when(v.isNull(), "not JSON")
        if collection:
            out = out.when(_kind(v) != "OBJECT", "not an object").when(_truthy(F.try_variant_get(v, "$.error", "variant")) | _truthy(F.try_variant_get(v, "$.errors", "variant")), "the feed reports an error")
            out = out.when(members.isNull(), "" if paged else f"no {collection}")
        return out.when(_kind(members) != "ARRAY", "not a list").when(F.coalesce(junk, F.lit(False)), "a member is not an object").otherwise("")

    # a variable, so that a body is parsed once and not for each question
    return F.get(F.transform(F.array(F.try_parse_json(body)), said), F.lit(0))


def paging_error(pages: DataFrame) -> DataFrame:
    """source_id, got, total, error: fewer rows than the stated total means a partial read."""
    by = pages.groupBy("source_id").agg(F.sum("items").alias("got"), F.max("total").alias("total"))
    return by.withColumn("error", F.when(F.coalesce(F.col("got") < F.col("total"), F.lit(False)), F.concat(F.lit("read "), F.col("got").cast("string"), F.lit(" of "), F.col("total").cast("string"))).otherwise(""))


def union_of_passes(passes: DataFrame, totals: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Distinct rows over repeated unstable passes, and the paging error of what they add up to."""
    rows = passes.dropDuplicates(["source_id", key])
    counted = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("items")).join(totals, "source_id", "full_outer")
    return rows, paging_error(counted.select("source_id", F.coalesce("items", F.lit(0)).alias("items"), "total"))


def _flat(v: Column) -> Column:
    """A field that may be missing, a scalar, a list, or an object with a name or value, as text."""
    one = lambda x: F.trim(F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.value", "string"), F.when(_kind(x) != "OBJECT", F.try_variant_get(x, "$", "string")), F.lit("")))
    many = F.array_join(F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), one), lambda x: x != ""), ", ")
    return F.when(_kind(v) == "ARRAY", many).otherwise(F.coalesce(one(v), F.lit("")))


def postings(raw: DataFrame, method: str, details: DataFrame | None = None, base: str = "") -> DataFrame:
    """source_id, ord, title, location, department, employment_type, url, text of well-shaped feeds of one method.

    details (source_id, path, body) belongs to feeds whose list has no description.
    """
    path = "$" + (f".{COLLECTIONS[method]}" if COLLECTIONS[method] else "")
    items = raw.select("source_id", "page_no", F.posexplode(F.try_variant_get(F.try_parse_json("body"), path, "array<variant>")).alias("n", "v"))
    get = lambda p: F.trim(F.coalesce(F.try_variant_get("v", "$." + p, "string"), F.lit("")))
    first = lambda *xs: F.coalesce(*[F.when(x != "", x) for x in xs], F.lit(""))
    none = F.lit("(no department)")
    if method == "greenhouse":
        meta = F.filter(F.coalesce(F.try_variant_get("v", "$.metadata", "array<struct<name:string,value:string>>"), F.array().cast("array<struct<name:string,value:string>>")), lambda m: F.lower(F.trim(m["name"])).isin("employment type", "job type"))
        cols = get("title"), get("location.name"), get("departments[0].name"), F.coalesce(F.try_element_at(meta, F.lit(-1))["value"], F.lit("")), get("absolute_url"), get("content")
    elif method == "lever":
        cols = get("text"), get("categories.location"), first(get("categories.department"), get("categories.team")), get("categories.commitment"), get("hostedUrl"), F.concat_ws("\n", get("descriptionPlain"), get("additionalPlain"))
    elif method == "ashby":
        items = items.where(F.coalesce(F.try_variant_get("v", "$.isListed", "boolean"), F.lit(True)))
        cols = get("title"), get("location"), first(get("department"), get("team")), get("employmentType"), get("jobUrl"), get("descriptionPlain")
    elif method == "workday":
        items = items.withColumn("path", get("externalPath"))
        if details is not None:
            items = items.hint("merge").join(details.select("source_id", "path", F.try_parse_json("body").alias("d")).dropDuplicates(["source_id", "path"]), ["source_id", "path"], "left")
            more = lambda p: F.coalesce(F.try_variant_get("d", "$.jobPostingInfo." + p, "string"), F.lit(""))
        else:
            more = lambda p: F.lit("")
        cols = get("title"), get("locationsText"), none, more("timeType"), F.concat(F.lit(base.split("/wday/")[0]), F.col("path")), more("jobDescription")
    elif method == "phenom":
        data = lambda p: _flat(F.try_variant_get("v", "$.data." + p, "variant"))
        items = items.where(flagged(data("category"), recruiting.STUDENT_CATEGORY) & ~flagged(data("title"), recruiting.NOT_STUDENT))
        place = F.array_join(F.filter(F.array(data("city"), data("country")), lambda x: x != ""), ", ")
        cols = data("title"), place, first(data("category"), none), data("category"), data("apply_url"), F.concat_ws(" ", data("description"), data("qualifications"))
    elif method == "eightfold":
        cols = get("name"), get("location"), first(get("department"), get("business_unit"), none), F.lit(""), get("canonicalPositionUrl"), F.lit("")
    elif method == "nsf":
        division = F.upper(get("divAbbr"))
        items = items.where(F.startswith(F.upper(get("title")), F.lit("REU SITE")) & division.isin(*_DIVISIONS))
        place = F.array_join(F.filter(F.array(get("awardeeName"), get("awardeeCity"), get("awardeeStateCode")), lambda x: x != ""), ", ")
        cols = get("title"), place, division, F.lit("REU"), F.concat(F.lit("https://www.nsf.gov/awardsearch/showAward?AWD_ID="), get("id")), F.concat(get("abstractText"), F.lit(" Award funded through "), first(get("expDate"), F.lit("unknown")), F.lit("."))
    else:
        raise ValueError(f"unknown method {method}")
    names = ("title", "location", "department", "employment_type", "url", "text")
    out = items.select("source_id", F.struct("page_no", "n").alias("ord"), *[c.alias(n) for c, n in zip(cols, names, strict=True)])
    return out.withColumn("text", clipped(plain_text(F.col("text")), 12_000))


def listed(raw: DataFrame, method: str) -> DataFrame:
    """source_id, listed: how many items the feeds of one method have, before any screen of :func:`postings`."""
    path = "$" + (f".{COLLECTIONS[method]}" if COLLECTIONS[method] else "")
    items = F.size(F.coalesce(F.try_variant_get(F.try_parse_json("body"), path, "array<variant>"), F.array().cast("array<variant>")))
    return raw.select("source_id", items.cast("long").alias("listed")).groupBy("source_id").agg(F.sum("listed").alias("listed"))


def posting_rows(found: DataFrame) -> DataFrame:
    """Snapshot rows of postings: only type and URL in the value, as the rest changes every day."""
    section = F.when(F.trim("department") == "", "(no department)").otherwise(F.trim("department"))
    key = F.when(F.col("location") != "", F.concat(folded(F.col("title")), F.lit(" @ "), "location")).otherwise(folded(F.col("title")))
    part = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(name), c))
    rows = found.select("source_id", section.alias("section"), key.alias("key"), F.concat_ws("; ", part("Type=", "employment_type"), part("URL=", "url")).alias("value"), "url", "department", "title", "location")
    order = [F.col(c) for c in ("department", "title", "location", "url")]
    return with_ordinals(rows, order).select("source_id", "section", "key", "value", "url")


def reference_postings(raw: DataFrame, home: str = recruiting.HOME, abroad: str = recruiting.ABROAD, graduate: str = recruiting.COVERAGE_GRADUATE) -> DataFrame:
    """company, title, url of a published list (JSON array in ``body``): active, visible, with some place at home, open to undergraduates."""
    schema = "array<struct<title:string,company_name:string,url:string,active:boolean,is_visible:boolean,locations:array<string>,category:string>>"
    x = raw.select(F.explode(F.from_json("body", schema)).alias("x")).select("x.*")
    at_home = lambda p: F.coalesce(F.trim(p) == "", F.lit(True)) | flagged(p, home) | ~flagged(p, abroad)
    places = F.when(F.size("locations") > 0, F.exists("locations", at_home)).otherwise(True)
    kept = x.where(F.coalesce("active", F.lit(False)) & F.coalesce("is_visible", F.lit(True)) & places & ~flagged(F.col("title"), graduate))
    title = F.when(F.col("category") == "Quant", F.concat("title", F.lit(" [quant]"))).otherwise(F.col("title"))
    return kept.select(F.coalesce("company_name", F.lit("")).alias("company"), title.alias("title"), F.coalesce("url", F.lit("")).alias("url"))


def positions_of(found: DataFrame) -> DataFrame:
    return found.withColumn("position", F.row_number().over(Window.partitionBy("source_id").orderBy("ord")))
