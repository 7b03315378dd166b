"""Tables in markdown and HTML lists, as cells, and listings made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import clean_cell, key_text, stable_heading, without_markers
from tidewatch.functions.urls import first_url
from tidewatch.operators.snapshot import carried_entity, with_ordinals

_SEPARATOR = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"
_HEADING = r"^#{1,6}\s+(.*)$"
_TD = r"(?is)<td\b[^>]*>(.*?)</td>"


def _row_map(headers: Column, cells: Column) -> Column:
    """Cells by header; cells beyond the headers and repeated headers go, the last of equals stays."""
    n = F.least(F.size(headers), F.size(cells))
    pairs = F.arrays_zip(F.slice(headers, F.lit(1), n).alias("h"), F.slice(cells, F.lit(1), n).alias("c"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(headers, i + 2, F.greatest(n - i - 1, F.lit(0))), p["h"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["h"], p["c"])))


def markdown_tables(docs: DataFrame) -> DataFrame:
    """source_id, table_id, heading, headers, row_no, cells of the tables in ``docs`` (source_id, text).

    A line of cells followed by a rule starts a table; it ends at the first line without cells.
    """
    lines = docs.select("source_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("source_id").orderBy("pos")
    is_row, is_rule = F.startswith(F.ltrim("line"), F.lit("|")), F.col("line").rlike(_SEPARATOR)
    marked = lines.withColumns({
        "row": is_row,
        "rule": is_rule,
        "start": is_row & F.coalesce(F.lead("line").over(w).rlike(_SEPARATOR), F.lit(False)) & ~is_rule & ~F.coalesce(F.startswith(F.ltrim(F.lag("line").over(w)), F.lit("|")), F.lit(False)),
        "heading": F.last(F.when(F.col("line").rlike(_HEADING), stable_heading(F.regexp_extract("line", _HEADING, 1))), ignorenulls=True).over(w),
    })
    # rows belong to the run of rows they stand in; a run that doesn't begin with a table's start isn't one
    runs = marked.withColumn("run", F.sum((~F.col("row")).cast("int")).over(w)).where("row")
    by_run = Window.partitionBy("source_id", "run").orderBy("pos")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), clean_cell)
    rows = runs.withColumn("cells", cells).withColumn("headers", F.first(F.when(F.col("start"), F.col("cells"))).over(by_run)).withColumn("first", F.first("start").over(by_run))
    found = rows.where(F.col("first") & ~F.col("start") & ~F.col("rule"))
    return found.select("source_id", F.col("run").alias("table_id"), F.coalesce("heading", F.lit("")).alias("heading"), "headers", F.col("pos").alias("row_no"), _row_map(F.col("headers"), F.col("cells")).alias("cells"))


def html_tables(docs: DataFrame) -> DataFrame:
    """The same of HTML tables under the nearest markdown heading. Tables of one heading with other headers stay apart."""
    parts = docs.select("source_id", F.posexplode(F.split("text", r"(?m)^(?=#{1,6}\s)")).alias("part", "text"))
    heading = stable_heading(F.regexp_extract("text", r"(?m)\A#{1,6}\s+(.*)$", 1))
    tables = parts.select("source_id", "part", heading.alias("heading"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("n", "body"))
    headers = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<th\b[^>]*>(.*?)</th>"), F.lit(1)), clean_cell)
    # a column of the table before its rows are exploded: beside the explode it would search the whole table for each row
    headed = tables.select("source_id", "part", "n", "heading", headers.alias("headers"), F.regexp_extract_all("body", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)).alias("trs"))
    rows = headed.select("source_id", "part", "n", "heading", "headers", F.posexplode("trs").alias("k", "tr")).where(F.col("tr").rlike(_TD))
    filled = rows.withColumn("cells", F.transform(F.regexp_extract_all("tr", F.lit(_TD), F.lit(1)), clean_cell))
    table_id = F.concat_ws("/", F.col("part").cast("string"), F.array_join("headers", "|"))
    return filled.select("source_id", table_id.alias("table_id"), "heading", "headers", (F.col("part") * 1_000_000 + F.col("n") * 10_000 + F.col("k")).alias("row_no"), _row_map(F.col("headers"), F.col("cells")).alias("cells"))


def listings(tables: DataFrame, entity: list[str], role: list[str], qualifiers: list[str] = (), ignored: list[str] = (), markers: list[str] = (), include: str | None = None, exclude: str | None = None, heading_as_entity: bool = False, arrow: str = "↳") -> tuple[DataFrame, DataFrame]:
    """Snapshot rows of listing tables, and per source how many rows each screen removed, also none."""
    marks = F.array(*map(F.lit, markers)) if markers else F.array().cast("array<string>")
    pick = lambda names: F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda x: F.array_contains("headers", x)), F.lit(1)) if names else F.lit(None).cast("string")
    not_in = ~F.coalesce(F.col("heading").rlike("(?iu)" + include), F.lit(False)) if include else F.lit(False)
    out = F.col("heading").rlike("(?iu)" + exclude) if exclude else F.lit(False)
    marked = tables.withColumns({"e": pick(list(entity)), "r": pick(list(role))})
    no_entity = F.lit(False) if heading_as_entity else F.col("e").isNull()
    why = F.when(not_in, "section-not-included").when(out, "section-excluded").when(no_entity, "no-entity-column").otherwise("")
    marked = marked.withColumn("why", why)
    reports = marked.groupBy("source_id").agg(F.count(F.lit(1)).alias("considered"), *[F.count_if(F.col("why") == x).alias(x.replace("-", "_")) for x in ("section-not-included", "section-excluded", "no-entity-column")])
    rows = marked.where("why = ''")
    cell = lambda name: without_markers(F.coalesce(F.try_element_at("cells", name), F.lit("")), marks)
    rows = rows.withColumn("entity", F.col("heading") if heading_as_entity else F.coalesce(cell(F.col("e")), F.lit("")))
    rows = carried_entity(rows, ["source_id", "table_id"], [F.col("row_no")], "entity", arrow)
    role_cell = F.when(F.col("r").isNotNull(), cell(F.col("r"))).otherwise("")
    rows = rows.withColumns({"ke": key_text(F.col("entity")), "kr": key_text(role_cell)}).where("ke <> '' OR kr <> ''")
    extra = [F.when(key_text(cell(F.lit(q))) != "", F.concat(F.lit(" @ "), key_text(cell(F.lit(q))))) for q in qualifiers]
    key = F.regexp_replace(F.concat_ws("", F.concat_ws(" / ", F.when((F.col("ke") != "") | (F.col("kr") != ""), F.col("ke")), F.when(F.col("kr") != "", F.col("kr"))), *extra), r"[\s\x{A0}]+", " ")
    resolved = lambda h: F.when(h == F.col("e"), F.col("entity")).otherwise(cell(h))
    shown = F.filter("headers", lambda h: (h != "") & ~h.isin(*ignored) & (F.coalesce(resolved(h), F.lit("")) != "")) if ignored else F.filter("headers", lambda h: (h != "") & (F.coalesce(resolved(h), F.lit("")) != ""))
    value = F.array_join(F.transform(shown, lambda h: F.concat(h, F.lit("="), resolved(h))), "; ")
    flat = rows.select("source_id", F.col("heading").alias("section"), key.alias("key"), value.alias("value"), "table_id", "row_no")
    numbered = with_ordinals(flat, [F.col("row_no")])
    return numbered.select("source_id", "section", "key", "value", F.coalesce(first_url(F.col("value")), F.lit("")).alias("url")), reports
