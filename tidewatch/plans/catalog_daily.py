"""Registered queries of whole jobs: a day from raw bodies, its digest, coverage, discovery, routed additions, and global orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import keys, text
from tidewatch.operators import identity as I
from tidewatch.operators import programs as PG
from tidewatch.operators import rank as R
from tidewatch.operators import snapshot as SN
from tidewatch.plans import daily, jobs
from tidewatch.plans.catalog import AS_OF, BOARDS, LINES, boards, query, table
from tidewatch.session import stored, work_folder

INSIGHT = "Insight programme now open"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


# ---------------------------------------------------------------- raw bodies from orders and pages


def _orders(spark, sf_dir):
    """Orders as postings of boards of a thousand order numbers each."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    title = F.concat(F.when(n % 3 == 0, "Summer Intern Order ").otherwise("Manager Order "), n.cast("string"))
    place = F.when(n % 8 == 0, "London").when(n % 20 == 4, "").otherwise("Austin, TX")
    url = F.concat(F.lit("https://example.com/orders/"), n.cast("string"))
    return o.select(n.alias("n"), F.floor(n / 1000).alias("k"), F.col("o_orderpriority").alias("section"), title.alias("title"), place.alias("place"), url.alias("url"))


def _method(k: Column) -> Column:
    return F.when(k % 13 == 6, "ftp").when(k % 3 == 0, "greenhouse").when(k % 3 == 1, "lever").otherwise("ashby")


def raw_day(spark, sf_dir) -> dict:
    """sources, attempts, bodies, old_rows, old_lines: three feed shapes and pages; some fail, wait, are malformed, or of no known method."""
    o, k, name = _orders(spark, sf_dir), F.col("k"), F.concat(F.lit("b"), F.col("k").cast("string"))
    now = o.where("n % 10 <> 7")
    listed = lambda x: F.array_sort(F.collect_list(F.struct(*x)))
    green = [F.col("title"), F.struct(F.col("place").alias("name")).alias("location"), F.array(F.struct(F.col("section").alias("name"))).alias("departments"), F.col("url").alias("absolute_url")]
    lever = [F.col("title").alias("text"), F.struct(F.col("place").alias("location"), F.col("section").alias("department")).alias("categories"), F.col("url").alias("hostedUrl")]
    ashby = [F.col("title"), F.col("place").alias("location"), F.col("section").alias("department"), F.col("url").alias("jobUrl"), F.lit(True).alias("isListed")]
    body = F.when(F.col("method") == "lever", F.to_json(listed(lever))).when(F.col("method") == "ashby", F.to_json(F.struct(listed(ashby).alias("jobs")))).otherwise(F.to_json(F.struct(listed(green).alias("jobs"))))
    by = now.withColumn("method", _method(k)).groupBy("k", "method").agg(body.alias("body"))
    feeds = by.select(name.alias("source_id"), F.lit(0).alias("page_no"), F.when(k % 7 == 5, '{"error": "gone"}').otherwise(F.col("body")).alias("body"))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source_id"), "page_id", F.coalesce("html", F.lit("")).alias("html"))
    html = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit(f"<p>{INSIGHT}</p>"), "html")).otherwise(F.col("html"))
    # stored, as yesterday's lines are: within the filter below a page would be cleaned anew for each of its lines
    lines = stored(p.select("source_id", "page_id", text.page_lines(F.col("html")).alias("lines")), work_folder(spark, "yesterday"))
    old_lines = lines.select("source_id", F.when(F.col("page_id") % 5 == 0, F.filter("lines", lambda x: x != F.get("lines", F.lit(1)))).otherwise(F.col("lines")).alias("lines"))
    ks = o.select("k").distinct()
    row = lambda df, i, method, program: df.select(i.alias("source_id"), method.alias("method"), F.lit("").alias("url"), program.alias("program_names"), F.lit("high").alias("signal"), F.lit(None).cast("int").alias("min_rows"), F.lit(None).cast("int").alias("min_sections"))
    sources = row(ks, name, _method(k), F.concat(F.lit("Firm "), k.cast("string"))).unionByName(row(p, F.col("source_id"), F.lit("page_text"), F.lit("")))
    waits, fails = k % 11 == 9, k % 7 == 3
    tried = ks.select(name.alias("source_id"), (~waits & ~fails).alias("ok"), waits.alias("quarantined"), F.when(waits, "waits").when(fails, "timeout").otherwise("").alias("error"))
    tried = tried.unionByName(p.select("source_id", F.lit(True).alias("ok"), F.lit(False).alias("quarantined"), F.lit("").alias("error")))
    page = F.lit("https://example.com/jobs")
    attempts = tried.select("*", F.lit("2024-01-20 06:00:00").cast("timestamp").alias("ts"), page.alias("requested"), page.alias("final"))
    wanted = o.where("(n % 3 = 0 OR title RLIKE '\\\\b20(2[6-9]|3[0-9])\\\\b') AND place <> 'London' AND n % 10 <> 3")
    key = F.when(F.col("place") != "", F.concat("title", F.lit(" @ "), "place")).otherwise(F.col("title"))
    old_rows = wanted.select(name.alias("source_id"), "section", key.alias("key"), F.concat(F.lit("URL="), "url").alias("value"), "url")
    return {"sources": sources, "attempts": attempts, "bodies": feeds.unionByName(p.select("source_id", F.lit(0).alias("page_no"), html.alias("body"))), "old_rows": old_rows, "old_lines": old_lines}


def _nobody(spark) -> dict:
    return {"muted": spark.createDataFrame([], "name string"), "applied": spark.createDataFrame([], "mute_key string")}


_GOOD = "k % 7 <> 3 AND k % 11 <> 9 AND k % 7 <> 5 AND k % 13 <> 6"
_DAY = f"""{LINES},
o AS (SELECT o_orderkey AS n, o_orderkey // 1000 AS k, o_orderpriority AS section, CASE WHEN o_orderkey % 8 = 0 THEN 'London' WHEN o_orderkey % 20 = 4 THEN '' ELSE 'Austin, TX' END AS place,
             CASE WHEN o_orderkey % 3 = 0 THEN 'Summer Intern Order ' ELSE 'Manager Order ' END || o_orderkey AS title FROM orders),
r AS (SELECT *, title || CASE WHEN place <> '' THEN ' @ ' || place ELSE '' END AS key FROM o WHERE (n % 3 = 0 OR regexp_matches(title, '\\b20(2[6-9]|3[0-9])\\b')) AND place <> 'London'),
a AS (SELECT * FROM r WHERE n % 10 <> 3 AND {_GOOD}), b AS (SELECT * FROM r WHERE n % 10 <> 7 AND {_GOOD} AND k IN (SELECT k FROM a)),
c AS (SELECT coalesce(a.k, b.k) AS k, a.n IS NULL AS is_new, coalesce(b.n, a.n) AS n, coalesce(b.section, a.section) AS section, coalesce(b.key, a.key) AS key FROM a FULL JOIN b ON a.n = b.n WHERE a.n IS NULL OR b.n IS NULL),
z AS (SELECT k, count(*) FILTER (n % 10 <> 3) AS na, count(*) FILTER (n % 10 <> 7) AS nb FROM r GROUP BY k),
v AS (SELECT k, count(*) AS m FROM c JOIN z USING (k) GROUP BY k, na, nb HAVING count(*) >= 25 AND count(*) > 0.25 * greatest(na, nb, 1)),
w AS (SELECT page_id, lines, CASE WHEN page_id % 7 = 0 THEN list_concat(['{INSIGHT}'], lines) ELSE lines END AS new_lines FROM l),
x AS (SELECT w.page_id, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN len(list_filter(lines, lambda y: y = lines[2])) ELSE 0 END AS more, page_id % 7 = 0 AS discovery,
             length(array_to_string(new_lines, chr(10))) AS chars, length(coalesce(html, '')) + CASE WHEN page_id % 7 = 0 THEN {len(INSIGHT) + 7} ELSE 0 END AS html_chars FROM w JOIN pages USING (page_id)),
d AS (SELECT 'b' || k AS source_id, 'added' AS kind, key, section || ' :: ' || key AS identity, n, k FROM c WHERE is_new AND k NOT IN (SELECT k FROM v)
      UNION ALL SELECT 'b' || k, 'changed', 'b' || k || ': ' || m || ' rows changed at once', '', NULL, k FROM v
      UNION ALL SELECT DISTINCT 'b' || k, 'section', 'new section: ' || section, 'section :: ' || section, NULL, k FROM b WHERE k NOT IN (SELECT k FROM v) AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.section = b.section)
      UNION ALL SELECT 'page-' || page_id, 'changed', 'page changed: ' || more || ' added, 0 removed', 'page :: text', NULL, NULL FROM x WHERE more > 0 AND chars >= 500 AND chars >= html_chars * 0.0015)"""


@query(f"WITH {_DAY} SELECT source_id, kind, key FROM d")
def process_raw(spark, sf_dir):
    """From raw feed bodies and pages of several methods to the day's changes."""
    found = daily.process_raw(**raw_day(spark, sf_dir), **_nobody(spark), as_of=as_of())
    return found.day.changes.select("source_id", "kind", "key")


@query(f"""WITH {_DAY}, s AS (SELECT DISTINCT k FROM o)
SELECT 'b' || k AS source_id, {_GOOD} AS ok, k % 11 = 9 AS quarantined,
       CASE WHEN k % 13 = 6 AND k % 11 <> 9 AND k % 7 <> 3 THEN 'nothing reads method ftp' WHEN k % 13 = 6 THEN 'nothing reads method ftp' WHEN k % 11 = 9 THEN 'waits' WHEN k % 7 = 3 THEN 'timeout' WHEN k % 7 = 5 AND k % 3 = 1 THEN 'not a list' WHEN k % 7 = 5 THEN 'the feed reports an error' ELSE '' END AS error FROM s
UNION ALL SELECT 'page-' || page_id, chars >= 500 AND chars >= html_chars * 0.0015, false, CASE WHEN chars < 500 THEN chars || ' characters of text' WHEN chars < html_chars * 0.0015 THEN 'almost no text in its markup' ELSE '' END FROM x""")
def process_raw_results(spark, sf_dir):
    """What the same day says of each source."""
    read = daily.parsed(**raw_day(spark, sf_dir))
    return read.results.select("source_id", "ok", "quarantined", F.regexp_replace("error", r"(characters of text): (?s).*", "$1").alias("error"))


def _day(spark, sf_dir):
    raw = raw_day(spark, sf_dir)
    n = F.regexp_extract("key", r"(\d+)", 1).cast("long")
    change_id = keys.change_id(F.col("source_id"), keys.identity(F.col("section"), F.col("key")))
    o = _orders(spark, sf_dir).where("n % 2 = 0")
    key = F.when(F.col("place") != "", F.concat("title", F.lit(" @ "), "place")).otherwise(F.col("title"))
    said = o.select(F.concat(F.lit("b"), F.col("k").cast("string")).alias("source_id"), "section", key.alias("key")).withColumns({"change_id": change_id, "n": n})
    judgments = said.select("change_id", F.lit("model").alias("outcome"), (F.col("n") % 4 == 0).alias("relevant"), F.lit("high").alias("confidence"), F.lit("other field").alias("why"), F.when(F.col("n") % 12 == 0, "2024-01-25").otherwise("rolling").alias("deadline"), F.lit("").alias("class_year"), F.lit("").alias("location"), F.lit("small").alias("employer_size"))
    states = raw["attempts"].select("source_id", F.regexp_extract("source_id", r"(\d+)", 1).cast("long").alias("k")).select("source_id", (F.col("k") % 6).alias("failures"), F.lit(None).cast("timestamp").alias("last_success"), F.lit("2024-01-19 06:00:00").cast("timestamp").alias("last_attempt"))
    names = raw["sources"].where("program_names <> ''").select(F.col("program_names").alias("name"))
    programs = names.select("name", F.lit("dormant").alias("status"), F.lit("before").alias("last_checked"), F.lit("old").alias("snapshot_hash"), F.lit("before").alias("last_changed"))
    pins = spark.createDataFrame([], "change_id string, source_id string, company string, position string, deadline string, first_pinned string, last_seen string")
    texts = spark.createDataFrame([], "change_id string, text string")
    now = F.lit("2024-01-20 07:00:00").cast("timestamp")
    return daily.run_day(**raw, **_nobody(spark), texts=texts, judgments=judgments, pins=pins, states=states, programs=programs, as_of=as_of(), now=now, most=1 << 40)


@query(f"""WITH {_DAY}, j AS (SELECT *, coalesce(n % 2 = 0, false) AS judged FROM d)
SELECT source_id, kind, key, CASE WHEN judged THEN 'model' ELSE 'unclassified' END AS outcome, CASE WHEN judged THEN n % 4 = 0 ELSE true END AS relevant,
       CASE WHEN judged AND n % 12 = 0 THEN 'High' ELSE 'Medium' END AS tier, CASE WHEN NOT judged THEN 'unverified' WHEN n % 12 = 0 THEN 'closes Jan 25 (5 days)' ELSE 'rolling, no close date' END AS reason,
       CASE WHEN k IS NULL THEN '' ELSE 'Firm ' || k END AS company, key AS position FROM j""")
def run_day(spark, sf_dir):
    """The whole day: its rows, judged and ranked."""
    return _day(spark, sf_dir).rows.select("source_id", "kind", "key", "outcome", "relevant", "tier", "reason", "company", "position")


@query(f"""WITH {_DAY}, s AS (SELECT DISTINCT k FROM o), e AS (SELECT 'b' || k AS source_id, k % 6 AS before, k % 11 = 9 AS waits, {_GOOD} AS ok FROM s
  UNION ALL SELECT 'page-' || page_id, page_id % 6, false, chars >= 500 AND chars >= html_chars * 0.0015 FROM x)
SELECT source_id, CASE WHEN waits THEN before WHEN ok THEN 0 ELSE before + 1 END AS failures, ok AND NOT waits AS succeeded FROM e""")
def run_day_states(spark, sf_dir):
    """The states of all sources after the same day."""
    return _day(spark, sf_dir).states.select("source_id", "failures", F.col("last_success").isNotNull().alias("succeeded"))


# ---------------------------------------------------------------- the digest


@query(f"""WITH e AS (SELECT user_id AS k, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id),
q AS (SELECT o_orderkey AS ord, o_orderkey % 5 <> 0 AS relevant, o_orderkey % 35 = 1 AS top, CASE WHEN o_orderkey % 3 = 0 THEN 'High' ELSE 'Medium' END AS tier, CASE WHEN o_orderkey % 3 = 0 THEN 'closes Jan 25 (5 days)' ELSE 'no deadline stated' END AS reason,
             CASE WHEN o_orderkey % 2 = 0 THEN 'small' ELSE '' END AS size, 'Firm ' || (o_orderkey % 100) AS company, 'Order ' || o_orderkey AS position FROM orders),
t AS (SELECT CASE WHEN NOT relevant THEN 2 WHEN top THEN 0 ELSE 1 END AS part, 1 AS sort, company, position, tier || ': ' || reason AS priority, CASE WHEN NOT relevant THEN CASE WHEN ord % 10 = 0 THEN 'sophomores only' ELSE 'not relevant' END ELSE 'Location: Austin; low confidence' END AS note,
             CASE WHEN NOT relevant THEN 3 WHEN top THEN 0 WHEN tier = 'High' THEN 1 ELSE 2 END AS b1, CASE WHEN tier = 'High' THEN 0 ELSE 2 END AS b2, size <> 'small' AS b3, ord AS b4, '' AS b5, '' AS b6 FROM q
      UNION ALL SELECT 0, 2, 'Firm ' || c_custkey, c_name, '', 'since 2024-01-0' || (c_custkey % 9 + 1), 0, 4, true, 0, '2024-01-0' || (c_custkey % 9 + 1) || lower('Firm ' || c_custkey), lower(c_name) FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT 1, 0, 'src-' || k, 'SOURCE BLIND: ' || errors || ' failures running', 'High: source blind', 'not quiet, blind. Last success never. timeout', 0, 4, true, 0, '', lpad('src-' || k, 20, ' ') FROM e WHERE k % 4 = 0 AND errors >= 3),
s AS (SELECT *, length(concat_ws(' | ', priority, company, position, note)) + 1 AS n FROM t),
u AS (SELECT *, sum(n) OVER (PARTITION BY part = 1) AS total, sum(n) OVER (PARTITION BY part = 1 ORDER BY part, sort, b1, b2, b3, b4, b5, b6 ROWS UNBOUNDED PRECEDING) AS used, count(*) OVER (PARTITION BY part = 1) AS many, (SELECT sum(n) FROM s WHERE part <> 1) AS rest FROM s)
SELECT part, company, position, priority, note, sort = 0 OR part <> 1 OR used + 400000 + rest <= CASE WHEN total + 400000 + rest <= 1000000 THEN 1000000 ELSE 1000000 - (length(many || ' more rows did not fit.') + 1) END AS shown FROM u""")
def digest_table(spark, sf_dir):
    """A message of a million characters of ranked orders, pins and blind sources."""
    n = F.col("o_orderkey")
    note = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in (("Location", "Austin"), ("", "low confidence"))])
    rows = table(spark, sf_dir, "orders").select(
        n.cast("string").alias("change_id"), n.alias("ord"), (n % 5 != 0).alias("relevant"), (n % 35 == 1).alias("top"), F.when(n % 3 == 0, "High").otherwise("Medium").alias("tier"),
        F.when(n % 3 == 0, "closes Jan 25 (5 days)").otherwise("no deadline stated").alias("reason"), F.when(n % 2 == 0, "small").otherwise("").alias("employer_size"),
        F.concat(F.lit("Firm "), (n % 100).cast("string")).alias("company"), F.concat(F.lit("Order "), n.cast("string")).alias("position"), note.alias("notes"),
        F.when(n % 10 == 0, "sophomore-title").alias("rule"), F.lit(None).cast("string").alias("quote"), F.lit("").alias("why"),
    )
    c = F.col("c_custkey")
    # pins of even customers; those of odd ones are of rows that moved today, so they don't stand
    pin_id = F.when(c % 2 == 0, F.concat(F.lit("pin "), c.cast("string"))).otherwise(c.cast("string"))
    moved = table(spark, sf_dir, "orders").select(n.cast("string").alias("change_id"))
    pins = table(spark, sf_dir, "customer").select(pin_id.alias("change_id"), F.concat(F.lit("Firm "), c.cast("string")).alias("company"), F.col("c_name").alias("position"), F.concat(F.lit("2024-01-0"), (c % 9 + 1).cast("string")).alias("first_pinned"))
    pins = pins.where(F.startswith("change_id", F.lit("pin"))).unionByName(pins.hint("merge").join(moved, "change_id", "left_semi"))
    k = F.col("user_id")
    by = table(spark, sf_dir, "events").groupBy(k).agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    source = F.concat(F.lit("src-"), k.cast("string")).alias("source_id")
    results = by.select(source, F.when(k % 4 != 0, True).alias("ok"), F.when(k % 4 == 0, "timeout").alias("error"))
    states = by.select(source, F.col("errors").alias("failures"), F.lit("").alias("last_success"))
    found = daily.digest(rows, pins, results, states, header=400_000, footer=0, most=1_000_000)
    return found.select("part", "company", "position", "priority", "note", F.when(F.col("priority") == "High: source blind", True).otherwise(F.col("shown")).alias("shown"))


# ---------------------------------------------------------------- coverage, discovery, additions


@query(f"""WITH r AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 4 = 0 THEN 'Quant' WHEN o_orderkey % 4 = 1 THEN 'Software' WHEN o_orderkey % 4 = 2 THEN 'Civil' ELSE 'PhD Quant' END AS kind, o_orderkey % 9 = 0 AS abroad FROM orders WHERE o_orderkey >= 10000),
ours AS (SELECT n, kind, n % 2 = 0 AS listed FROM r WHERE n % 3 <> 0 AND kind <> 'PhD Quant' AND NOT abroad),
theirs AS (SELECT n, kind FROM r WHERE n % 5 <> 0 AND n % 7 <> 0 AND kind <> 'PhD Quant' AND NOT abroad),
g AS (SELECT coalesce(ours.n, theirs.n) AS n, coalesce(ours.kind, theirs.kind) AS kind, ours.n IS NOT NULL AS us, theirs.n IS NOT NULL AS them, coalesce(listed, false) AS listed FROM ours FULL JOIN theirs ON ours.n = theirs.n),
s AS (SELECT 'fields' AS scope, * FROM g WHERE kind IN ('Quant', 'Software') UNION ALL SELECT 'quant', * FROM g WHERE kind = 'Quant')
SELECT scope, count(*) FILTER (us) AS ours, count(*) FILTER (them) AS theirs, count(*) FILTER (us AND NOT them) AS only_ours, count(*) FILTER (us AND NOT them AND NOT listed) AS only_ours_direct,
       CASE WHEN count(*) FILTER (them) > 0 THEN count(*) FILTER (us AND NOT them) / count(*) FILTER (them) ELSE 0.0 END AS lead, '{AS_OF}' AS date FROM s GROUP BY scope""")
def coverage_job(spark, sf_dir):
    """Snapshots of lists and boards against a published list, for all fields and for quant."""
    o, n = table(spark, sf_dir, "orders").where("o_orderkey >= 10000"), F.col("o_orderkey")
    kind = F.when(n % 4 == 0, "Quant").when(n % 4 == 1, "Software").when(n % 4 == 2, "Civil").otherwise("PhD Quant")
    place = F.when(n % 9 == 0, "London").otherwise("Austin, TX")
    url, firm = F.concat(F.lit("https://x.org/jobs/"), n.cast("string")), F.concat(F.lit("F"), n.cast("string"))
    source = F.when(n % 2 == 0, "list").otherwise(F.concat(F.lit("board-"), (n % 1000).cast("string")))
    title = F.concat(kind, F.lit(" Intern Order "), n.cast("string"))
    key = F.concat(F.when(n % 2 == 0, F.concat(firm, F.lit(" / "))).otherwise(""), title, F.lit(" @ "), place)
    snapshots = o.where("o_orderkey % 3 <> 0").select(source.alias("source_id"), F.lit("S").alias("section"), key.alias("key"), F.lit("").alias("value"), url.alias("url"))
    sources = snapshots.select("source_id").distinct().select("source_id", F.when(F.col("source_id") == "list", "github_readme").otherwise("greenhouse").alias("method"), F.concat(F.lit("Firm of "), "source_id").alias("program_names"))
    one = F.struct(title.alias("title"), firm.alias("company_name"), url.alias("url"), F.lit(True).alias("active"), (n % 7 != 0).alias("is_visible"), F.array(place).alias("locations"), F.lit("").alias("category"))
    # the published list comes in files of a thousand order numbers
    listings = o.where("o_orderkey % 5 <> 0").groupBy(F.floor(n / 1000)).agg(F.to_json(F.collect_list(one)).alias("body")).select("body")
    return daily.coverage_of(snapshots, sources, listings, AS_OF).withColumn("date", F.col("date").cast("string"))


def _linked(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    n = k.cast("string")
    link = (
        F.when(k % 4 == 0, F.concat(F.lit('<a href="https://boards.greenhouse.io/Acme'), n, F.lit('/jobs/4"> jobs.lever.co/acme'), n))
        .when(k % 4 == 1, F.concat(F.lit("<script src='https://boards.greenhouse.io/embed/job_board/js?for=Beta"), n, F.lit("'></script>")))
        .when(k % 4 == 2, F.concat(F.lit("see https://jobs.ashbyhq.com/gamma-"), (k % 50).cast("string"), F.lit(" and https://jobs.ashbyhq.com/api")))
        .otherwise("")
    )
    return p.select(k, "url", F.concat(F.coalesce("html", F.lit("")), F.lit(" "), link).alias("html"))


_BOARDS_SQL = """
f AS (SELECT page_id, 'greenhouse' AS method, 'acme' || page_id AS slug FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 'lever', 'acme' || page_id FROM pages WHERE page_id % 4 = 0
      UNION ALL SELECT page_id, 'greenhouse', 'beta' || page_id FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 'ashby', 'gamma-' || (page_id % 50) FROM pages WHERE page_id % 4 = 2)"""


@query(f"WITH {_BOARDS_SQL} SELECT * FROM f")
def board_fingerprints(spark, sf_dir):
    """Boards that whole pages name, in one pass over their text."""
    return PG.fingerprints(_linked(spark, sf_dir)).select("page_id", "method", "slug")


@query(f"""WITH {_BOARDS_SQL}, c AS (SELECT method AS kind, slug AS key, min(page_id::VARCHAR) AS evidence FROM f GROUP BY ALL
  UNION ALL SELECT 'repository', lower(c_name), 'https://git.example/' || c_custkey FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 50 >= 25 AND c_custkey % 4 <> 3)
SELECT kind, key, evidence, CASE WHEN substr(key, -1) = '2' THEN 'discarded' ELSE 'proposed' END AS status FROM c WHERE NOT (kind = 'lever' AND substr(key, -1) = '0')""")
def discover_candidates(spark, sf_dir):
    """Boards in pages and live repositories, without known ones, triaged."""
    c = F.col("c_custkey")
    repositories = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("https://git.example/"), c.cast("string")).alias("url"), (c % 50).alias("stars"), (c % 6 == 0).alias("archived"), F.when(c % 5 == 0, True).alias("fork"), F.when(c % 4 == 3, "2023-01-01T00:00:00Z").otherwise("2024-01-02T00:00:00Z").alias("pushed_at"))
    pages = _linked(spark, sf_dir).drop("url")
    slugs = pages.select(F.concat(F.lit("acme"), F.col("page_id").cast("string")).alias("key"))
    known = slugs.where(F.endswith("key", F.lit("0"))).select(F.lit("lever").alias("kind"), "key")
    found = PG.fingerprints(pages).select(F.col("method").alias("kind"), F.col("slug").alias("key")).unionByName(repositories.select(F.lit("repository").alias("kind"), F.lower("name").alias("key")))
    judged = found.distinct().where(F.substring("key", -1, 1).isin("1", "2")).select("kind", "key", F.when(F.endswith("key", F.lit("2")), " LOW").otherwise("high").alias("priority"))
    none = known.limit(0)
    return jobs.discover(pages, known, none, judged, repositories, as_of()).select("kind", "key", "evidence", "status")


def _entries(spark, sf_dir):
    c, name = F.col("c_custkey"), F.col("c_name")
    some = lambda when, *fields: F.when(when, F.struct(*fields))
    text_ = lambda value, alias: F.lit(value).cast("string").alias(alias)
    e = table(spark, sf_dir, "customer").select(
        c.alias("ord"), F.when(c % 4 == 1, F.concat(F.lit("  "), F.upper(name), F.lit(" "))).otherwise(name).alias("name"), F.concat(F.lit("https://x.org/"), c.cast("string")).alias("url"), F.lit("Competition").alias("category"),
        F.lit("n").alias("notes"), F.when(c % 3 == 0, "LATER").otherwise("").alias("eligible"), F.lit("").alias("status"), F.lit(True).alias("by_agent"),
        some(c % 2 == 0, F.when(c % 4 == 0, F.concat(F.lit("own-"), (c % 100).cast("string"))).alias("source_id"), text_(None, "method"), text_(None, "tier"), text_(None, "signal")).alias("source"),
        some(c % 3 == 0, text_("why", "why_manual"), text_(None, "how_to_check"), text_("May", "when_to_check")).alias("manual"),
        some(c % 5 == 0, text_("B", "band"), text_(None, "value"), text_("w", "why")).alias("priority"),
    )
    # every seventh entry comes twice
    return e.unionByName(e.where("ord % 7 = 0").withColumn("ord", F.col("ord") + 10_000_000))


def _tables(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = lambda n: c.where(f"c_custkey % {n} = 0").select("c_name")
    return {
        "programs": name(11).select(F.concat(F.lit(" "), F.lower("c_name")).alias("name")),
        "sources": c.where("c_custkey % 8 = 0").select(F.concat(F.lit("own-"), (F.col("c_custkey") % 100).cast("string")).alias("source_id")).distinct(),
        "manual": name(9).select(F.col("c_name").alias("name")),
        "priority": name(25).select(F.col("c_name").alias("name"), F.lit("7").alias("rank")),
    }


def _route(spark, sf_dir, which):
    return PG.routed(_entries(spark, sf_dir), _tables(spark, sf_dir), as_of())[which]


_ENTRIES = """e AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 4 = 1 THEN upper(c_name) ELSE c_name END AS name, lower(c_name) AS slug_name FROM customer WHERE c_custkey % 11 <> 0),
i AS (SELECT DISTINCT 'own-' || (c_custkey % 100) AS id FROM customer WHERE c_custkey % 8 = 0),
s AS (SELECT *, c % 4 = 0 AS stated, CASE WHEN c % 4 = 0 THEN 'own-' || (c % 100) ELSE trim(regexp_replace(slug_name, '[^a-z0-9]+', '-', 'g'), '-') END AS id FROM e WHERE c % 2 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY stated, id ORDER BY c) AS nth FROM s)"""


@query(f"""WITH {_ENTRIES} SELECT e.c AS ord, e.name, 'https://x.org/' || e.c AS website, 'Competition' AS category, CASE WHEN e.c % 3 = 0 THEN 'LATER' ELSE 'CHECK' END AS eligible, 'n' AS notes, coalesce(s.id, '') AS source_id, 'unknown' AS status, '{AS_OF}' AS first_seen, 'false' AS muted FROM e LEFT JOIN s ON s.c = e.c""")
def routed_programs(spark, sf_dir):
    return _route(spark, sf_dir, "programs")


@query(f"""WITH {_ENTRIES} SELECT c AS ord, id AS source_id, '3' AS tier, 'page_text' AS method, 'https://x.org/' || c AS url, name AS program_names, 'high' AS signal, '0' AS consecutive_failures FROM t WHERE nth = 1 AND (NOT stated OR id NOT IN (SELECT id FROM i))""")
def routed_sources(spark, sf_dir):
    return _route(spark, sf_dir, "sources")


@query(f"""WITH {_ENTRIES} SELECT c AS ord, name, 'Competition' AS category, 'https://x.org/' || c AS url, 'why' AS why_manual, 'Open the page in your browser.' AS how_to_check, 'May' AS when_to_check FROM e WHERE c % 3 = 0 AND c % 9 <> 0""")
def routed_manual(spark, sf_dir):
    return _route(spark, sf_dir, "manual")


@query(f"""WITH {_ENTRIES} SELECT c AS ord, (row_number() OVER (ORDER BY c) + (SELECT CASE WHEN count(*) > 0 THEN 7 ELSE 0 END FROM customer WHERE c_custkey % 25 = 0))::VARCHAR AS rank, 'B' AS band, name, 'Competition' AS category, 'Medium' AS value, 'w' AS why, 'https://x.org/' || c AS url FROM e WHERE c % 5 = 0 AND c % 25 <> 0""")
def routed_priority(spark, sf_dir):
    return _route(spark, sf_dir, "priority")


# ---------------------------------------------------------------- orders of everything, hashes


@query(f"""WITH {BOARDS}, t AS (SELECT source_id, section || chr(9) || key || chr(9) || value AS line FROM b),
r AS (SELECT source_id, string_agg(line, chr(10) ORDER BY line) AS rows FROM (SELECT DISTINCT * FROM t) GROUP BY source_id), s AS (SELECT source_id, string_agg(section, chr(10) ORDER BY section) AS sections FROM (SELECT DISTINCT source_id, section FROM b) GROUP BY source_id)
SELECT source_id, sha256('# sections' || chr(10) || sections || chr(10) || '# rows' || chr(10) || rows || chr(10)) AS hash FROM r JOIN s USING (source_id)""")
def snapshot_hashes(spark, sf_dir):
    rows = boards(spark, sf_dir, "new")
    return SN.snapshot_hash(rows, rows.select("source_id", "section").distinct())


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS position FROM orders")
def all_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return I.positions(o, [F.col("o_orderpriority").asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).select("o_orderkey", "position")


@query("SELECT o_orderkey AS ord, row_number() OVER (ORDER BY o_orderkey % 7 <> 0, o_orderkey % 3 <> 0, o_orderkey) <= 250 AS judged FROM orders")
def judging_budget(spark, sf_dir):
    """The first 250 of all rows, rolling firms and discovery programmes before others."""
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(n.alias("ord"), (n % 7 == 0).alias("rolling"), (n % 3 == 0).alias("discovery"))
    return R.within_budget(rows, R.judging_order()).select("ord", "judged")


@query("""WITH r AS (SELECT o_orderkey AS ord, length(o_comment_) AS n FROM (SELECT o_orderkey, o_orderpriority || o_orderkey AS o_comment_ FROM orders)),
u AS (SELECT *, sum(n + 1) OVER (ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS used, sum(n + 1) OVER () AS total, count(*) OVER () AS many FROM r)
SELECT ord, used + 8000 <= CASE WHEN total + 8000 <= 65536 THEN 65536 ELSE 65536 - (length(many || ' more rows did not fit.') + 1) END AS shown FROM u""")
def fit_one_message(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.length(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("length"))
    return R.fitted_one(rows, [F.col("ord").desc()], "length", 1000, 7000, folder=work_folder(spark, "fit")).select("ord", "shown")
