"""Registered queries of program tracking, source floors, health lines and what goes round a digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import health as HL
from tidewatch.operators import tracking as T
from tidewatch.plans.catalog import AS_OF, BOARDS, CHANGES, both_boards, query, table
from tidewatch.plans.catalog_text import cases, joined, number, parts


# ---------------------------------------------------------------- floors of sources


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS rows, count(DISTINCT o_orderpriority) AS sections, count(*) FILTER (o_orderstatus = 'O') AS unreadable FROM orders GROUP BY o_custkey),
d AS (SELECT k, CASE WHEN k % 9 = 0 THEN 0 ELSE rows END AS rows, sections, CASE WHEN k % 2 = 0 THEN rows END AS previous, CASE WHEN k % 18 = 0 AND k % 4 = 0 THEN 3 END AS screened, rows AS boards, unreadable FROM c)
SELECT 'src-' || k AS source_id, CASE
  WHEN k % 5 < 3 AND rows < 8 AND k % 9 <> 0 THEN 'parsed only ' || rows || ' rows, expected at least 8'
  WHEN k % 5 < 3 AND sections < 4 THEN 'parsed only ' || sections || ' sections, expected at least 4'
  WHEN rows = 0 AND previous > 0 AND screened IS NULL THEN 'returned 0 rows, down from ' || previous || ' tracked rows'
  WHEN unreadable * 2 > boards THEN unreadable || ' of ' || boards || ' boards could not be read' ELSE '' END AS error FROM d""")
def source_floors(spark, sf_dir):
    """Customers as sources of orders, some of them emptied; a part of the sources has floors."""
    k = F.col("o_custkey")
    found = table(spark, sf_dir, "orders").groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("sections"), F.count_if(F.col("o_orderstatus") == "O").alias("unreadable"))
    source = F.concat(F.lit("src-"), k.cast("string")).alias("source_id")
    counts = found.select(
        source,
        F.when(k % 9 == 0, 0).otherwise(F.col("n")).alias("rows"),
        "sections",
        F.when(k % 2 == 0, F.col("n")).alias("previous"),
        F.when(k % 36 == 0, 3).alias("pre_screened"),
        F.col("n").alias("boards"),
        "unreadable",
    )
    floors = found.where(k % 5 < 3).select(source, F.when(k % 9 != 0, 8).alias("min_rows"), F.lit(4).alias("min_sections"))
    return HL.plausible(counts, floors).select("source_id", "error")


_HEALTH = """
a AS (SELECT user_id AS k, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id),
s AS (SELECT 'src-' || k AS id, k, n, k % 4 <> 0 AS ok, k % 8 = 0 AS waits, errors AS run, CASE WHEN k % 12 = 0 THEN 'never' ELSE 'day ' || n END AS since FROM a)"""


def _health(spark, sf_dir):
    k = F.col("user_id")
    a = table(spark, sf_dir, "events").groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    source = F.concat(F.lit("src-"), k.cast("string")).alias("source_id")
    results = a.select(
        source,
        k.alias("ord"),
        F.when(k % 4 != 0, True).alias("ok"),
        (k % 8 == 0).alias("quarantined"),
        F.when(k % 4 == 0, "timeout").alias("error"),
        (k % 7 == 1).alias("baseline"),
        F.col("n").alias("rows"),
        F.when(k % 11 == 2, "now at another address").alias("redirected"),
        F.when(k % 13 == 3, F.col("n")).alias("collapsed"),
    )
    return results, a.select(source, F.col("errors").alias("failures"), F.when(k % 12 != 0, F.concat(F.lit("day "), F.col("n").cast("string"))).alias("last_success"))


@query(f"""WITH {_HEALTH}
SELECT '' AS source_id, 0 AS block, 0 AS ord, count(*) || ' sources checked, ' || count(*) FILTER (ok) || ' healthy' || CASE WHEN count(*) FILTER (NOT ok) > 0 THEN ', ' || count(*) FILTER (NOT ok) || ' failing' ELSE '' END AS line FROM s
UNION ALL SELECT '', 1, 0, count(*) || ' sources were not fetched at all' FROM s WHERE waits HAVING count(*) > 0
UNION ALL SELECT id, 2, k, 'not fetched: ' || id FROM s WHERE waits
UNION ALL SELECT id, 3, k, id || ': ' || run || CASE WHEN run = 1 THEN ' consecutive failure' ELSE ' consecutive failures' END || ', last success ' || since || '. timeout' FROM s WHERE NOT ok
UNION ALL SELECT id, 4, k, id || ': first run, recorded ' || n || ' rows as the baseline.' FROM s WHERE k % 7 = 1
UNION ALL SELECT id, 5, k, id || ': now at another address' FROM s WHERE k % 11 = 2
UNION ALL SELECT id, 6, k, id || ': ' || n || ' rows changed at once and were collapsed into one item' FROM s WHERE k % 13 = 3""")
def source_health_lines(spark, sf_dir):
    return HL.health_lines(*_health(spark, sf_dir))


@query(f"""WITH {_HEALTH} SELECT id AS source_id, 'SOURCE BLIND: ' || run || ' failures running' AS position, 'not quiet, blind. Last success ' || since || '. timeout' AS note FROM s WHERE NOT ok AND run >= 3""")
def blind_sources(spark, sf_dir):
    return HL.blind(*_health(spark, sf_dir))


# ---------------------------------------------------------------- tracked programs

_TRACKED = """
p AS (SELECT c_custkey AS k, 'Program ' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'dormant' ELSE 'closed' END AS status FROM customer),
j AS (SELECT o_custkey AS k, o_orderkey AS ord, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'dormant' END AS status,
        'order ' || o_orderkey AS why FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderpriority NOT LIKE '5%' AND o_custkey % 10 <> 3),
q AS (SELECT j.*, p.name, coalesce(lag(j.status) OVER (PARTITION BY j.k ORDER BY ord), p.status) AS was FROM j JOIN p USING (k)),
c AS (SELECT * FROM q WHERE was <> status)"""


def _tracked(spark, sf_dir):
    """Customers as programs, two sources for each, and orders as judgments of them."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    customers = table(spark, sf_dir, "customer")
    source = lambda n, c: F.concat(F.lit(f"{n}-"), c.cast("string"))
    name = lambda c: F.concat(F.lit("Program "), c.cast("string"))
    states = F.when(k % 3 == 0, "open").when(k % 3 == 1, "dormant").otherwise("closed")
    programs = customers.select(name(k).alias("name"), states.alias("status"), F.lit("before").alias("last_checked"), F.lit("old").alias("snapshot_hash"), F.lit("before").alias("last_changed"), F.col("c_mktsegment").alias("eligible"))
    sides = customers.select(k, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"))
    both = sides.select(k, "side", F.concat_ws("-", "side", k.cast("string")).alias("source_id"))
    signal = F.when(k % 10 == 3, " Low ").when(k % 2 == 0, "high")
    sources = both.select("source_id", F.concat(name(k), F.lit(" | | No such program")).alias("program_names"), signal.alias("signal"))
    # the first source reads every program but each fourth, the second only each third one
    tried = both.where(((F.col("side") == "a") & (k % 4 != 0)) | ((F.col("side") == "b") & (k % 3 == 0)))
    ok = F.when(F.col("side") == "a", k % 5 != 0).otherwise(F.lit(True))
    results = tried.select("source_id", F.when(F.col("side") == "a", 1).otherwise(2).alias("ord"), ok.alias("ok"), F.concat(F.lit("hash of "), "source_id").alias("snapshot_hash"), F.when(F.col("side") == "a", k % 6).alias("changes"))
    to = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("dormant")
    new = F.when(F.startswith("o_orderpriority", F.lit("5")), F.when(o % 2 == 0, "unknown").otherwise("elsewhere")).otherwise(to)
    judgments = table(spark, sf_dir, "orders").select(
        source("a", F.col("o_custkey")).alias("source_id"),
        name(F.col("o_custkey")).alias("program_name"),
        o.alias("ord"),
        F.when(o % 5 != 0, True).alias("classified"),
        (o % 7 != 0).alias("relevant"),
        F.when(o % 11 == 0, "low").when(o % 2 == 0, "high").alias("confidence"),
        new.alias("new_status"),
        F.concat(F.lit("order "), o.cast("string")).alias("why"),
    )
    return T.tracked(programs, sources, results, judgments, F.lit("now"))


@query(f"""WITH {_TRACKED}, l AS (SELECT k, arg_max(status, ord) AS status FROM c GROUP BY k)
SELECT p.name, coalesce(l.status, p.status) AS status, CASE WHEN p.k % 4 <> 0 OR p.k % 3 = 0 THEN 'now' ELSE 'before' END AS last_checked,
  CASE WHEN p.k % 3 = 0 THEN 'hash of b-' || p.k WHEN p.k % 4 <> 0 AND p.k % 5 <> 0 THEN 'hash of a-' || p.k ELSE 'old' END AS snapshot_hash,
  CASE WHEN l.status IS NOT NULL OR (p.k % 4 <> 0 AND p.k % 6 > 0) THEN 'now' ELSE 'before' END AS last_changed, c_mktsegment AS eligible
FROM p JOIN customer ON c_custkey = p.k LEFT JOIN l ON l.k = p.k""")
def program_states(spark, sf_dir):
    return _tracked(spark, sf_dir)[0]


@query(f"WITH {_TRACKED} SELECT 'a-' || k AS source_id, name, ord, was, status, why FROM c")
def program_proposals(spark, sf_dir):
    return _tracked(spark, sf_dir)[1]


# ---------------------------------------------------------------- boards, reminders, notes


@query(f"""WITH {BOARDS}, {CHANGES},
e AS (SELECT o_orderpriority AS board, arg_min(o_orderstatus || ' Corp', o_orderkey) AS employer FROM orders WHERE o_orderpriority NOT LIKE '2%' AND o_orderkey % 3 = 0 GROUP BY o_orderpriority),
x AS (SELECT source_id, identity, kind, split_part(identity, ' :: ', 1) AS board FROM c WHERE kind IS NOT NULL
  UNION ALL SELECT DISTINCT source_id, 'section :: ' || section, 'section', '' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.source_id = b.source_id AND a.section = b.section))
SELECT source_id, identity, kind, x.board, coalesce(employer, x.board) AS employer FROM x LEFT JOIN e ON x.board = e.board""")
def change_boards(spark, sf_dir):
    from tidewatch.operators import snapshot as SN

    old, new = both_boards(spark, sf_dir)
    o = F.col("o_orderkey")
    company = F.when(o % 3 == 0, F.concat(F.lit(" "), "o_orderstatus", F.lit(" Corp"))).when(o % 3 == 1, "  ")
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("board"), F.when(~F.startswith("o_orderpriority", F.lit("2")), company).alias("company"), o.alias("ord"))
    return T.boards_of(SN.diff(old, new), old, new, names).select("source_id", "identity", "kind", "board", "employer")


@query(f"""SELECT 'January' AS month, 0 AS every, o_orderkey AS ord, o_orderpriority AS reminder FROM orders WHERE month(o_orderdate) = month(DATE '{AS_OF}')
UNION ALL SELECT 'January', 1, n_nationkey, n_name FROM nation""")
def month_reminders(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("reminder"))
    always = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("reminder"))
    return T.reminders(months, always, F.lit(AS_OF).cast("date"))


@query("SELECT 'shared' AS run, 'no credentials' AS note UNION ALL SELECT 'mixed', NULL UNION ALL SELECT 'none', NULL")
def run_notes(spark, sf_dir):
    """Three runs over all parts: one reason shared, several, and none."""
    rows = parts(spark, sf_dir)
    one = lambda run, why: T.run_note(rows.select(F.when(number() % 2 == 0, True).alias("classified"), why.alias("why"))).select(F.lit(run).alias("run"), "note")
    shared = one("shared", F.when(number() % 4 == 1, "no credentials").when(number() % 2 == 0, F.col("p_name")))
    return shared.unionByName(one("mixed", F.col("p_name"))).unionByName(one("none", F.when(number() % 2 == 0, F.col("p_name"))))


@query("""SELECT 'delivered' AS day, false AS send, false AS status_only UNION ALL SELECT 'failing', true, false UNION ALL SELECT 'judged', true, false
UNION ALL SELECT 'quiet', true, true UNION ALL SELECT 'empty', true, true""")
def delivery_decisions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    delivered = orders.select(F.col("o_orderdate").cast("date").alias("date"))
    results = orders.select((F.col("o_orderstatus") != "F").alias("ok"), F.lit(False).alias("baseline"))
    quiet, nothing = results.where("ok"), orders.where("o_orderkey < 0")
    day, first = F.lit("1980-01-01").cast("date"), F.to_date(F.lit("1980-01-01"))
    sent = delivered.select(F.least("date", first).alias("date"))
    rows = {
        "delivered": (orders, results, sent, day),
        "failing": (nothing, results, delivered, day),
        "judged": (orders, quiet, delivered, day),
        "quiet": (nothing, quiet, delivered, day),
        "empty": (nothing, results.where("ok IS NULL"), delivered.where("date IS NULL"), day),
    }
    out = None
    for name, args in rows.items():
        one = T.delivery(*args).select(F.lit(name).alias("day"), "send", "status_only")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Deadline: 2024-02-01; Location: ' || p_name || ' \\| ' || p_brand WHEN 1 THEN 'Deadline: rolling, closes when full; Year: ' || p_type
WHEN 2 THEN 'Deadline: rolling, closes when full; Size: small firm' WHEN 3 THEN ': unverified, open the page' WHEN 4 THEN CASE p_partkey % 4 WHEN 0 THEN ': no details stated on the posting' ELSE ': row disappeared from the source' END
ELSE 'Location: ' || p_name || '; : low confidence, kept deliberately' END AS notes FROM part""")
def row_notes(spark, sf_dir):
    deadline = cases("2024-02-01.", "soon", " Rolling ", "", "", F.lit(None))
    place = cases(joined("{p_name}", " |\n ", "{p_brand}", " ;"), "", "", " .", "", F.col("p_name"))
    year = F.when(number() % 6 == 1, F.col("p_type"))
    size = cases("large", "", "small", "", "", "")
    kind = F.when(number() % 4 == 0, "added").otherwise("removed")
    found = T.notes(deadline, number() % 6 == 1, year, place, size, F.when(number() % 6 != 3, True), F.when(number() % 6 == 5, "low").otherwise("high"), kind)
    text = F.array_join(F.transform(found, lambda x: F.concat(x["label"], F.lit(": "), x["value"])), "; ")
    return parts(spark, sf_dir).select("p_partkey", text.alias("notes"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN CASE WHEN page_id % 8 = 0 THEN 'workday' ELSE 'icims' END WHEN 1 THEN 'icims' ELSE 'workable' END AS vendor FROM pages WHERE page_id % 4 < 3""")
def unsupported_vendors(spark, sf_dir):
    from tidewatch.packs import recruiting

    k = F.col("page_id")
    link = F.when(k % 8 == 0, "https://acme.wd5.myworkdayjobs.com/x https://x.icims.com").when(k % 4 == 0, "https://acme.wd5.MyWorkdayJobs.com/x https://x.icims.com").when(k % 4 == 1, "https://jobs-acme.icims.com/a").when(k % 4 == 2, "https://apply.workable.com/acme").otherwise("")
    return T.unsupported(table(spark, sf_dir, "pages").select(k, F.concat_ws(" ", "html", link).alias("html")), recruiting.UNSUPPORTED)


@query(f"""WITH {_HEALTH}
SELECT 0 AS part, 0 AS block, 0 AS ord, 'no credentials' AS line
UNION ALL SELECT 1, 0, k, id || ' | SOURCE BLIND: ' || run || ' failures running | not quiet, blind. Last success ' || since || '. timeout' FROM s WHERE NOT ok AND run >= 3
UNION ALL SELECT 2, 0, 0, count(*) || ' sources checked, ' || count(*) FILTER (ok) || ' healthy' || CASE WHEN count(*) FILTER (NOT ok) > 0 THEN ', ' || count(*) FILTER (NOT ok) || ' failing' ELSE '' END FROM s
UNION ALL SELECT 2, 1, 0, count(*) || ' sources were not fetched at all' FROM s WHERE waits HAVING count(*) > 0
UNION ALL SELECT 2, 2, k, 'not fetched: ' || id FROM s WHERE waits
UNION ALL SELECT 2, 3, k, id || ': ' || run || CASE WHEN run = 1 THEN ' consecutive failure' ELSE ' consecutive failures' END || ', last success ' || since || '. timeout' FROM s WHERE NOT ok
UNION ALL SELECT 2, 4, k, id || ': first run, recorded ' || n || ' rows as the baseline.' FROM s WHERE k % 7 = 1
UNION ALL SELECT 2, 5, k, id || ': now at another address' FROM s WHERE k % 11 = 2
UNION ALL SELECT 2, 6, k, id || ': ' || n || ' rows changed at once and were collapsed into one item' FROM s WHERE k % 13 = 3
UNION ALL SELECT 3, 0, o_orderkey, o_orderpriority FROM orders WHERE month(o_orderdate) = month(DATE '{AS_OF}')
UNION ALL SELECT 3, 1, n_nationkey, n_name FROM nation""")
def digest_surroundings(spark, sf_dir):
    """The note, blind sources, health lines and reminders around a digest of all parts."""
    from tidewatch.plans import jobs

    results, states = _health(spark, sf_dir)
    judged = parts(spark, sf_dir).select(F.lit(False).alias("classified"), F.lit("no credentials").alias("why"))
    months = table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("reminder"))
    always = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("reminder"))
    return jobs.digest_lines(judged, results, states, months, always, F.lit(AS_OF).cast("date"))
