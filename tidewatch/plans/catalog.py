"""Registered queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import keys, text, urls
from tidewatch.operators import coverage as C
from tidewatch.operators import health as HL
from tidewatch.operators import identity as I
from tidewatch.operators import judgments as J
from tidewatch.operators import pages as P
from tidewatch.operators import pins as PN
from tidewatch.operators import programs as PG
from tidewatch.operators import rank as R
from tidewatch.operators import reports as RP
from tidewatch.operators import screens as S
from tidewatch.operators import snapshot as SN

QUERIES: dict = {}
ORACLE_SQL: dict = {}
AS_OF = "2024-01-20"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- boards from orders


def boards(spark, sf_dir: str, side: str) -> DataFrame:
    """Forty boards made of orders: the previous version lacks some rows, the current one others, and some values differ."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    value = F.concat_ws(" ", "o_orderstatus", cents.cast("string"))
    if side == "new":
        value = F.when(F.col("o_orderkey") % 13 == 0, F.concat(value, F.lit(" revised"))).otherwise(value)
    kept = o.where(F.col("o_orderkey") % 10 != (3 if side == "old" else 7))
    return kept.select(
        F.concat(F.lit("board-"), (F.col("o_custkey") % 40).cast("string")).alias("source_id"),
        F.col("o_orderpriority").alias("section"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("key"),
        value.alias("value"),
        F.concat(F.lit("https://example.com/orders/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderkey").alias("ord"),
    )


def both_boards(spark, sf_dir):
    old, new = boards(spark, sf_dir, "old"), boards(spark, sf_dir, "new")
    # the previous snapshot never had urgent sections
    return old.where("section <> '1-URGENT'"), new


_BOARD = """
  SELECT 'board-' || (o_custkey % 40) AS source_id, o_orderpriority AS section, 'Order ' || o_orderkey AS key,
         o_orderstatus || ' ' || cast(round(o_totalprice * 100) AS BIGINT) || {more} AS value,
         'https://example.com/orders/' || o_orderkey AS url, o_orderkey AS ord
  FROM orders WHERE o_orderkey % 10 <> {gone}"""
BOARDS = f"""
a AS ({_BOARD.format(more="''", gone=3)} AND o_orderpriority <> '1-URGENT'),
b AS ({_BOARD.format(more="CASE WHEN o_orderkey % 13 = 0 THEN ' revised' ELSE '' END", gone=7)})"""
CHANGES = """
c AS (
  SELECT coalesce(a.source_id, b.source_id) AS source_id,
         CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.value <> b.value THEN 'changed' END AS kind,
         coalesce(b.section, a.section) || ' :: ' || coalesce(b.key, a.key) AS identity, coalesce(b.key, a.key) AS key,
         CASE WHEN a.key IS NULL THEN 'New row: ' || b.value WHEN b.key IS NULL THEN 'Row disappeared. It previously read: ' || a.value
              ELSE 'Was: ' || a.value || chr(10) || 'Now: ' || b.value END AS detail, coalesce(b.url, a.url) AS url
  FROM a FULL JOIN b ON a.source_id = b.source_id AND a.section = b.section AND a.key = b.key)"""


@query(f"""WITH {BOARDS}, {CHANGES}
SELECT source_id, kind, identity, key, detail, url, false AS structural, false AS discovery, false AS rolling, substr(sha1(source_id || '|' || identity), 1, 12) AS change_id
FROM c WHERE kind IS NOT NULL
UNION ALL
SELECT DISTINCT source_id, 'section', 'section :: ' || section, 'new section: ' || section, 'A section that was not in the previous snapshot: "' || section || '".', '',
       true, true, false, substr(sha1(source_id || '|section :: ' || section), 1, 12)
FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.source_id = b.source_id AND a.section = b.section)""")
def diff_changes(spark, sf_dir):
    return SN.diff(*both_boards(spark, sf_dir))


@query(f"""WITH {BOARDS} SELECT DISTINCT source_id, 'new section: ' || section AS key FROM b
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.source_id = b.source_id AND a.section = b.section)""")
def diff_sections(spark, sf_dir):
    old, new = both_boards(spark, sf_dir)
    return SN.section_changes(old.select("source_id", "section").distinct(), new.select("source_id", "section").distinct()).select("source_id", "key")


_COLLAPSE = """
k AS (SELECT * FROM c WHERE kind IS NOT NULL),
t AS (SELECT {group}, count(*) AS total FROM k GROUP BY {group}),
o AS (SELECT t.*, {over} AS over FROM t {sizes}),
r AS (SELECT k.*, o.total, row_number() OVER (PARTITION BY {kgroup} ORDER BY identity) AS n FROM k JOIN o USING ({group}) WHERE over)
SELECT {group}, kind, key, false AS structural, 0::BIGINT AS total, '' AS samples FROM k JOIN o USING ({group}) WHERE NOT over
UNION ALL
SELECT {group}, 'changed', {name} || ': ' || any_value(total) || ' rows changed at once', true, any_value(total), array_to_string(list(key ORDER BY n) FILTER (n <= 10), '; ')
FROM r GROUP BY {group}"""


@query(f"WITH {BOARDS}, {CHANGES}," + _COLLAPSE.format(group="source_id", kgroup="source_id", name="source_id", over="total >= 25 AND total > 0.25 * greatest(coalesce(na, 0), coalesce(nb, 0), 1)", sizes="LEFT JOIN (SELECT source_id, count(*) AS na FROM a GROUP BY 1) USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS nb FROM b GROUP BY 1) USING (source_id)"))
def collapse_proportional(spark, sf_dir):
    old, new = both_boards(spark, sf_dir)
    sizes = old.groupBy("source_id").agg(F.count(F.lit(1)).alias("old_rows")).join(new.groupBy("source_id").agg(F.count(F.lit(1)).alias("new_rows")), "source_id", "full_outer")
    out = SN.collapsed(SN.row_changes(old, new), ["source_id"], 25, sizes)
    return out.withColumns({"samples": F.coalesce(F.array_join("samples", "; "), F.lit("")), "total": F.coalesce("total", F.lit(0))})


@query(f"WITH {BOARDS}, {CHANGES.replace('AS detail, coalesce', 'AS detail, coalesce(b.section, a.section) AS section, coalesce')}," + _COLLAPSE.format(group="source_id, section", kgroup="source_id, section", name="source_id || '/' || section", over="total > 25", sizes=""))
def collapse_flat(spark, sf_dir):
    changes = SN.row_changes(*both_boards(spark, sf_dir)).withColumn("section", F.element_at(F.split("identity", " :: "), 1))
    out = SN.collapsed(changes, ["source_id", "section"], 25)
    return out.withColumns({"samples": F.coalesce(F.array_join("samples", "; "), F.lit("")), "total": F.coalesce("total", F.lit(0))})


@query(f"""WITH {BOARDS}, u AS (SELECT DISTINCT source_id, section FROM b WHERE length(source_id) = 7 AND section LIKE '3%')
SELECT source_id, section, key, value FROM b ANTI JOIN u USING (source_id, section) UNION ALL SELECT source_id, section, key, value FROM a SEMI JOIN u USING (source_id, section)""")
def carry_forward_unreadable(spark, sf_dir):
    old, new = both_boards(spark, sf_dir)
    unreadable = new.where("length(source_id) = 7 AND section LIKE '3%'").select("source_id", "section").distinct()
    return SN.carried_forward(old, new, unreadable, ["source_id", "section"]).select("source_id", "section", "key", "value")


@query(f"""WITH {BOARDS}, ok AS (SELECT DISTINCT source_id FROM b WHERE cast(substr(source_id, 7) AS INT) % 3 <> 0)
SELECT source_id, section, key, value FROM b SEMI JOIN ok USING (source_id) UNION ALL SELECT source_id, section, key, value FROM a ANTI JOIN ok USING (source_id)""")
def commit_snapshots(spark, sf_dir):
    old, new = both_boards(spark, sf_dir)
    metrics = new.select("source_id").distinct().withColumn("ok", F.substring("source_id", 7, 9).cast("int") % 3 != 0)
    return SN.committed(old, new, metrics).select("source_id", "section", "key", "value")


@query(f"""WITH {BOARDS}, s AS (SELECT DISTINCT source_id FROM b WHERE length(source_id) = 7)
SELECT source_id, key, value FROM a ANTI JOIN s USING (source_id) UNION ALL SELECT source_id, key, value FROM b SEMI JOIN s USING (source_id)""")
def overlay_snapshots(spark, sf_dir):
    old, new = both_boards(spark, sf_dir)
    return SN.overlaid(old, new.where("length(source_id) = 7")).select("source_id", "key", "value")


@query(f"""WITH {BOARDS}, m AS (SELECT source_id, key, ord, regexp_matches(value, '^F ') AS gone FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, gone ORDER BY ord) AS n FROM m)
SELECT source_id, 'filled' AS filter_id, count(*) AS considered, count(*) FILTER (gone) AS removed, 'already filled' AS reason,
       coalesce(array_to_string(list(key ORDER BY n) FILTER (gone AND n <= 5), ';'), '') AS samples FROM r GROUP BY source_id""")
def filter_reports(spark, sf_dir):
    new = both_boards(spark, sf_dir)[1]
    return RP.filter_report(new, F.col("value").rlike("^F "), "filled", "already filled", new).withColumn("samples", F.array_join("samples", ";"))


@query(f"""WITH {BOARDS}, m AS (SELECT source_id, unnest([struct_pack(f := 'filled', g := regexp_matches(value, '^F ')), struct_pack(f := 'revised', g := value LIKE '%revised'), struct_pack(f := 'late', g := section = '1-URGENT' AND source_id IN ('board-1', 'board-2'))]) AS x FROM b),
r AS (SELECT source_id, x.f AS filter_id, count(*) AS considered, count(*) FILTER (x.g) AS removed FROM m GROUP BY ALL)
SELECT filter_id, sum(removed)::BIGINT AS removed, sum(considered)::BIGINT AS considered, count(DISTINCT source_id) AS n_sources,
       CASE WHEN count(DISTINCT source_id) <= 6 THEN string_agg(source_id, ', ' ORDER BY source_id) ELSE count(DISTINCT source_id) || ' sources' END AS sources
FROM r WHERE removed > 0 GROUP BY filter_id""")
def health_rollup(spark, sf_dir):
    new = both_boards(spark, sf_dir)[1]
    tests = {"filled": F.col("value").rlike("^F "), "revised": F.endswith("value", F.lit("revised")), "late": (F.col("section") == "1-URGENT") & F.col("source_id").isin("board-1", "board-2")}
    reports = None
    for name, test in tests.items():
        one = RP.filter_report(new, test, name, name)
        reports = one if reports is None else reports.unionByName(one)
    return RP.rollup(reports)


@query(f"""WITH {BOARDS}, {CHANGES} SELECT source_id, count(kind) AS change_count FROM (SELECT DISTINCT source_id FROM b) LEFT JOIN c USING (source_id) GROUP BY source_id""")
def change_metrics(spark, sf_dir):
    old, new = both_boards(spark, sf_dir)
    return HL.metrics(new, SN.row_changes(old, new))


@query(f"""WITH {BOARDS}, {CHANGES},
p AS (SELECT source_id, substr(sha1(source_id || '|' || section || ' :: ' || key), 1, 12) AS change_id FROM a),
n AS (SELECT source_id, substr(sha1(source_id || '|' || section || ' :: ' || key), 1, 12) AS change_id FROM b),
k AS (SELECT DISTINCT source_id FROM b WHERE cast(substr(source_id, 7) AS INT) % 4 <> 0)
SELECT DISTINCT source_id, change_id FROM n SEMI JOIN k USING (source_id) UNION SELECT DISTINCT source_id, change_id FROM p ANTI JOIN k USING (source_id)""")
def live_ids(spark, sf_dir):
    old, new = (x.withColumn("change_id", keys.change_id(F.col("source_id"), keys.identity(F.col("section"), F.col("key")))) for x in both_boards(spark, sf_dir))
    checked = new.where(F.substring("source_id", 7, 9).cast("int") % 4 != 0).select("source_id").distinct()
    return PN.live_ids(old, new, checked)


_PINS = """
p AS (SELECT substr(sha1(source_id || '|' || section || ' :: ' || key), 1, 12) AS change_id, source_id, section AS company, key AS position,
             CASE ord % 5 WHEN 0 THEN 'rolling' WHEN 1 THEN '2024-01-19' WHEN 2 THEN '2024-02-30' ELSE '2024-03-01' END AS deadline, '2024-01-01' AS first_pinned, '2024-01-10' AS last_seen FROM a WHERE ord % 3 = 0),
f AS (SELECT substr(sha1(source_id || '|' || section || ' :: ' || key), 1, 12) AS change_id, source_id, section AS company, key AS position, '2024-03-05' AS deadline FROM b),
k AS (SELECT DISTINCT source_id FROM b WHERE cast(substr(source_id, 7) AS INT) % 4 <> 0),
l AS (SELECT source_id, substr(sha1(source_id || '|' || section || ' :: ' || key), 1, 12) AS change_id FROM b SEMI JOIN k USING (source_id)
      UNION SELECT source_id, substr(sha1(source_id || '|' || section || ' :: ' || key), 1, 12) FROM a ANTI JOIN k USING (source_id))"""


@query(f"""WITH {BOARDS}, {_PINS},
o AS (SELECT p.*, l.change_id IS NOT NULL AS lives, k.source_id IS NOT NULL AS was FROM p LEFT JOIN l USING (source_id, change_id) LEFT JOIN k USING (source_id)),
e AS (SELECT change_id, source_id, company, position, deadline, first_pinned, CASE WHEN lives THEN '{AS_OF}' ELSE last_seen END AS last_seen, 0 AS age FROM o
      WHERE NOT (was AND NOT lives) AND NOT coalesce(try_cast(deadline AS DATE) < DATE '{AS_OF}', false)
      UNION ALL SELECT change_id, source_id, company, position, deadline, '{AS_OF}', '{AS_OF}', 1 FROM f)
SELECT change_id, arg_max(source_id, age) AS source_id, arg_max(company, age) AS company, arg_max(position, age) AS position, arg_max(deadline, age) AS deadline,
       min(first_pinned) AS first_pinned, max(last_seen) AS last_seen FROM e GROUP BY change_id""")
def pins_refresh(spark, sf_dir):
    old, new = (x.withColumn("change_id", keys.change_id(F.col("source_id"), keys.identity(F.col("section"), F.col("key")))) for x in both_boards(spark, sf_dir))
    checked = new.where(F.substring("source_id", 7, 9).cast("int") % 4 != 0).select("source_id").distinct()
    k = F.col("ord") % 5
    deadline = F.when(k == 0, "rolling").when(k == 1, "2024-01-19").when(k == 2, "2024-02-30").otherwise("2024-03-01")
    named = lambda x, d: x.select("change_id", "source_id", F.col("section").alias("company"), F.col("key").alias("position"), d.alias("deadline"))
    pins = named(old.where("ord % 3 = 0"), deadline).withColumns({"first_pinned": F.lit("2024-01-01"), "last_seen": F.lit("2024-01-10")})
    fresh = named(new, F.lit("2024-03-05"))
    return PN.refreshed(pins, fresh, PN.live_ids(old, new, checked), checked, F.lit(AS_OF).cast("date"))


# ---------------------------------------------------------------- attempts from events


def attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("attempt_id"), F.concat(F.lit("src-"), F.col("user_id").cast("string")).alias("source_id"), "ts", (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "signup").alias("quarantined"))


_ATTEMPTS = """
t AS (SELECT event_id AS attempt_id, 'src-' || user_id AS source_id, ts, event_type <> 'error' AS ok FROM events WHERE event_type <> 'signup'),
g AS (SELECT source_id, max((ts, attempt_id)) FILTER (ok) AS good, max(ts) AS last_attempt FROM t GROUP BY source_id),
r AS (SELECT source_id, count(*) FILTER (NOT ok AND (good IS NULL OR (ts, attempt_id) > good)) AS failures, max(ts) FILTER (ok) AS last_success, max(last_attempt) AS last_attempt FROM t JOIN g USING (source_id) GROUP BY source_id)"""


@query(f"WITH {_ATTEMPTS} SELECT source_id, failures, last_success, last_attempt FROM r")
def source_failure_runs(spark, sf_dir):
    return HL.failure_runs(attempts(spark, sf_dir))


def _failing(spark, sf_dir):
    """Runs in which only purchases succeed, so that long failure runs occur."""
    return HL.failure_runs(attempts(spark, sf_dir).withColumn("ok", F.col("attempt_id") % 7 == 0))


_QUARANTINE = _ATTEMPTS.replace("event_type <> 'error' AS ok", "event_id % 7 = 0 AS ok") + """,
q AS (SELECT *, CASE WHEN failures < 3 THEN 0 WHEN failures = 3 THEN 6 WHEN failures = 4 THEN 12 WHEN failures = 5 THEN 24 WHEN failures = 6 THEN 48 ELSE 72 END AS hours FROM r),
z AS (SELECT source_id, failures, last_success, last_attempt, hours, CASE WHEN hours > 0 THEN last_attempt + to_hours(hours) END AS retry_after, last_success IS NULL AS never_succeeded FROM q)"""


@query(f"WITH {_QUARANTINE} SELECT *, coalesce(TIMESTAMP '2024-01-31 12:00:00' < retry_after, false) AS skip FROM z")
def quarantine_state(spark, sf_dir):
    return HL.quarantine(_failing(spark, sf_dir), F.lit("2024-01-31 12:00:00").cast("timestamp"))


@query(f"""WITH {_QUARANTINE}, s AS (SELECT *, coalesce(TIMESTAMP '2024-01-31 12:00:00' < retry_after, false) AS skip FROM z)
SELECT count(*) FILTER (NOT skip) AS checked, count(*) FILTER (NOT skip AND failures = 0) AS healthy, count(*) FILTER (NOT skip AND failures > 0) AS failing,
       count(*) FILTER (skip) AS quarantined, count(*) FILTER (failures >= 3) AS escalated FROM s""")
def source_health(spark, sf_dir):
    return HL.health_counts(quarantine_state(spark, sf_dir))


@query("""WITH s AS (SELECT DISTINCT 'src-' || user_id AS source_id, CASE user_id % 4 WHEN 0 THEN 'feed' WHEN 1 THEN 'page' WHEN 2 THEN 'list' ELSE 'carrier pigeon' END AS method FROM events WHERE user_id % 5 <> 0),
l AS (SELECT 'src-' || user_id AS source_id, arg_max(event_type, (ts, event_id)) AS e FROM events WHERE user_id % 7 <> 0 GROUP BY 1)
SELECT coalesce(s.source_id, l.source_id) AS source_id, CASE WHEN method IS NULL THEN 'not listed' WHEN method = 'carrier pigeon' THEN 'unknown method' WHEN e IS NULL THEN 'not tried'
       WHEN e = 'signup' THEN 'quarantined' WHEN e <> 'error' THEN 'ok' ELSE 'failed' END AS outcome FROM s FULL JOIN l USING (source_id)""")
def source_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    method = F.element_at(F.array(*map(F.lit, ("feed", "page", "list", "carrier pigeon"))), (F.col("user_id") % 4 + 1).cast("int"))
    sources = e.where("user_id % 5 <> 0").select(F.concat(F.lit("src-"), F.col("user_id").cast("string")).alias("source_id"), method.alias("method")).distinct()
    last = attempts(spark, sf_dir).where(F.substring("source_id", 5, 9).cast("long") % 7 != 0).groupBy("source_id").agg(F.max_by(F.struct("ok", "quarantined"), F.struct("ts", "attempt_id")).alias("x")).select("source_id", "x.*")
    return HL.outcomes(sources, last, ["feed", "page", "list"])


@query("""WITH s AS (SELECT 'src-' || user_id AS source_id, count(*) % 6 AS failures, CASE WHEN user_id % 2 = 0 THEN min(ts) END AS last_success, min(ts) AS last_attempt FROM events GROUP BY user_id),
l AS (SELECT 'src-' || user_id AS source_id, arg_max(event_type, (ts, event_id)) AS e, max(ts) AS tried FROM events WHERE user_id % 7 <> 0 GROUP BY 1)
SELECT source_id, CASE WHEN e IS NULL OR e = 'signup' THEN failures WHEN e <> 'error' THEN 0 ELSE failures + 1 END AS failures,
       CASE WHEN e IS NOT NULL AND e NOT IN ('signup', 'error') THEN tried ELSE last_success END AS last_success, CASE WHEN e IS NULL OR e = 'signup' THEN last_attempt ELSE tried END AS last_attempt
FROM s LEFT JOIN l USING (source_id)""")
def next_source_state(spark, sf_dir):
    a = attempts(spark, sf_dir)
    uid = F.substring("source_id", 5, 9).cast("long")
    states = a.groupBy("source_id").agg((F.count(F.lit(1)) % 6).alias("failures"), F.min("ts").alias("last_attempt")).withColumn("last_success", F.when(uid % 2 == 0, F.col("last_attempt")))
    last = a.where(uid % 7 != 0).groupBy("source_id").agg(F.max_by(F.struct("ok", "quarantined", "ts"), F.struct("ts", "attempt_id")).alias("x")).select("source_id", "x.*")
    return HL.next_state(states, last)


@query("""WITH b AS (SELECT 'src-' || (user_id % 12) AS source_id, user_id, CASE WHEN arg_max(event_type, (ts, event_id)) IN ('error', 'view', 'click') THEN 'unreadable' ELSE '' END AS error FROM events GROUP BY user_id)
SELECT source_id, count(*) AS boards, count(*) FILTER (error <> '') AS unreadable, count(*) FILTER (error <> '') / count(*) AS share, count(*) FILTER (error <> '') > count(*) * 0.5 AS failed FROM b GROUP BY source_id""")
def board_health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    boards_ = e.groupBy("user_id").agg(last.alias("e")).select(F.concat(F.lit("src-"), (F.col("user_id") % 12).cast("string")).alias("source_id"), F.when(F.col("e").isin("error", "view", "click"), "unreadable").otherwise("").alias("error"))
    return HL.board_health(boards_)


# ---------------------------------------------------------------- pages

_STRIP = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in ("script", "style", "noscript", "svg", "iframe", "template"))
_MASKS = [
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"(?i)\b[0-9a-f]{16,}\b", "<hex>"),
    (r"[?&](v|ver|t|ts|cb|nocache|_)=[^\s&\"''<>]+", ""),
    (r"\b\d{4}-\d{2}-\d{2}T[\d:.+Z-]+", "<timestamp>"),
    (r"(?i)\bcsrf[-_]?token\S*", "<csrf>"),
]


def _sql_lines(html: str = "html") -> str:
    x = f"regexp_replace({html}, '(?is){_STRIP}', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)</(p|div|li|tr|h[1-6]|section|article|header|footer|nav)\s*>|<br\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"
    for pattern, sign in _MASKS:
        x = f"regexp_replace({x}, '{pattern}', '{sign}', 'g')"
    return rf"list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '[\s\x{{A0}}]+', ' ', 'g'))), lambda l: l <> '')"


LINES = f"l AS (SELECT page_id, {_sql_lines()} AS lines FROM pages)"


@query(f"WITH {LINES} SELECT page_id, (generate_subscripts(lines, 1) - 1)::INT AS pos, unnest(lines) AS line FROM l")
def page_lines(spark, sf_dir):
    return P.lines_of(table(spark, sf_dir, "pages"))


_NOISY = "regexp_replace(regexp_replace(html, '<p>', '<p>session 0123456789abcdef0123 at 2024-01-02T03:04:05Z ', 'g'), '</p>', ' csrf_token=xyz</p>', 'g')"


@query(f"WITH l AS (SELECT page_id, {_sql_lines(_NOISY)} AS lines FROM pages) SELECT page_id, array_to_string(lines, chr(10)) AS masked FROM l")
def page_noise_masked(spark, sf_dir):
    noisy = F.regexp_replace(F.regexp_replace("html", "<p>", "<p>session 0123456789abcdef0123 at 2024-01-02T03:04:05Z "), "</p>", " csrf_token=xyz</p>")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.page_lines(noisy), "\n").alias("masked"))


_CUT = "CASE WHEN page_id % 11 = 0 THEN substr(html, 1, cast(floor(length(html) * 0.3) AS BIGINT)) WHEN page_id % 13 = 0 THEN '<html><p>Sorry</p></html>' ELSE html END"


@query(f"""WITH o AS (SELECT page_id, length(array_to_string({_sql_lines()}, chr(10))) AS old_chars FROM pages),
n AS (SELECT page_id, array_to_string({_sql_lines(_CUT)}, chr(10)) AS text, length({_CUT}) AS html_chars, page_id % 17 = 0 AS gone FROM pages)
SELECT page_id, CASE WHEN gone THEN 'redirected to an error page' WHEN length(text) < 500 THEN length(text) || ' characters of text: ' || substr(text, 1, 160)
       WHEN length(text) < html_chars * 0.0015 THEN 'almost no text in its markup' WHEN length(text) < old_chars * 0.4 THEN 'lost most of its text' ELSE '' END AS error
FROM n JOIN o USING (page_id)""")
def page_floors(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    cut = F.when(F.col("page_id") % 11 == 0, F.substring("html", F.lit(1), F.floor(F.length("html") * 0.3).cast("int"))).when(F.col("page_id") % 13 == 0, "<html><p>Sorry</p></html>").otherwise(F.col("html"))
    joined = lambda html: F.array_join(text.page_lines(html), "\n")
    cleaned = pages.select("page_id", "html", cut.alias("cut"), joined(F.col("html")).alias("old"))
    both = cleaned.select(
        "page_id",
        F.when(F.col("cut") == F.col("html"), F.col("old")).otherwise(joined(F.col("cut"))).alias("text"),
        F.length("cut").alias("html_chars"),
        F.lit(False).alias("rendered"),
        F.length("old").alias("old_chars"),
        F.lit(False).alias("exempt"),
        F.lit("https://example.com/jobs").alias("requested"),
        F.when(F.col("page_id") % 17 == 0, "https://example.com/404").otherwise("https://example.com/jobs/").alias("final"),
    )
    return P.floors(both).select("page_id", "error")


def _versions(spark, sf_dir):
    from tidewatch.session import stored, work_folder

    # both versions follow from the cleaned pages, which are made once
    lines = stored(table(spark, sf_dir, "pages").select("page_id", text.page_lines(F.col("html")).alias("lines")), work_folder(spark, "lines"))
    rest = F.when(F.col("page_id") % 5 == 0, F.filter("lines", lambda x: x != F.get("lines", F.lit(1)))).otherwise(F.col("lines"))
    return lines, lines.select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.array(F.lit("Insight programme now open")), rest)).otherwise(rest).alias("lines"))


_NEW_LINES = "n AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN list_concat(['Insight programme now open'], r) ELSE r END AS lines FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN list_filter(lines, lambda x: x <> lines[2]) ELSE lines END AS r FROM l))"


@query(f"""WITH {LINES}, {_NEW_LINES}, a AS (SELECT page_id, unnest(lines) AS line FROM l), b AS (SELECT page_id, unnest(lines) AS line FROM n)
SELECT page_id, 'added' AS kind, line FROM (FROM b EXCEPT ALL FROM a) UNION ALL SELECT page_id, 'removed', line FROM (FROM a EXCEPT ALL FROM b)""")
def page_diff_multiset(spark, sf_dir):
    old, new = (x.select("page_id", F.explode("lines").alias("line")) for x in _versions(spark, sf_dir))
    return P.multiset_diff(old, new)


@query(f"""WITH {LINES}, {_NEW_LINES}, d AS (SELECT page_id, l.lines AS a, n.lines AS b FROM l JOIN n USING (page_id) WHERE l.lines <> n.lines),
e AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS added, CASE WHEN page_id % 5 = 0 THEN len(list_filter(a, lambda x: x = a[2])) ELSE 0 END AS removed FROM d)
SELECT page_id, 'page changed: ' || added || ' added, ' || removed || ' removed' AS key, added > 0 AS discovery FROM e""")
def page_diff_ordered(spark, sf_dir):
    return P.changes(*_versions(spark, sf_dir)).select("page_id", "key", "discovery")


_FINAL = """CASE WHEN page_id % 4 = 0 THEN regexp_replace(url, '://(www\\.|m\\.|blog\\.)', '://') WHEN page_id % 9 = 0 THEN regexp_replace(url, '(://[^/]+)/.*$', '\\1/404')
  WHEN page_id % 6 = 0 THEN regexp_replace(url, '(://[^/?#]+/[^?#]*?)/?([?#].*)?$', '\\1/more') ELSE regexp_replace(url, '[?#].*$', '') || '/' END"""


@query(f"""WITH f AS (SELECT page_id, url, {_FINAL} AS final FROM pages),
p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS h1, regexp_replace(lower(regexp_extract(final, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS h2,
             regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p1, regexp_replace(regexp_extract(final, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p2 FROM f)
SELECT page_id, CASE WHEN p1 = p2 AND h1 = h2 THEN '' WHEN regexp_matches(p2, '(?i)/(404|410|error|not.?found|page.?not.?found|gone)(/|$|\\.)') THEN 'fail' WHEN p1 <> p2 THEN 'warn' ELSE '' END AS verdict FROM p""")
def url_redirect_verdict(spark, sf_dir):
    u, k = F.col("url"), F.col("page_id")
    final = (
        F.when(k % 4 == 0, F.regexp_replace(u, r"://(www\.|m\.|blog\.)", "://"))
        .when(k % 9 == 0, F.regexp_replace(u, r"(://[^/]+)/.*$", "$1/404"))
        .when(k % 6 == 0, F.regexp_replace(u, r"(://[^/?#]+/[^?#]*?)/?([?#].*)?$", "$1/more"))
        .otherwise(F.concat(F.regexp_replace(u, r"[?#].*$", ""), F.lit("/")))
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.redirect_verdict(u, final).alias("verdict"))


@query(r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^(?i)https?://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '')) AS canonical FROM pages")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(regexp_extract(url, '(https?://[^\s)\]<>]+)', 1), '[.,;:)\]}"'']+$', '') AS url FROM pages),
p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS h, regexp_extract(regexp_extract(url, '^https?://[^/]+(/.*)$', 1), '([^/]+)/*$', 1) AS last FROM u)
SELECT page_id, CASE WHEN regexp_matches(last, '^\d{2,}$') THEN h || ':' || last ELSE '' END AS ids FROM p""")
def posting_identities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.posting_identities(F.col("url"), digits=2), ",").alias("ids"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS n FROM pages),
r AS (SELECT page_id, n, regexp_replace(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(link, '&amp;', '&'), '#.*$', '') AS target, regexp_replace(url, '#.*$', '') AS base FROM l WHERE link LIKE '/%' AND link NOT LIKE '//%'),
d AS (SELECT page_id, target, min(n) AS n FROM r WHERE regexp_replace(target, '/+$', '') <> regexp_replace(base, '/+$', '') GROUP BY ALL)
SELECT page_id, coalesce(array_to_string(list(target ORDER BY n)[1:3], ' '), '') AS links FROM (SELECT page_id FROM pages) LEFT JOIN d USING (page_id) GROUP BY page_id""")
def page_links_same_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.links_out(F.col("html"), F.col("url"), 'href="([^"]*)"'), " ").alias("links"))


@query(r"""WITH c AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^(?i)https?://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '')) AS u FROM pages),
t AS (SELECT page_id AS target_id, CASE WHEN page_id % 10 = 0 THEN 'page-' || (page_id + 1) WHEN page_id % 10 = 5 THEN 'nowhere' ELSE '' END AS source_id, u FROM c),
w AS (SELECT 'page-' || page_id AS source_id, page_id AS ord, CASE WHEN page_id % 2 = 0 THEN u ELSE regexp_replace(u, '/[^/]*$', '') END AS path FROM c WHERE page_id % 3 <> 0),
e AS (SELECT target_id, t.source_id, CASE WHEN w.source_id IS NULL THEN 'dangling' ELSE 'explicit' END AS how FROM t LEFT JOIN w USING (source_id) WHERE t.source_id <> ''),
m AS (SELECT target_id, w.source_id, CASE WHEN w.path = t.u THEN 'same page' ELSE 'parent page' END AS how, row_number() OVER (PARTITION BY target_id ORDER BY length(w.path) DESC, ord) AS n
      FROM t JOIN w ON (w.path = t.u OR starts_with(t.u, w.path || '/')) AND w.path LIKE '%/%' WHERE t.source_id = '')
SELECT * FROM e UNION ALL SELECT target_id, source_id, how FROM m WHERE n = 1""")
def prefix_coverage(spark, sf_dir):
    return PG.covering(*_targets(spark, sf_dir))


def _targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 10
    targets = pages.select(F.col("page_id").alias("target_id"), "url", F.when(k == 0, F.concat(F.lit("page-"), (F.col("page_id") + 1).cast("string"))).when(k == 5, "nowhere").otherwise("").alias("source_id"))
    up = F.regexp_replace(urls.canonical(F.col("url")), "/[^/]*$", "")
    watched = pages.where("page_id % 3 <> 0").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source_id"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(up).alias("url"), F.col("page_id").alias("ord"))
    return targets, watched


@query(ORACLE_SQL["prefix_coverage"].replace("SELECT * FROM e UNION ALL SELECT target_id, source_id, how FROM m WHERE n = 1", """, z AS (SELECT * FROM e UNION ALL SELECT target_id, source_id, how FROM m WHERE n = 1)
SELECT CASE WHEN how IS NULL THEN 'hand check' WHEN how = 'dangling' THEN 'kept with warning' ELSE 'covered' END AS outcome, count(*) AS n FROM t LEFT JOIN z USING (target_id) GROUP BY 1"""))
def partition_reasons(spark, sf_dir):
    targets, watched = _targets(spark, sf_dir)
    return PG.reasons(PG.partitioned(targets.select("target_id", "url"), PG.covering(targets, watched)))


# ---------------------------------------------------------------- documents as postings

_IDS = "i AS (SELECT doc_id, source, text, list_distinct(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 100), lambda x: md5(x))) AS ids FROM documents)"
_ROOTS = """
e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT doc_id, unnest(ids) AS id FROM i) a JOIN (SELECT doc_id, unnest(ids) AS id FROM i) b USING (id) WHERE a.doc_id <> b.doc_id{more}),
reach AS (SELECT doc_id AS d, doc_id AS r FROM i UNION SELECT d, b FROM reach JOIN e ON r = a),
g AS (SELECT d AS doc_id, min(r) AS component FROM reach GROUP BY d)"""


def postings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: F.length(x) >= 100)
    ids = F.array_distinct(F.transform(lines, lambda x: F.md5(x.cast("binary"))))
    return d.select(F.col("doc_id").alias("row"), "source", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), F.col("source").isin("src0", "src1").alias("is_aggregator"), "text")


@query(f"WITH RECURSIVE {_IDS}, {_ROOTS.format(more='')} SELECT doc_id, component FROM g")
def dedupe_components(spark, sf_dir):
    return I.posting_groups(postings(spark, sf_dir).select("row", "ids")).select(F.col("row").alias("doc_id"), "component")


@query(f"""WITH RECURSIVE {_IDS}, {_ROOTS.format(more='')}
SELECT component, arg_min(doc_id, (source IN ('src0', 'src1'), doc_id)) AS winner, count(*) AS members, min(doc_id) AS position FROM g JOIN i USING (doc_id) GROUP BY component""")
def dedupe_winners(spark, sf_dir):
    return I.winners(I.posting_groups(postings(spark, sf_dir).select("row", "ids", "is_aggregator")))


_WORDS = r"w AS (SELECT p_partkey AS doc_id, p_brand || '/' || p_size AS source, list_filter(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' the summer programme'), '[a-z0-9]{2,}')), lambda x: x NOT IN ('intern', 'internship', 'internships', 'summer', 'the', 'and', 'for', 'with', '2027', '2026', 'program', 'programme', 'co-op', 'coop')) AS words FROM part)"
_PARTS = "i AS (SELECT p_partkey AS doc_id, p_name AS text, p_partkey % 4 = 0 AS is_reference, p_partkey % 5 < 2 AS is_aggregator, [md5(p_name || cast(p_partkey // 3 AS VARCHAR))] AS ids FROM part)"
_PAIRS = "SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.words, y.words)) AS common FROM w x JOIN w y ON x.source = y.source AND x.doc_id < y.doc_id WHERE len(x.words) > 0 AND len(y.words) > 0 AND len(list_intersect(x.words, y.words)) >= 0.75 * least(len(x.words), len(y.words))"


def titled(spark, sf_dir):
    """Parts as postings, with whole titles; a firm's parts of one size are a block."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", "p_type", F.lit("the summer programme"))
    identity = F.array(F.md5(F.concat("p_name", F.floor(k / 3).cast("string")).cast("binary")))
    return p.select(
        k.alias("row"),
        identity.alias("ids"),
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("block"),
        text.title_words(title).alias("words"),
        (k % 4 == 0).alias("is_reference"),
        (k % 5 < 2).alias("is_aggregator"),
        F.col("p_name").alias("text"),
    )


@query(f"WITH {_WORDS} {_PAIRS}")
def title_overlap_pairs(spark, sf_dir):
    return C.overlap_pairs(titled(spark, sf_dir).select("row", "block", "words"))


@query(f"""WITH RECURSIVE {_PARTS}, {_WORDS}, t AS ({_PAIRS}), {_ROOTS.format(more=' UNION SELECT a, b FROM t UNION SELECT b, a FROM t')},
k AS (SELECT component, bool_or(NOT is_reference) AS ours, bool_or(is_reference) AS theirs, bool_or(NOT is_reference AND is_aggregator) AS listed, bool_or(true) AS s_all, bool_or(text LIKE '%ring%') AS s_ring FROM g JOIN i USING (doc_id) GROUP BY component),
s AS (SELECT *, 'all' AS scope FROM k UNION ALL SELECT *, 'ring' FROM k WHERE s_ring)
SELECT scope, count(*) FILTER (ours) AS ours, count(*) FILTER (theirs) AS theirs, count(*) FILTER (ours AND NOT theirs) AS only_ours, count(*) FILTER (ours AND NOT theirs AND NOT listed) AS only_ours_direct,
       CASE WHEN count(*) FILTER (theirs) > 0 THEN count(*) FILTER (ours AND NOT theirs) / count(*) FILTER (theirs) ELSE 0.0 END AS lead FROM s GROUP BY scope""")
def coverage_scopes(spark, sf_dir):
    return C.coverage(titled(spark, sf_dir), {"all": F.lit(True), "ring": F.col("text").contains("ring")})


@query(f"""WITH RECURSIVE x AS (SELECT doc_id, source, CASE WHEN doc_id % 6 = 0 THEN 'removed' ELSE 'added' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'p1|p2' WHEN 1 THEN 'p1' WHEN 2 THEN '' ELSE 'p3' END AS programs FROM documents),
i AS (SELECT d.doc_id, d.source, list_distinct(list_transform(list_filter(list_transform(string_split(d.text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 100), lambda x: md5(x))) AS ids FROM documents d JOIN x USING (doc_id) WHERE kind <> 'removed'),
{_ROOTS.format(more='')},
v AS (SELECT component, arg_min(doc_id, (source IN ('src0', 'src1'), doc_id)) AS winner FROM g JOIN i USING (doc_id) GROUP BY component),
s2 AS (SELECT g.doc_id, doc_id <> winner AS gone FROM g JOIN v USING (component)),
s3 AS (SELECT x.doc_id, x.source, programs = 'p1' AS gone FROM x JOIN s2 ON x.doc_id = s2.doc_id AND NOT s2.gone),
s4 AS (SELECT doc_id, source, substr(sha1(source || '|' || doc_id || '|2024'), 1, 10) AS mute_key FROM s3 WHERE NOT gone),
q AS (SELECT substr(sha1(source || '|' || doc_id || '|2024'), 1, 10) AS mute_key FROM x WHERE doc_id % 9 = 4),
r AS (SELECT 'removed-row' AS filter_id, count(*) AS considered, count(*) FILTER (kind = 'removed') AS removed FROM x
 UNION ALL SELECT 'duplicate-posting', count(*), count(*) FILTER (gone) FROM s2 UNION ALL SELECT 'muted', count(*), count(*) FILTER (gone) FROM s3 UNION ALL SELECT 'applied', count(*), count(*) FILTER (mute_key IN (SELECT mute_key FROM q)) FROM s4)
SELECT * FROM r""")
def suppress_chain(spark, sf_dir):
    k = F.col("row")
    rows = postings(spark, sf_dir).select("row", F.col("source").alias("source_id"), "ids", "is_aggregator", F.when(k % 6 == 0, "removed").otherwise("added").alias("kind"), k.cast("string").alias("key"), F.when(k % 5 == 0, "p1|p2").when(k % 5 == 1, "p1").when(k % 5 == 2, "").otherwise("p3").alias("program_name"))
    rows = rows.withColumn("mute_key", keys.change_key(F.col("source_id"), F.col("key"), F.lit("2024-03-01").cast("date")))
    muted = spark.range(1).select(F.lit("p1").alias("name"))
    _, reports = I.suppressed(rows, muted, rows.where("row % 9 = 4").select("mute_key"))
    return reports.groupBy("filter_id").agg(F.sum("considered").alias("considered"), F.sum("removed").alias("removed"))


# ---------------------------------------------------------------- windows, screens, ranks


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, 'part ' || (l_partkey % 10) AS key, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_partkey % 10 ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n > 1 THEN key || ' #' || n ELSE key END AS key FROM n""")
def occurrence_ordinals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("section"), F.concat(F.lit("part "), (F.col("l_partkey") % 10).cast("string")).alias("key"))
    return SN.with_ordinals(rows, [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "key")


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '↳' WHEN turn % 7 = 5 THEN '' ELSE trim(role || ' ' || turn) END AS entity FROM conversations),
c AS (SELECT *, last_value(CASE WHEN entity NOT IN ('', '↳') THEN entity END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS above FROM x)
SELECT conv_id, turn, CASE WHEN entity = '↳' THEN coalesce(above, '') ELSE entity END AS entity FROM c""")
def carry_forward_entity(spark, sf_dir):
    entity = F.when(F.col("turn") % 3 == 1, "↳").when(F.col("turn") % 7 == 5, "").otherwise(F.trim(F.concat_ws(" ", "role", F.col("turn").cast("string"))))
    return SN.carried_entity(table(spark, sf_dir, "conversations").select("conv_id", "turn", entity.alias("entity")), ["conv_id"], [F.col("turn")], "entity")


@query(r"""SELECT p_partkey, NOT regexp_matches(p_name, '(?i)steel|brass') AND (regexp_matches(p_name, '(?i)part|green|red') OR regexp_matches(p_type, '(?i)promo')) AS wanted,
 coalesce(trim(p_brand), '') = '' OR regexp_matches(p_brand, '(?i)#1') OR NOT regexp_matches(p_brand, '(?i)#[2-4]') AS at_home FROM part""")
def screen_titles(spark, sf_dir):
    wanted = S.wanted_title(F.col("p_name"), F.col("p_type"), (r"part|green|red",), r"steel|brass", "promo")
    return table(spark, sf_dir, "part").select("p_partkey", wanted.alias("wanted"), S.at_home(F.col("p_brand"), "#1", "#[2-4]").alias("at_home"))


@query(r"""WITH h AS (SELECT doc_id, text, regexp_extract_all(text, '(?i)license', 0) AS hits, string_split_regex(text, '(?i)license') AS gaps FROM documents WHERE regexp_matches(text, '(?i)license')),
p AS (SELECT doc_id, text, unnest(range(1, len(hits) + 1)) AS n, hits, gaps FROM h),
q AS (SELECT doc_id, text, n, hits[n] AS hit, list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:n-1], lambda x: length(x))), 0) AS a FROM p),
v AS (SELECT doc_id, n, hit FROM q WHERE NOT regexp_matches(substr(text, (greatest(a - 50, 0) + 1)::BIGINT, (a + length(hit) + 75 - greatest(a - 50, 0))::BIGINT), '(?i)apache'))
SELECT doc_id, 'license' AS rule, arg_min(hit, n) AS quote FROM v GROUP BY doc_id""")
def screen_text_guarded(spark, sf_dir):
    rules = [("license", "license", ["apache"])]
    return S.verdicts(table(spark, sf_dir, "documents"), "source", "text", title_rules=[], posting_rules=rules).select("doc_id", "rule", "quote")


@query(ORACLE_SQL["screen_text_guarded"].replace("SELECT doc_id, 'license' AS rule, arg_min(hit, n) AS quote FROM v GROUP BY doc_id", "SELECT 'license' AS rule, count(DISTINCT doc_id) AS n FROM v HAVING count(*) > 0"))
def verdicts_by_rule(spark, sf_dir):
    return S.by_rule(screen_text_guarded(spark, sf_dir))


def ranked_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    deadline = F.when(k % 6 == 0, "rolling").when(k % 6 == 1, "").when(k % 6 == 2, "2024-13-01").otherwise(F.date_format(F.date_add(F.lit(AS_OF).cast("date"), (k % 60 - 20).cast("int")), "yyyy-MM-dd"))
    confidence = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (k % 3 + 1).cast("int"))
    rank = R.rank(deadline, F.lit(AS_OF).cast("date"), k % 17 == 0, k % 11 == 0, k % 8 != 0, confidence)
    o = table(spark, sf_dir, "orders").select(k.alias("ord"), "o_orderpriority", "o_orderstatus", rank.alias("r"), (k % 19 != 0).alias("relevant"), (k % 23 == 0).alias("top"), F.when(k % 4 == 0, "small").otherwise("large").alias("employer_size"))
    return o.select("ord", "o_orderpriority", "o_orderstatus", "relevant", "top", "employer_size", "r.tier", "r.reason")


_RANKED = f"""
d AS (SELECT o_orderkey AS k, o_orderpriority, o_orderstatus, CASE o_orderkey % 6 WHEN 0 THEN 'rolling' WHEN 1 THEN '' WHEN 2 THEN '2024-13-01' ELSE cast(DATE '{AS_OF}' + cast(o_orderkey % 60 - 20 AS INT) AS VARCHAR) END AS deadline FROM orders),
x AS (SELECT *, try_cast(deadline AS DATE) - DATE '{AS_OF}' AS days, ['low', 'medium', 'high'][(k % 3 + 1)::INT] AS confidence FROM d),
y AS (SELECT *, 'closes ' || strftime(try_cast(deadline AS DATE), '%b %-d') AS closes FROM x),
ranked AS (SELECT k AS ord, o_orderpriority, o_orderstatus, k % 19 <> 0 AS relevant, k % 23 = 0 AS top, CASE WHEN k % 4 = 0 THEN 'small' ELSE 'large' END AS employer_size,
  CASE WHEN days BETWEEN 0 AND 21 OR k % 17 = 0 OR (k % 11 = 0 AND k % 8 <> 0 AND confidence <> 'low') THEN 'High' ELSE 'Medium' END AS tier,
  CASE WHEN days BETWEEN 0 AND 21 THEN closes || ' (' || CASE days WHEN 0 THEN 'today' WHEN 1 THEN '1 day' ELSE days || ' days' END || ')' WHEN k % 17 = 0 THEN 'rolling firm, fills early'
       WHEN k % 11 = 0 AND k % 8 <> 0 AND confidence <> 'low' THEN 'discovery programme' WHEN k % 8 = 0 THEN 'unverified' WHEN deadline = 'rolling' THEN 'rolling, no close date'
       WHEN days > 21 THEN closes WHEN days IS NOT NULL THEN 'deadline passed' ELSE 'no deadline stated' END AS reason FROM y)"""


@query(f"WITH {_RANKED} SELECT * FROM ranked")
def priority_rank(spark, sf_dir):
    return ranked_orders(spark, sf_dir)


_ORDER = """CASE WHEN NOT relevant THEN 3 WHEN top THEN 0 WHEN tier = 'High' THEN 1 ELSE 2 END,
  CASE WHEN tier = 'High' OR reason LIKE 'rolling%' THEN 0 WHEN reason LIKE 'closes%' THEN 1 WHEN reason = 'no deadline stated' THEN 2 WHEN reason = 'unverified' THEN 3 ELSE 4 END, employer_size <> 'small', ord"""


@query(f"WITH {_RANKED}, n AS (SELECT ord, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_ORDER}) <= 250 AS judged FROM ranked) SELECT * FROM n")
def budget_overflow(spark, sf_dir):
    rows = ranked_orders(spark, sf_dir)
    return R.within_budget(rows, R.digest_order(rows), group=["o_orderpriority"]).select("ord", "o_orderpriority", "judged")


@query(f"WITH {_RANKED}, n AS (SELECT o_orderpriority, tier, reason, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_ORDER}) AS n FROM ranked) SELECT * FROM n WHERE n <= 10")
def digest_top(spark, sf_dir):
    from pyspark.sql import Window

    rows = ranked_orders(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(*R.digest_order(rows)))
    return rows.withColumn("n", n.cast("long")).where("n <= 10").select("o_orderpriority", "tier", "reason", "n")


@query("""WITH u AS (SELECT source, doc_id, n_chars, sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id) AS used, sum(n_chars + 1) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT source, used + 1000 <= CASE WHEN total + 1000 <= 65536 THEN 65536 ELSE 65536 - length(n || ' more rows did not fit.') - 1 END AS shown FROM u)
SELECT source, count(*) FILTER (shown) AS shown, count(*) FILTER (NOT shown) AS withheld FROM s GROUP BY source""")
def fit_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return R.withheld(R.fitted(docs, ["doc_id"], "n_chars", ["source"], 600, 400), ["source"])


# ---------------------------------------------------------------- judgments


@query("""WITH c AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-large' WHEN 2 THEN 'm-free' ELSE 'm-other' END AS model, CASE WHEN l_orderkey % 9 <> 0 THEN l_partkey END AS tokens_in, l_suppkey AS cached, l_orderkey % 1000 AS tokens_out FROM lineitem),
p AS (SELECT * FROM (VALUES ('m-small', 0.25, 2.0), ('m-large', 1.25, 10.0), ('m-free', 0.0, 0.0)) t(model, rate_in, rate_out)),
s AS (SELECT model, count(*) AS calls, count(*) FILTER (tokens_in IS NULL) AS unreported, sum(tokens_in)::BIGINT AS tokens_in, sum(cached)::BIGINT AS cached, sum(tokens_out)::BIGINT AS tokens_out FROM c GROUP BY model)
SELECT model, calls, unreported, tokens_in, cached, tokens_out, round(((tokens_in - cached + cached * 0.1::DOUBLE) * rate_in::DOUBLE + tokens_out * rate_out::DOUBLE) / 1e6, 4) AS cost FROM s LEFT JOIN p USING (model)""")
def usage_cost(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    calls = table(spark, sf_dir, "lineitem").select(F.when(k == 0, "m-small").when(k == 1, "m-large").when(k == 2, "m-free").otherwise("m-other").alias("model"), F.when(F.col("l_orderkey") % 9 != 0, F.col("l_partkey")).alias("tokens_in"), F.col("l_suppkey").alias("cached"), (F.col("l_orderkey") % 1000).alias("tokens_out"))
    prices = spark.createDataFrame([("m-small", 0.25, 2.0), ("m-large", 1.25, 10.0), ("m-free", 0.0, 0.0)], "model string, rate_in double, rate_out double")
    return J.usage(calls, prices).select("model", "calls", "unreported", "tokens_in", "cached", "tokens_out", F.round("cost", 4).alias("cost"))


@query("""WITH b AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'not json' WHEN 'click' THEN NULL WHEN 'view' THEN '{}' WHEN 'signup' THEN '{"relevant": false, "confidence": "High", "employer_size": "Small", "deadline": "not stated"}' ELSE '{"why": "fits", "employer_size": "huge", "deadline": "2024-02-01"}' END AS t, event_type AS e FROM events)
SELECT event_id, CASE WHEN e IN ('error', 'click') THEN 'error' ELSE 'model' END AS outcome, e <> 'signup' AS relevant, CASE WHEN e = 'signup' THEN 'high' ELSE 'low' END AS confidence, CASE WHEN e = 'purchase' THEN 'fits' ELSE '' END AS why,
       CASE WHEN e = 'purchase' THEN '2024-02-01' ELSE '' END AS deadline, '' AS class_year, CASE WHEN e = 'signup' THEN 'small' ELSE '' END AS employer_size FROM b""")
def judgment_normalise(spark, sf_dir):
    e = F.col("event_type")
    body = F.when(e == "error", "not json").when(e == "click", F.lit(None)).when(e == "view", "{}").when(e == "signup", '{"relevant": false, "confidence": "High", "employer_size": "Small", "deadline": "not stated"}').otherwise('{"why": "fits", "employer_size": "huge", "deadline": "2024-02-01"}')
    return J.parsed(table(spark, sf_dir, "events").select("event_id", body.alias("body"))).drop("body")


@query("""WITH c AS (SELECT event_id AS change_id, CASE WHEN event_id % 4 = 0 THEN 'text ' || event_id ELSE '' END AS posting_text, 'u' || (user_id % 50) AS url FROM events),
f AS (SELECT DISTINCT 'u' || (user_id % 50) AS url, CASE WHEN user_id % 50 % 3 = 0 THEN NULL ELSE 'body ' || (user_id % 50) END AS text, CASE WHEN user_id % 50 % 3 = 0 THEN 'HTTP 500' END AS error FROM events WHERE user_id % 50 % 5 <> 0)
SELECT change_id, CASE WHEN posting_text <> '' THEN posting_text ELSE text END AS text, CASE WHEN posting_text = '' THEN error END AS error, url, CASE WHEN posting_text <> '' THEN 'inline' WHEN text IS NOT NULL OR error IS NOT NULL THEN 'fetched' ELSE 'absent' END AS origin
FROM c LEFT JOIN f USING (url)""")
def posting_bodies(spark, sf_dir):
    e, u = table(spark, sf_dir, "events"), F.col("user_id") % 50
    changes = e.select(F.col("event_id").alias("change_id"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("text "), F.col("event_id").cast("string"))).otherwise("").alias("posting_text"), F.concat(F.lit("u"), u.cast("string")).alias("url"))
    fetched = e.where(u % 5 != 0).select(F.concat(F.lit("u"), u.cast("string")).alias("url"), F.when(u % 3 != 0, F.concat(F.lit("body "), u.cast("string"))).alias("text"), F.when(u % 3 == 0, "HTTP 500").alias("error")).distinct()
    return J.bodies(changes, fetched)


@query("""WITH c AS (SELECT o_orderkey AS change_id FROM orders), v AS (SELECT o_orderkey AS change_id, 'r1' AS rule, 'q' || o_orderkey AS quote FROM orders WHERE o_orderkey % 5 = 0),
j AS (SELECT o_orderkey AS change_id, CASE WHEN o_orderkey % 4 = 0 THEN 'error' ELSE 'model' END AS said, o_orderkey % 3 <> 0 AS relevant, 'medium' AS confidence FROM orders WHERE o_orderkey % 2 = 0), o AS (SELECT o_orderkey AS change_id, true AS over FROM orders WHERE o_orderkey % 7 = 0)
SELECT change_id, CASE WHEN rule IS NOT NULL THEN 'screened' WHEN said IS NOT NULL THEN said WHEN over THEN 'over_budget' ELSE 'unclassified' END AS outcome, rule, quote, CASE WHEN rule IS NOT NULL THEN false ELSE coalesce(relevant, true) END AS relevant, coalesce(confidence, 'low') AS confidence
FROM c LEFT JOIN v USING (change_id) LEFT JOIN j USING (change_id) LEFT JOIN o USING (change_id)""")
def judged_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"))
    k = F.col("change_id")
    verdicts = o.where(k % 5 == 0).select("change_id", F.lit("r1").alias("rule"), F.concat(F.lit("q"), k.cast("string")).alias("quote"))
    judgments = o.where(k % 2 == 0).select("change_id", F.when(k % 4 == 0, "error").otherwise("model").alias("outcome"), (k % 3 != 0).alias("relevant"), F.lit("medium").alias("confidence"))
    return J.joined(o, verdicts, judgments, o.where(k % 7 == 0))


@query("""WITH c AS (SELECT DISTINCT 'page' AS kind, source AS key FROM documents), j AS (SELECT source AS key, CASE WHEN source IN ('src1', 'src2') THEN ' Low ' WHEN source = 'src3' THEN 'lowish' END AS priority FROM documents WHERE source <> 'src5' GROUP BY source)
SELECT kind, key, CASE WHEN lower(trim(priority)) = 'low' THEN 'discarded' ELSE 'proposed' END AS status FROM c LEFT JOIN j USING (key) WHERE key NOT IN ('src7', 'src8')""")
def candidate_triage(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.lit("page").alias("kind"), F.col("source").alias("key")).distinct()
    known = c.where("key IN ('src7', 'src8')")
    priority = F.when(F.col("key").isin("src1", "src2"), " Low ").when(F.col("key") == "src3", "lowish")
    return PG.triaged(PG.fresh(c, known), c.where("key <> 'src5'").withColumn("priority", priority)).select("kind", "key", "status")


# ---------------------------------------------------------------- feeds, tables and stored snapshots made of orders


def _jobs(spark, sf_dir):
    o = boards(spark, sf_dir, "new")
    return o.withColumns({"title": F.concat(F.when(F.col("ord") % 3 == 0, F.lit("Summer Intern ")).otherwise(F.lit("Manager ")), F.col("key")), "place": F.when(F.col("ord") % 8 == 0, "London").when(F.col("ord") % 20 == 4, "").otherwise("Austin, TX")})


def _feed_bodies(spark, sf_dir):
    """Board feeds as JSON text, a page for each section of a board."""
    job = F.struct(F.col("title"), F.struct(F.col("place").alias("name")).alias("location"), F.array(F.struct(F.col("section").alias("name"))).alias("departments"), F.col("url").alias("absolute_url"), F.lit("<p>Text &amp; more</p>").alias("content"))
    by = _jobs(spark, sf_dir).groupBy("source_id", "section").agg(F.to_json(F.struct(F.array_sort(F.collect_list(job)).alias("jobs"))).alias("body"))
    return by.withColumn("page_no", F.ascii("section"))


@query(f"""WITH {BOARDS}, j AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 'Summer Intern ' ELSE 'Manager ' END || key AS title, CASE WHEN ord % 8 = 0 THEN 'London' WHEN ord % 20 = 4 THEN '' ELSE 'Austin, TX' END AS place FROM b)
SELECT source_id, section, title || CASE WHEN place <> '' THEN ' @ ' || place ELSE '' END AS key, 'URL=' || url AS value, url FROM j WHERE (ord % 3 = 0 OR regexp_matches(key, '\\b20(2[6-9]|3[0-9])\\b')) AND place <> 'London'""")
def parse_feeds(spark, sf_dir):
    from tidewatch.plans.jobs import board_snapshots

    return board_snapshots(_feed_bodies(spark, sf_dir), "greenhouse")


@query(f"""WITH {BOARDS}, j AS (SELECT source_id, section, count(*) AS n FROM b GROUP BY ALL)
SELECT source_id, section, CASE ascii(section) % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'the feed reports an error' WHEN 2 THEN 'no jobs' WHEN 3 THEN 'not a list' ELSE '' END AS error FROM j""")
def feed_shape(spark, sf_dir):
    from tidewatch.sources import feeds

    k, body = F.ascii("section") % 5, F.col("body")
    broken = F.when(k == 0, F.substring(body, 1, 20)).when(k == 1, F.regexp_replace(body, r"^\{", '{"error": "gone", ')).when(k == 2, F.regexp_replace(body, '^."jobs"', '{"postings"')).when(k == 3, F.lit('{"jobs": "none"}')).otherwise(body)
    return _feed_bodies(spark, sf_dir).select("source_id", "section", feeds.shape_error(broken, "jobs").alias("error"))


@query(f"""WITH {BOARDS}, j AS (SELECT source_id, section, count(*) AS n FROM b GROUP BY ALL), g AS (SELECT source_id, sum(n)::BIGINT AS got, sum(n)::BIGINT + CASE WHEN length(source_id) = 7 THEN 1 ELSE 0 END AS total FROM j GROUP BY source_id)
SELECT source_id, got, total, CASE WHEN got < total THEN 'read ' || got || ' of ' || total ELSE '' END AS error FROM g""")
def feed_paging(spark, sf_dir):
    from tidewatch.sources import feeds

    pages = _feed_bodies(spark, sf_dir).select("source_id", F.size(F.from_json("body", "jobs array<struct<title:string>>")["jobs"]).cast("long").alias("items"))
    totals = pages.groupBy("source_id").agg((F.sum("items") + F.when(F.length("source_id") == 7, 1).otherwise(0)).alias("total"))
    return feeds.paging_error(pages.join(totals, "source_id"))


@query(f"""WITH {BOARDS}, t AS (SELECT *, row_number() OVER (PARTITION BY source_id, section ORDER BY ord) AS n FROM b),
r AS (SELECT source_id, section, CASE WHEN n % 5 = 2 THEN 'Firm ' || ((n - 1) % 7) ELSE 'Firm ' || (n % 7) END AS firm, key AS role, value AS status, url, ord FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id, section, firm, role ORDER BY ord) AS m FROM r)
SELECT source_id, section, firm || ' / ' || role || CASE WHEN m > 1 THEN ' #' || m ELSE '' END AS key, 'Company=' || firm || '; Role=' || role || '; Link=[apply](' || url || ')' AS value, url FROM k WHERE section <> '5-LOW'""")
def parse_markdown_tables(spark, sf_dir):
    from pyspark.sql import Window

    from tidewatch.sources import tables

    n = F.row_number().over(Window.partitionBy("source_id", "section").orderBy("ord"))
    rows = boards(spark, sf_dir, "new").withColumn("n", n)
    firm = F.when(F.col("n") % 5 == 2, "↳").otherwise(F.concat(F.lit("Firm "), (F.col("n") % 7).cast("string")))
    line = F.concat_ws(" | ", F.lit("|").substr(1, 0), firm, F.concat(F.lit("**"), F.col("key"), F.lit("**")), "value", F.concat(F.lit('<a href="'), "url", F.lit('">apply</a>')), F.lit("|").substr(1, 0))
    by = rows.groupBy("source_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim(line).alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.array(F.concat(F.lit("## "), "section", F.lit(" (300 rows)")), F.lit(""), F.lit("| Company | Role | Status | Link |"), F.lit("|---|---|---|---|"))
    docs = by.groupBy("source_id").agg(F.array_join(F.flatten(F.array_sort(F.collect_list(F.concat(head, "lines", F.array(F.lit("")))))), "\n").alias("text"))
    return tables.listings(tables.markdown_tables(docs), ["Company"], ["Role"], ignored=["Status"], exclude="low")[0]


@query(f"""WITH {BOARDS}, t AS (SELECT *, 'list-' || (ord // 2000) AS list, row_number() OVER (PARTITION BY ord // 2000, section ORDER BY ord) AS n FROM b),
r AS (SELECT list AS source_id, section, 'Firm & Sons ' || (CASE WHEN n % 5 = 2 THEN (n - 1) % 7 ELSE n % 7 END) AS firm, key || ' – ' || substr(value, 1, 1) AS role, url, ord FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id, section, firm, role ORDER BY ord) AS m FROM r)
SELECT source_id, section, firm || ' / ' || role || CASE WHEN m > 1 THEN ' #' || m ELSE '' END AS key, 'Company=' || firm || '; Role=' || role || '; Link=[apply](' || url || ')' AS value, url FROM k WHERE section <> '5-LOW'""")
def parse_html_tables(spark, sf_dir):
    """Lists of some two thousand orders as HTML tables under headings, parsed to rows."""
    from pyspark.sql import Window

    from tidewatch.sources import tables

    lists = boards(spark, sf_dir, "new").withColumn("source_id", F.concat(F.lit("list-"), F.floor(F.col("ord") / 2000).cast("string")))
    rows = lists.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "section").orderBy("ord")))
    firm = F.when(F.col("n") % 5 == 2, "↳").otherwise(F.concat(F.lit("Firm &amp; <b>Sons</b> "), (F.col("n") % 7).cast("string")))
    role = F.concat("key", F.lit(" &#x2013; "), F.substring("value", 1, 1))
    link = F.concat(F.lit('<a class="b" href="'), "url", F.lit('?utm_source=list">apply</a>'))
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in (firm, role, link)], F.lit("</tr>"))
    by = rows.groupBy("source_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    table_ = F.concat(F.lit("## "), "section", F.lit(" (40 rows)\n<table><tr><th>Company</th><th>Role</th><th>Link</th></tr>\n"), "body", F.lit("</table>\n"))
    docs = by.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(table_)), "\n").alias("text"))
    return tables.listings(tables.html_tables(docs), ["Company"], ["Role"], exclude="low")[0]


@query(f"WITH {BOARDS} SELECT source_id, section, key, value, url FROM b")
def snapshot_round_trip(spark, sf_dir):
    """Rows rendered to their stored text and parsed again."""
    from tidewatch.sources import state

    rows = boards(spark, sf_dir, "new").withColumn("value", F.concat_ws("\t", "value", "url"))
    texts = state.render_snapshots(rows, rows.select("source_id", "section").distinct())
    return state.parse_snapshots(texts)[0].withColumn("value", F.element_at(F.split("value", "\t"), 1))


# ---------------------------------------------------------------- streams


@query(f"WITH {_ATTEMPTS} SELECT source_id, failures, last_success, last_attempt, 0 AS late FROM r")
def stream_source_health(spark, sf_dir):
    """The attempt log as a stream of several batches in no order; the last state of each source."""
    from tidewatch.session import work_folder
    from tidewatch.streaming import health

    folder = work_folder(spark, "stream-health")
    log = attempts(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    log.repartition(8, "attempt_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")

    def keep(batch, n):
        batch.where("kind <> 'retry'").withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, health.STATE_STORE)
    try:
        run = health.source_health(stream, timers=False).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    last = F.max_by(F.struct("failures", "last_success", "last_attempt", "late"), "batch").alias("x")
    return spark.read.parquet(f"{folder}/out").groupBy("source_id").agg(last).select("source_id", "x.*")


@query(ORACLE_SQL["diff_changes"])
def stream_diff(spark, sf_dir):
    """Two versions of the boards as two batches of a stream; the changes of the second."""
    from tidewatch.session import work_folder
    from tidewatch.streaming import diff

    folder = work_folder(spark, "stream-diff")
    columns = ["source_id", "section", "key", "value", "url"]
    for n, version in enumerate(both_boards(spark, sf_dir)):
        version.select(*columns).write.parquet(f"{folder}/in/v={n}")
        stream = spark.readStream.schema("source_id string, section string, key string, value string, url string").parquet(f"{folder}/in/v=*")
        diff.diff_stream(stream, folder, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/changes/version=1")


from tidewatch.plans import catalog_daily, catalog_state, catalog_text, catalog_tracking  # noqa: E402, F401  their queries register themselves
