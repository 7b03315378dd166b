"""Registered queries of stored state, of the other feed shapes, and of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import health as HL
from tidewatch.operators import identity as I
from tidewatch.operators import pins as PN
from tidewatch.operators import reports as RP
from tidewatch.operators import screens as S
from tidewatch.operators import snapshot as SN
from tidewatch.operators.places import placed
from tidewatch.plans import jobs
from tidewatch.plans.catalog import BOARDS, CHANGES, both_boards, boards, query, table
from tidewatch.session import work_folder
from tidewatch.sources import feeds, state

# ---------------------------------------------------------------- tables on disk


@query("SELECT c_name, coalesce(c_mktsegment, '') AS c_mktsegment, '' AS missing FROM customer")
def dimension_round_trip(spark, sf_dir):
    """A dimension written in order as CSV and read with a column that it lacks."""
    path = work_folder(spark, "dimension")
    state.write_dimension(table(spark, sf_dir, "customer"), path, ["c_name", "c_mktsegment", "c_custkey"], sort=["c_name"])
    return state.read_dimension(spark, path, ["c_name", "c_mktsegment", "missing"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'again' ELSE 'first' END AS said FROM orders WHERE o_orderkey % 4 < 2")
def stage_round_trip(spark, sf_dir):
    """A stage's table of two runs, of which one is written twice; the rows of that one are all that is read back."""
    path, o = work_folder(spark, "stage"), table(spark, sf_dir, "orders").select("o_orderkey")
    for said, rest, date in (("first", "o_orderkey % 4 < 2", "2024-01-01"), ("other", "o_orderkey % 4 >= 2", "2024-01-02")):
        state.write_stage(o.where(rest).withColumn("said", F.lit(said)), path, date, 3)
    both = o.where("o_orderkey % 4 < 2").withColumn("said", F.when(F.col("o_orderkey") % 2 == 0, "again").otherwise("first"))
    state.write_stage(both, path, "2024-01-01", 3)
    return state.read_stage(spark, path, "2024-01-01", 3, ["o_orderkey", "said"])


@query("SELECT o_orderpriority, count(*) AS n, CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-08' ELSE '2024-01-01' END AS date FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 GROUP BY ALL")
def history_rerun(spark, sf_dir):
    """A history by date, one date of which is recorded again with fewer rows counted."""
    path, o = work_folder(spark, "history"), table(spark, sf_dir, "orders")
    for keep, date in (("o_orderkey % 2 = 1", "2024-01-01"), ("o_orderkey % 2 = 0", "2024-01-08"), ("o_orderkey % 2 = 1 AND o_orderkey % 3 = 0", "2024-01-01")):
        counts = o.where(keep).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
        state.record_history(counts.withColumn("date", F.lit(date).cast("date")), path)
    return spark.read.parquet(path).select("o_orderpriority", "n", F.col("date").cast("string").alias("date"))


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def log_appended(spark, sf_dir):
    path, c = work_folder(spark, "log"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    state.append_log(c, path)
    state.append_log(c.where("c_custkey % 3 = 0"), path)
    return spark.read.parquet(path)


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'text ' || page_id END AS text, page_id % 3 < 2 AS hit FROM (SELECT url, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY url)")
def body_cache(spark, sf_dir):
    """Pages' addresses against a cache that has two thirds of them, some with an empty body."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id"))
    k = F.col("page_id")
    cache = p.where(k % 3 < 2).select(F.sha1(F.col("url").cast("binary")).alias("url_key"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("text "), k.cast("string"))).alias("text"))
    return state.with_cache(p.select("url"), cache)


@query("SELECT 'key ' || c_custkey AS mute_key, '2024-01-01' AS marked_at, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS title FROM customer")
def mute_list(spark, sf_dir):
    path, c = work_folder(spark, "mutes"), table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("key "), F.col("c_custkey").cast("string")).alias("mute_key"), F.lit("2024-01-01").alias("marked_at"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"))
    state.write_mute_list(rows, path)
    c.select(F.when(F.col("c_custkey") % 3 == 0, "# a note").when(F.col("c_custkey") % 3 == 1, "").otherwise("\tno key").alias("value")).write.mode("append").text(path)
    return state.read_mute_list(spark, path)


@query("""WITH a AS (SELECT 'src-' || (o_custkey % 50) AS source_id, o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0), g AS (SELECT source_id, count(DISTINCT id) AS got FROM a GROUP BY source_id),
t AS (SELECT 'src-' || (o_custkey % 50) AS source_id, count(*) FILTER (o_custkey % 2 = 0 OR o_orderkey % 5 <> 0) AS total FROM orders GROUP BY ALL)
SELECT source_id, got, total, CASE WHEN got < total THEN 'read ' || got || ' of ' || total ELSE '' END AS error FROM t JOIN g USING (source_id)""")
def passes_united(spark, sf_dir):
    """Two overlapping passes over the same feeds; some totals aren't reached."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("src-"), (F.col("o_custkey") % 50).cast("string")).alias("source_id"), F.col("o_orderkey").alias("id"), "o_custkey")
    some = o.where("id % 5 <> 0").select("source_id", "id")
    totals = o.where("o_custkey % 2 = 0 OR id % 5 <> 0").groupBy("source_id").agg(F.count(F.lit(1)).alias("total"))
    return feeds.union_of_passes(some.where("id % 3 <> 0").unionByName(some.where("id % 3 <> 1")), totals)[1]


# ---------------------------------------------------------------- other feeds


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_partkey // 500 AS f FROM part)
SELECT 'phenom' AS method, 'phenom-' || f AS source_id, p_name || ' Intern' AS title, CASE WHEN k % 3 = 0 THEN 'Austin, USA' ELSE 'Austin' END AS location, CASE WHEN k % 2 = 0 THEN 'Student Jobs' ELSE 'Internship, ' || p_brand END AS department, 'https://x.org/' || k AS url FROM p WHERE k % 5 <> 0
UNION ALL SELECT 'workday', 'workday-' || f, p_name, 'Texas', '(no department)', 'https://acme.wd5.example.com/job/' || k FROM p
UNION ALL SELECT 'eightfold', 'eightfold-' || f, p_name, CASE WHEN k % 2 = 0 THEN 'NYC' ELSE '' END, CASE k % 3 WHEN 0 THEN 'Dept' WHEN 1 THEN 'Unit' ELSE '(no department)' END, 'https://e.org/' || k FROM p
UNION ALL SELECT 'nsf', 'nsf-' || f, 'REU Site: ' || p_name, 'State U, TX', CASE WHEN k % 2 = 0 THEN 'CNS' ELSE 'DMS' END, 'https://www.nsf.gov/awardsearch/showAward?AWD_ID=' || k FROM p WHERE k % 3 <> 0""")
def parse_other_feeds(spark, sf_dir):
    """Four feed shapes made of parts, with fields that are missing, scalars, lists and objects, and their own screens."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n, feed = k.cast("string"), F.floor(F.col("p_partkey") / 500).cast("string")
    esc = lambda c: F.regexp_replace(c, r'(["\\])', r"\\$1")
    category = F.when(k % 5 == 0, F.lit('"Sales"')).when(k % 2 == 0, F.lit('"Student Jobs"')).otherwise(F.concat(F.lit('["Internship", {"name": "'), esc("p_brand"), F.lit('"}]')))
    title = F.when(k % 4 == 0, F.concat(F.lit('{"value": "'), esc("p_name"), F.lit(' Intern"}'))).otherwise(F.concat(F.lit('"'), esc("p_name"), F.lit(' Intern"')))
    phenom = F.concat(F.lit('{"data": {"title": '), title, F.lit(', "category": '), category, F.lit(', "city": "Austin", "country": '), F.when(k % 3 == 0, '"USA"').otherwise("null"), F.lit(', "apply_url": "https://x.org/'), n, F.lit('"}}'))
    workday = F.concat(F.lit('{"title": "'), esc("p_name"), F.lit('", "locationsText": "Texas", "externalPath": "/job/'), n, F.lit('"}'))
    eightfold = F.concat(F.lit('{"name": "'), esc("p_name"), F.lit('", "canonicalPositionUrl": "https://e.org/'), n, F.lit('"'), F.when(k % 2 == 0, ', "location": "NYC"').otherwise(""), F.when(k % 3 == 0, ', "department": "Dept"').when(k % 3 == 1, ', "business_unit": "Unit"').otherwise(""), F.lit("}"))
    nsf = F.concat(F.lit('{"title": "'), F.when(k % 3 == 0, "Other: ").otherwise("REU Site: "), esc("p_name"), F.lit('", "id": "'), n, F.lit('", "divAbbr": "'), F.when(k % 2 == 0, "cns").otherwise("DMS"), F.lit('", "awardeeName": "State U", "awardeeStateCode": "TX"}'))
    shapes = {"phenom": (phenom, '{"jobs": [', "]}"), "workday": (workday, '{"jobPostings": [', "]}"), "eightfold": (eightfold, '{"positions": [', "]}"), "nsf": (nsf, '{"response": {"award": [', "]}}")}
    out = None
    for method, (item, begin, end) in shapes.items():
        # a feed has five hundred parts at most
        raw = p.groupBy(feed.alias("f")).agg(F.concat(F.lit(begin), F.array_join(F.collect_list(item), ", "), F.lit(end)).alias("body"))
        raw = raw.select(F.concat(F.lit(f"{method}-"), "f").alias("source_id"), F.lit(0).alias("page_no"), "body")
        found = feeds.postings(raw, method, base="https://acme.wd5.example.com/wday/cxs/acme").select(F.lit(method).alias("method"), "source_id", "title", "location", "department", "url")
        out = found if out is None else out.unionByName(found)
    return out


@query("""SELECT c_custkey AS page_id, unnest(['[{"id": ' || c_custkey || ', "name": "' || c_name || '"},', '{"id": 0},', '{"id": 1}]']) AS line FROM customer""")
def feed_lines(spark, sf_dir):
    """A JSON feed on one line is cut at its records, so that records differ as lines."""
    body = F.concat(F.lit('[{"id": '), F.col("c_custkey").cast("string"), F.lit(', "name": "'), "c_name", F.lit('"}, {"id": 0},{"id": 1}]'))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.explode(text.page_lines(body)).alias("line"))


@query("""SELECT p_partkey, p_partkey % 6 IN (0, 3) AS worth FROM part""")
def detail_plan(spark, sf_dir):
    """Which listings without a text deserve a second request."""
    k = F.col("p_partkey")
    title = F.when(k % 6 == 0, F.concat("p_name", F.lit(" Intern"))).when(k % 6 == 1, F.concat("p_name", F.lit(" Intern"))).when(k % 6 == 2, F.concat(F.lit("International "), "p_name")).when(k % 6 == 3, F.concat(F.lit("Sophomore "), "p_name")).when(k % 6 == 4, F.concat(F.lit("Campus Recruiter "), "p_name")).otherwise(F.col("p_name"))
    place = F.when(k % 6 == 1, "London").when(k % 6 == 3, "Narnia").otherwise("Austin, TX")
    return table(spark, sf_dir, "part").select("p_partkey", S.worth_detail(title, place).alias("worth"))


@query("""WITH u AS (SELECT DISTINCT p_type AS method FROM part WHERE p_partkey % 10 <> 0), h AS (SELECT DISTINCT p_type AS method FROM part WHERE p_partkey % 7 <> 0 AND p_size > 10)
SELECT method, 'no handler' AS problem FROM u ANTI JOIN h USING (method) UNION ALL SELECT method, 'no source' FROM h ANTI JOIN u USING (method)""")
def methods_without_handler(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return HL.without_handler(p.where("p_partkey % 10 <> 0").select(F.col("p_type").alias("method")), p.where("p_partkey % 7 <> 0 AND p_size > 10").select(F.col("p_type").alias("method")).distinct())


# ---------------------------------------------------------------- totals and orders


@query(f"WITH {BOARDS} SELECT count(*) FILTER (ord % 9 = 0) AS removed FROM b")
def removed_total(spark, sf_dir):
    """What one filter removed over all sources' reports."""
    rows = boards(spark, sf_dir, "new")
    reports = RP.filter_report(rows, F.col("ord") % 9 == 0, "ninth", "a ninth").unionByName(RP.filter_report(rows, F.col("ord") % 2 == 0, "half", "a half"))
    return RP.removed_by(reports, "ninth")


@query(f"""WITH {BOARDS}, {CHANGES} SELECT source_id, kind, identity, row_number() OVER (ORDER BY source_id, CASE kind WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END, identity) AS position FROM c WHERE kind IS NOT NULL""")
def change_positions(spark, sf_dir):
    """Row changes in their order: by source, kind and identity."""
    changes = SN.row_changes(*both_boards(spark, sf_dir))
    rank = F.create_map(*[x for k, v in SN.KIND_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return I.positions(changes, [F.col("source_id").asc(), rank[F.col("kind")].asc(), F.col("identity").asc()]).select("source_id", "kind", "identity", "position")


@query("SELECT c_custkey, row_number() OVER (ORDER BY '2024-01-0' || (c_custkey % 9 + 1), lower(c_mktsegment), lower(c_name)) AS position FROM customer")
def pin_positions(spark, sf_dir):
    """Pins by their first day, company and position."""
    c = F.col("c_custkey")
    pins = table(spark, sf_dir, "customer").select(c, F.concat(F.lit("2024-01-0"), (c % 9 + 1).cast("string")).alias("first_pinned"), F.upper("c_mktsegment").alias("company"), F.col("c_name").alias("position"))
    found = placed(pins, [], PN.pin_order(), work_folder(spark, "pins"), "place")
    return found.select("c_custkey", (F.col("place") + 1).alias("position"))


@query("""WITH t AS (SELECT c_custkey AS target_id, 'example.com/a/' || (c_custkey % 200) || '/p' || c_custkey AS path, CASE c_custkey % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'CHECK' WHEN 2 THEN 'odd' END AS eligible FROM customer),
w AS (SELECT DISTINCT 'example.com/a/' || (c_custkey % 200) AS path, 's' || (c_custkey % 200) AS source_id FROM customer WHERE c_custkey % 200 < 100)
SELECT target_id, CASE WHEN w.path IS NULL THEN '' ELSE 'covered by ' || w.source_id END AS why, CASE eligible WHEN 'CHECK' THEN 1 WHEN 'YES' THEN 2 ELSE 3 END AS check_order FROM t LEFT JOIN w ON t.path LIKE w.path || '/%'""")
def programs_partitioned(spark, sf_dir):
    """Programs that a watched page covers, and the order in which the others are checked by hand."""
    c, page = F.col("c_custkey"), F.concat(F.lit("https://www.example.com/a/"), (F.col("c_custkey") % 200).cast("string"))
    programs = table(spark, sf_dir, "customer").select(c.alias("target_id"), F.concat(page, F.lit("/p"), c.cast("string"), F.lit("/?x=1")).alias("url"), F.lit("").alias("source_id"), F.when(c % 4 == 0, "YES").when(c % 4 == 1, "CHECK").when(c % 4 == 2, "odd").alias("eligible"))
    watched = table(spark, sf_dir, "customer").where("c_custkey % 200 < 100").select(F.concat(F.lit("s"), (c % 200).cast("string")).alias("source_id"), page.alias("url"), (c % 200).alias("ord")).distinct()
    return jobs.partition_programs(programs, watched, ["CHECK", "YES"]).select("target_id", "why", "check_order")
