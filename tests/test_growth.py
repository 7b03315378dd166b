"""Steps whose work must grow with their input and not with the pairs of a key."""

from pyspark.sql import functions as F

from tidewatch.functions import text, urls
from tidewatch.operators import coverage as C
from tidewatch.operators import programs as PG
from tidewatch.operators.components import components
from tidewatch.plans import daily
from tidewatch.sources import feeds, tables


def join_rows(df) -> int:
    """Rows that the largest join of ``df`` made."""
    df.collect()

    def walk(node):
        name, found = node.nodeName(), 0
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found = node.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = node.children()
        return max([found, *[walk(children.apply(k)) for k in range(children.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def test_pages_of_one_path_are_not_paired_with_its_targets(spark):
    targets = spark.createDataFrame([(k, "https://x.org/a/b", "") for k in range(200)], "target_id long, url string, source_id string")
    watched = spark.createDataFrame([(f"p{k}", "https://x.org/a" if k % 2 else "https://x.org/a/b", k + 5) for k in range(200)], "source_id string, url string, ord long")
    found = PG.covering(targets, watched)
    assert join_rows(found) <= 2 * 200
    assert {tuple(r) for r in found.collect()} == {(k, "p0", "same page") for k in range(200)}


def test_headers_of_a_table_are_found_once(spark):
    body = "<table><tr><th>Company</th><th>Role</th></tr>" + "".join(f"<tr><td>F&#x2013;{k}</td><td>R</td></tr>" for k in range(20)) + "</table>"
    found = tables.html_tables(spark.createDataFrame([("s", "## A\n" + body)], "source_id string, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    exploded = next(k for k, line in enumerate(plan) if "Generate" in line)
    assert not [line for line in plan[:exploded] if "<th" in line]
    rows = found.orderBy("row_no").collect()
    assert [r.cells for r in rows] == [{"Company": f"F–{k}", "Role": "R"} for k in range(20)]


def test_a_feed_is_parsed_once_for_its_shape(spark):
    bodies = spark.createDataFrame([('{"jobs": [{"a": 1}]}',), ('{"jobs": [1]}',), ("x",), ('{"jobs": {}}',), ('{"a": 1}',), ('{"jobs": [], "errors": [1]}',), ("[]",), (None,)], "body string")
    found = bodies.select(feeds.shape_error(F.col("body"), "jobs").alias("error"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parse_json") + found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
    assert [r.error for r in found.collect()] == ["", "a member is not an object", "not JSON", "not a list", "no jobs", "the feed reports an error", "not an object", "not JSON"]


def test_coverage_joins_equal_titles_by_a_star(spark, tmp_path):
    words = [["a", "b", "c"], ["c", "b", "a"], ["a", "b", "c", "d"], ["x"]]
    rows = spark.createDataFrame([(k, "f", words[k % 4]) for k in range(400)], "row long, block string, words array<string>")
    edges = C.overlap_edges(rows, f"{tmp_path}/edges")
    assert edges.count() <= 2 * 400
    roots = {r.node: r.root for r in components(edges, f"{tmp_path}/roots").collect()}
    assert roots == {k: 3 if k % 4 == 3 else 0 for k in range(400)}
    plain = [(a, b, len(set(words[a % 4]) & set(words[b % 4]))) for a in range(40) for b in range(a + 1, 40) if (a % 4 == 3) == (b % 4 == 3)]
    assert sorted(map(tuple, C.overlap_pairs(rows.where("row < 40")).collect())) == plain


def test_coverage_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            made.add(x.num_rows)
            yield x

    schema = "row long, ids array<string>, block string, words array<string>, is_reference boolean, is_aggregator boolean, title string"
    rows = spark.createDataFrame([(k, [f"x:{k % 50}"], "f", ["a", f"w{k % 7}"], k % 3 == 0, k % 2 == 0, "quant" if k < 60 else "") for k in range(200)], schema).mapInArrow(counted, schema)
    found = C.coverage(rows, {"all": F.lit(True), "quant": F.col("title") == "quant"}, folder=f"{tmp_path}/coverage").collect()
    assert made.value == 200
    assert sorted(map(tuple, found)) == [("all", 1, 1, 0, 0, 0.0), ("quant", 1, 1, 0, 0, 0.0)]


def test_parts_of_a_link_and_a_key_are_found_once(spark):
    rows = spark.createDataFrame([("https://www.x.org/a/12345/", "Acme: (new) b", "acme", False), (None, None, None, None), ("https://a.greenhouse.io/x?gh_jid=77777", "[F](u) / T", "", None), ("https://h.org/a_R-123", "A / B / C", "A", True)], "url string, key string, company string, is_list boolean")
    who = text.employer_position(F.col("key"), F.col("company"), F.col("is_list"))
    found = rows.select(urls.url_identity(F.col("url")).alias("id"), who.alias("who")).select("id", "who.company", "who.position")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("gh_jid") == 1 and plan.count("[A-Za-z][A-Za-z0-9+.-]*://") <= 3
    assert sorted(map(tuple, found.collect()), key=str) == [
        ("greenhouse.io:77777", "F", "T"), ("h.org:R-123", "A", "B / C"), ("x.org:12345", "acme", "page updated (new) b"), (None, "", None),
    ]


def test_rows_of_one_list_are_dealt_over_tasks(spark, tmp_path):
    key = F.concat(F.lit("F / Quant Intern "), (F.col("id") + 1000).cast("string"))
    snapshots = spark.range(400).select(F.lit("list").alias("source_id"), F.lit("S").alias("section"), key.alias("key"), F.lit("").alias("value"), F.lit("").alias("url"))
    sources = spark.createDataFrame([("list", daily.TABLES, "")], "source_id string, method string, program_names string")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        found = daily.coverage_of(snapshots, sources, spark.createDataFrame([], "body string"), "2024-01-20", f"{tmp_path}/coverage").collect()
    finally:
        spark.conf.set(coalesce, before)
    assert sorted((r.scope, r.ours) for r in found) == [("fields", 400), ("quant", 400)]
    named = spark.read.parquet(f"{tmp_path}/coverage/named")
    assert named.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 200
