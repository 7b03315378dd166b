import json

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import feeds, state, tables


def test_shapes(spark):
    bodies = ['{"error": "x", "jobs": []}', "{}", '{"jobs": 3}', '{"jobs": [1]}', '{"error": null, "jobs": []}', "[]", "oops", '{"jobs": [{"a": 1}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = [tuple(r) for r in df.select("n", feeds.shape_error(F.col("body"), "jobs").alias("a"), feeds.shape_error(F.col("body"), "jobs", paged=True).alias("b")).orderBy("n").collect()]
    assert [x[1] for x in got] == ["the feed reports an error", "no jobs", "not a list", "a member is not an object", "", "not an object", "not JSON", ""]
    assert got[1][2] == ""
    lever = df.select(feeds.shape_error(F.col("body"), "").alias("a")).collect()
    assert lever[5].a == "" and lever[1].a == "not a list"


def one(spark, method, body, **options):
    raw = spark.createDataFrame([("s", 0, json.dumps(body))], "source_id string, page_no int, body string")
    return [tuple(r[2:]) for r in feeds.postings(raw, method, **options).collect()]


def test_seven_feeds(spark):
    assert one(spark, "greenhouse", {"jobs": [{"title": " T ", "location": {"name": "L"}, "departments": [{"name": "D"}], "metadata": [{"name": "Job Type", "value": "Intern"}], "absolute_url": "u", "content": "<b>x</b> &amp; y"}]}) == [("T", "L", "D", "Intern", "u", "x & y")]
    assert one(spark, "lever", [{"text": "T", "hostedUrl": "u", "categories": {"location": "L", "team": "X", "commitment": "C"}, "descriptionPlain": "a", "additionalPlain": "b"}]) == [("T", "L", "X", "C", "u", "a b")]
    assert one(spark, "ashby", {"jobs": [{"title": "T", "isListed": False}, {"title": "U", "location": "L"}]}) == [("U", "L", "", "", "", "")]
    detail = spark.createDataFrame([("s", "/p", json.dumps({"jobPostingInfo": {"timeType": "Full", "jobDescription": "d"}}))], "source_id string, path string, body string")
    assert one(spark, "workday", {"jobPostings": [{"title": "T", "locationsText": "L", "externalPath": "/p"}]}, details=detail, base="https://h/wday/x") == [("T", "L", "(no department)", "Full", "https://h/p", "d")]
    assert one(spark, "phenom", {"jobs": [{"data": {"title": "T", "category": ["Interns + Co-ops"], "city": {"name": "C"}, "country": "US", "apply_url": "u", "description": "d"}}, {"data": {"title": "T", "category": "Experienced"}}]}) == [("T", "C, US", "Interns + Co-ops", "Interns + Co-ops", "u", "d")]
    assert one(spark, "eightfold", {"positions": [{"name": "T", "location": "L", "business_unit": "B", "canonicalPositionUrl": "u"}]}) == [("T", "L", "B", "", "u", "")]
    assert one(spark, "nsf", {"response": {"award": [{"id": "7", "title": "REU Site: X", "divAbbr": "dms", "awardeeName": "U", "awardeeStateCode": "CA", "expDate": "2027", "abstractText": "a"}, {"title": "Other", "divAbbr": "DMS"}]}}) == [("REU Site: X", "U, CA", "DMS", "REU", "https://www.nsf.gov/awardsearch/showAward?AWD_ID=7", "a Award funded through 2027.")]


def test_partial_reads_and_unions(spark):
    pages = spark.createDataFrame([("a", 20, 30), ("a", 5, 30), ("b", 3, None)], "source_id string, items long, total long")
    assert {r.source_id: r.error for r in feeds.paging_error(pages).collect()} == {"a": "read 25 of 30", "b": ""}
    passes = spark.createDataFrame([("a", i % 30) for i in range(2, 58)], "source_id string, id long")
    rows, errors = feeds.union_of_passes(passes, spark.createDataFrame([("a", 30)], "source_id string, total long"))
    assert rows.count() == 30 and errors.first().error == ""


def test_markdown_and_html_tables(spark):
    md = "# Firms (3 rows)\n| Company | Role | Location |\n|---|:--:|---|\n| **Acme** | Dev 🔥 | NYC |\n| ↳ | Ops | |\n| | None | |\n\ntext | not\n| a | b |\n## Key\n| Sign | Meaning |\n|--|--|\n| x | y |\n"
    html = "# Firms\n<table><tr><th>Company</th><th>Role</th></tr><tr><td><a href='https://a.org/1'>Acme</a></td><td>Dev</td></tr></table>\n## Other\n<table><tr><th>Company</th><th>Role</th></tr><tr><td>B</td><td>C</td></tr></table>"
    docs = spark.createDataFrame([("m", md)], "source_id string, text string")
    rows, reports = tables.listings(tables.markdown_tables(docs), ["Firm", "Company"], ["Role"], ["Location"])
    assert sorted((r.section, r.key, r.value) for r in rows.collect()) == [("Firms", " / None", "Role=None"), ("Firms", "Acme / Dev @ NYC", "Company=Acme; Role=Dev 🔥; Location=NYC"), ("Firms", "Acme / Ops", "Company=Acme; Role=Ops")]
    assert tuple(reports.select("considered", "no_entity_column").first()) == (4, 1)
    rows, _ = tables.listings(tables.html_tables(spark.createDataFrame([("h", html)], "source_id string, text string")), ["Company"], ["Role"])
    assert sorted((r.section, r.key, r.url) for r in rows.collect()) == [("Firms", "[Acme](https://a.org/1) / Dev", "https://a.org/1"), ("Other", "B / C", "")]


def test_snapshot_text_round_trip(spark):
    stored = "# sections\nA\nEmpty\n# rows\nA\tk\tv\twith tab\nA\tꓟ key\thttps://a.org https://b.org\n"
    rows, sections = state.parse_snapshots(spark.createDataFrame([("s", stored), ("legacy", "A\tk\tv\nshort\tline\n")], "source_id string, text string"))
    assert {r.section for r in sections.collect()} == {"A", "Empty"}
    assert sorted((r.source_id, r.value, r.url) for r in rows.collect()) == [("legacy", "v", ""), ("s", "https://a.org https://b.org", "https://a.org"), ("s", "v\twith tab", "")]
    mine = state.render_snapshots(rows.where("source_id = 's'"), sections)
    assert mine.first().text == stored


def test_dimensions_stages_and_bodies(spark, tmp_path):
    (tmp_path / "d.csv").write_text("b,stray,a\n1,x,\n")
    dim = state.read_dimension(spark, str(tmp_path / "d.csv"), ["a", "b", "missing"])
    assert [tuple(r) for r in dim.collect()] == [("", "1", "")]
    df = spark.createDataFrame([(1,)], "x int")
    path = str(tmp_path / "stage")
    state.write_stage(df, path, "2024-01-01", 2)
    state.write_stage(df, path, "2024-01-02", 2)
    state.write_stage(df, path, "2024-01-02", 2)
    assert state.read_stage(spark, path, "2024-01-02", 2, ["x"]).count() == 1
    for date, version, columns in (("2024-01-03", 2, ["x"]), ("2024-01-02", 3, ["x"]), ("2024-01-02", 2, ["y"])):
        with pytest.raises(ValueError):
            state.read_stage(spark, path, date, version, columns)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "s1.html").write_bytes(b"ok \xff")
    (tmp_path / "raw" / "s2.html").write_bytes(b"")
    attempts = spark.createDataFrame([("s1", 4), ("s2", 0), ("s3", None)], "source_id string, size long")
    got = {r.source_id: r.body for r in state.attempt_facts(attempts, state.read_bodies(spark, str(tmp_path / "raw"))).collect()}
    assert got == {"s1": "ok �", "s2": "", "s3": None}


def test_markers_and_final_addresses(spark, tmp_path):
    from tidewatch.sources import state

    folder = f"{tmp_path}/marks"
    assert state.read_marker(spark, folder, "discovery") is None
    state.write_marker(spark, folder, "discovery", "2024-01-01", 1)
    state.write_marker(spark, folder, "discovery", "2024-01-08", 2)
    state.write_marker(spark, folder, "discovery", "2024-01-09", 2)
    assert state.read_marker(spark, folder, "discovery") == "2024-01-09"
    attempts = spark.createDataFrame([("a", 3, "u", "v"), ("b", 0, "u", ""), ("c", None, None, None)], "source_id string, size long, requested string, final string")
    bodies = spark.createDataFrame([("a", "xyz", 3, "h")], "source_id string, body string, size long, sha256 string")
    got = {r.source_id: (r.body, r.final_url) for r in state.attempt_facts(attempts, bodies).collect()}
    assert got == {"a": ("xyz", "v"), "b": ("", "u"), "c": (None, None)}
