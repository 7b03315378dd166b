from pyspark.sql import functions as F

from tidewatch.plans import jobs

ROWS = "source_id string, section string, key string, value string, url string"


def day(spark, folder):
    old = spark.createDataFrame([("list", "S", "Acme / Dev", "v", ""), ("acme-board", "S", "x", "v", ""), ("down", "S", "x", "v", "")], ROWS)
    link = "https://acme.com/jobs/Dev_R-12345"
    new = spark.createDataFrame([("list", "S", "Acme / Dev", "v", ""), ("list", "S", "Acme / Intern", f"[a]({link})", link), ("acme-board", "S", "x", "v", ""), ("acme-board", "S", "Intern 2027", f"URL={link}", link), ("acme-board", "S", "Human Resources Intern", "v", "")], ROWS)
    metrics = spark.createDataFrame([("list", True, ""), ("acme-board", True, "Acme"), ("down", False, "")], "source_id string, ok boolean, program_name string")
    one = lambda name, *rows: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    bodies = spark.createDataFrame([], "change_id string, text string")
    judgments = spark.createDataFrame([], "change_id string, relevant boolean, confidence string, deadline string, employer_size string")
    return old, jobs.run_daily(new, old, metrics, one("source_id", "list"), one("name"), one("mute_key"), bodies, judgments, F.lit("2027-01-10").cast("date"), folder)


def test_a_day(spark, tmp_path):
    old, (done, rows) = day(spark, f"{tmp_path}/a")
    assert sorted((r.source_id, r.key) for r in done.changes.collect()) == [("acme-board", "Human Resources Intern"), ("acme-board", "Intern 2027")]
    assert {r.filter_id: r.removed for r in done.reports.groupBy("filter_id").agg(F.sum("removed").alias("removed")).collect()} == {"removed-row": 0, "duplicate-posting": 1, "muted": 0, "applied": 0}
    assert done.snapshots.where("source_id = 'down'").count() == 1 and done.snapshots.count() == 6
    got = {r.key: (r.relevant, r.rule, r.tier) for r in rows.collect()}
    assert got == {"Human Resources Intern": (False, "out-of-field-title", "Medium"), "Intern 2027": (True, None, "Medium")}
    assert [r.shown for r in jobs.digest_rows(rows).collect()] == [True, True]


def test_replay_is_equal(spark, tmp_path):
    first = sorted(map(str, day(spark, f"{tmp_path}/a")[1][0].changes.collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, day(spark, f"{tmp_path}/b")[1][0].changes.collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_coverage_discovery_and_entries(spark, tmp_path):
    rows = spark.createDataFrame([(1, "https://a.org/jobs/12345", "Acme", "Quant Developer Intern", False), (2, "", "Beta Co", "Trading Intern", False)], "row long, url string, company string, title string, is_aggregator boolean")
    ref = spark.createDataFrame([(10, "Acme Inc", "Other name", "https://www.a.org/jobs/12345/"), (11, "Gamma", "Ops", "")], "row long, company string, title string, url string")
    got = jobs.measure_coverage(rows, ref, {"all": F.lit(True)}, "2024-01-01", f"{tmp_path}/c").first()
    assert (got.ours, got.theirs, got.only_ours, got.lead) == (2, 2, 1, 0.5)
    pages = spark.createDataFrame([(1, "see boards.greenhouse.io/acme and boards.greenhouse.io/embed, leverage")], "page_id long, html string")
    none = spark.createDataFrame([], "kind string, key string, priority string")
    found = jobs.discover(pages, none, none, none).collect()
    assert [(r.kind, r.key, r.status) for r in found] == [("greenhouse", "acme", "proposed")]
    programs = spark.createDataFrame([("t", "https://a.org/x", "", "MAYBE")], "target_id string, url string, source_id string, eligible string")
    watched = spark.createDataFrame([("p", "https://a.org/x", 1)], "source_id string, url string, ord int")
    assert jobs.partition_programs(programs, watched, ["YES", "MAYBE"]).first().check_order == 2


def test_boards_named_by_a_page(spark):
    from tidewatch.operators import programs as PG

    cases = {
        1: ('<script src="https://boards.greenhouse.io/embed/job_board/js?for=Acme"></script> <a href="https://boards.greenhouse.io/acme/jobs/1">', {("greenhouse", "acme")}),
        2: ("https://boards-api.greenhouse.io/v1/boards/Graham/jobs", {("greenhouse", "graham")}),
        3: ("grnhse_app?x=1&for=verition jobs.eu.lever.co/abc-1 https://jobs.ashbyhq.com/api", {("greenhouse", "verition"), ("lever", "abc-1")}),
        4: (None, set()),
        5: ("job-boards.eu.greenhouse.io/embed/job_board?for=Eclipse", {("greenhouse", "eclipse")}),
    }
    got = PG.fingerprints(spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "page_id int, html string")).collect()
    assert {k: {(r.method, r.slug) for r in got if r.page_id == k} for k in cases} == {k: v for k, (_, v) in cases.items()}


def test_a_batch_is_routed_whole_or_not_at_all(spark, tmp_path):
    from tidewatch.operators import programs as PG

    schema = "ord int, name string, url string, category string, notes string, eligible string, status string, by_agent boolean, source struct<source_id:string,method:string,tier:string,signal:string>, manual struct<why_manual:string,how_to_check:string,when_to_check:string>, priority struct<band:string,value:string,why:string>"
    new = lambda n, name, source=None, manual=None, priority=None, url="https://x.org": (n, name, url, "Competition", "n", "", "", True, source, manual, priority)
    no_id, pin = (None, None, None, None), ("A", None, None)
    entries = [new(1, "Old", no_id, None, pin), new(2, "Quant Day", no_id, ("w", None, None), pin), new(3, "quant day ", no_id), new(4, "Quant-Day!", no_id, None, pin), new(5, "Mine", ("taken", None, None, None)), new(6, "Third", no_id, ("w", None, None))]
    one = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    tables = {"programs": one("name string", ("OLD",)), "sources": one("source_id string", ("taken",), ("third",), ("third-2",)), "manual": one("name string", ("third",)), "priority": one("name string, rank string", ("x", "4"), ("y", "none"))}
    routes = PG.routed(one(schema, *entries), tables, F.lit("2024-01-20").cast("date"), f"{tmp_path}/r")
    rows = {k: {r.ord: r for r in v.collect()} for k, v in routes.items()}
    assert {k: r.source_id for k, r in rows["programs"].items()} == {2: "quant-day", 4: "quant-day-2", 5: "taken", 6: "third-3"}
    assert set(rows["sources"]) == {2, 4, 6} and set(rows["manual"]) == {2}
    assert {k: r["rank"] for k, r in rows["priority"].items()} == {2: "5", 4: "6"}
    PG.committed(routes, f"{tmp_path}/out", 1)
    routes["programs"].write.parquet(f"{tmp_path}/out/programs/version=2")
    assert PG.batches(spark, f"{tmp_path}/out", "programs").count() == 4
    bad = PG.routed(one(schema, *entries, new(9, "Bad", url="nowhere")), tables, F.lit("2024-01-20").cast("date"), f"{tmp_path}/s")
    assert all(v.count() == 0 for v in bad.values())


def test_a_day_from_raw_bodies(spark, tmp_path):
    from tidewatch.plans import daily

    one = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    source = "source_id string, method string, url string, program_names string, signal string, min_rows int, min_sections int"
    sources = one(source, ("acme", "greenhouse", "", "Acme", "high", None, None), ("list", "github_readme", "", "The list", "low", None, None), ("site", "page_text", "", "", "high", None, None), ("bad", "lever", "", "Bad", "high", None, None), ("few", "ashby", "", "Few", "high", 3, None), ("odd", "fax", "", "", "", None, None), ("off", "lever", "", "Off", "", None, None))
    names = ["acme", "list", "site", "bad", "few", "odd", "off", "gone"]
    attempts = one("source_id string, ok boolean, quarantined boolean, error string, ts timestamp, requested string, final string", *[(x, x != "off", False, "timeout" if x == "off" else "", None, "https://a.org/x", "https://a.org/x") for x in names]).withColumn("ts", F.lit("2027-01-10 06:00:00").cast("timestamp"))
    job = lambda title, place, n: {"title": title, "location": {"name": place}, "departments": [{"name": "Eng"}], "absolute_url": f"https://acme.com/jobs/{n}"}
    import json

    page = "<p>" + "</p><p>".join(f"Line number {k} of a page with text" for k in range(40)) + "</p>"
    bodies = [
        ("acme", 0, json.dumps({"jobs": [job("Quant Intern", "NYC", 12345), job("Chef", "NYC", 2), job("Data Intern", "London", 3)]})),
        ("list", 0, "# Firms\n| Company | Role | Link |\n|---|---|---|\n| Acme | Quant Intern | [a](https://www.acme.com/jobs/12345) |\n| Beta | Sophomore Explore Program | x |\n"),
        ("site", 0, page + "<p>Freshman insight day</p>"), ("bad", 0, '{"error": 1}'), ("few", 0, '{"jobs": []}'), ("odd", 0, "x"),
    ]
    rows = "source_id string, section string, key string, value string, url string"
    old_rows = one(rows, ("acme", "Eng", "Old Intern @ NYC", "v", ""), ("list", "Firms", "Zeta / Intern", "Company=Zeta", ""), ("bad", "S", "kept", "v", ""))
    from tidewatch.functions.text import page_lines

    old_lines = one("source_id string, html string", ("site", page)).select("source_id", page_lines(F.col("html")).alias("lines"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    judgments = empty("change_id string, outcome string, relevant boolean, confidence string, why string, deadline string, class_year string, location string, employer_size string")
    pins = one("change_id string, source_id string, company string, position string, deadline string, first_pinned string, last_seen string", ("p1", "bad", "Bad", "Kept", "", "2027-01-01", "2027-01-09"), ("p2", "acme", "Acme", "Old", "", "2027-01-01", "2027-01-09"))
    states = one("source_id string, failures long, last_success timestamp, last_attempt timestamp", ("off", 2, None, None), ("acme", 1, None, None))
    programs = one("name string, status string, last_checked string, snapshot_hash string, last_changed string", ("Acme", "dormant", "", "old", ""), ("Bad", "dormant", "", "old", ""))
    day = daily.run_day(sources, attempts, one("source_id string, page_no int, body string", *bodies), old_rows, old_lines, empty("name string"), empty("mute_key string"), empty("change_id string, text string"), judgments, pins, states, programs, F.lit("2027-01-10").cast("date"), F.lit("2027-01-10 07:00:00").cast("timestamp"), folder=f"{tmp_path}/day")
    results = {r.source_id: r for r in day.replay.parsed.results.collect()}
    assert {k for k, r in results.items() if r.ok} == {"acme", "list", "site"}
    assert (results["few"].error, results["off"].error, results["odd"].error) == ("parsed only 0 rows, expected at least 3", "timeout", "nothing reads method fax")
    assert results["gone"].error == "fetched, but no longer among the sources" and (results["acme"].not_wanted, results["acme"].not_home) == (1, 1)
    got = {(r.source_id, r.kind, r.key): r for r in day.rows.collect()}
    assert set(got) == {("acme", "added", "Quant Intern @ NYC"), ("list", "added", "Beta / Sophomore Explore Program"), ("site", "changed", "page changed: 1 added, 0 removed")}
    assert (got["list", "added", "Beta / Sophomore Explore Program"].company, got["site", "changed", "page changed: 1 added, 0 removed"].tier) == ("Beta", "Medium")
    reports = {r.filter_id: r.n for r in day.replay.day.reports.groupBy("filter_id").agg(F.sum("removed").alias("n")).collect()}
    assert reports["duplicate-posting"] == 1 and reports["removed-row"] == 2
    kept = {(r.source_id, r.key) for r in day.replay.day.snapshots.collect()}
    assert ("bad", "kept") in kept and ("acme", "Quant Intern @ NYC") in kept and ("acme", "Old Intern @ NYC") not in kept
    assert {r.change_id for r in day.pins.collect()} == {"p1"}
    assert {r.source_id: (r.failures, r.hours) for r in day.states.collect()} == {"off": (3, 6), "acme": (0, 0)}
    tracked = {r.name: r for r in day.programs.collect()}
    assert len(tracked["Acme"].snapshot_hash) == 64 and tracked["Bad"].snapshot_hash == "old"
    table = daily.digest(day.rows, day.pins, day.replay.parsed.results, day.states.withColumn("last_success", F.col("last_success").cast("string")), folder=f"{tmp_path}/digest").collect()
    listed = [(r.part, r.company) for r in sorted(table, key=lambda r: (r.part, r.n)) if r.part != 2]
    # rows of one rank stand in the order of their numbers, which are hashes
    assert listed[:2] == [(0, "Bad"), (1, "off")] and set(listed[2:]) == {(1, "Acme"), (1, "")}
