"""Cases of the survey as inline tables."""

import datetime

import pytest
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

ROWS = "source_id string, section string, key string, value string, url string"


def values(spark, column, inputs, schema="x string"):
    return [r.y for r in spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], f"n int, {schema}").select("n", column.alias("y")).orderBy("n").collect()]


def test_diff_kinds_flags_and_baseline(spark):
    old = spark.createDataFrame([("a", "S", "k1", "v", ""), ("a", "S", "k2", "v", ""), ("a", "S", "k3", "v", "")], ROWS)
    new = spark.createDataFrame([("a", "S", "k1", "w", ""), ("a", "S", "k2", "v", ""), ("a", "S", "Freshman Insight Program", "v", ""), ("a", "T", "k", "v", ""), ("b", "S", "first sight", "v", "")], ROWS)
    got = {(r.kind, r.key): (r.discovery, r.structural) for r in SN.diff(old, new).collect()}
    assert got == {("changed", "k1"): (False, False), ("removed", "k3"): (False, False), ("added", "Freshman Insight Program"): (True, False), ("added", "k"): (False, False), ("section", "new section: T"): (True, True)}
    assert SN.ordered(SN.diff(old, new)).first().kind == "section"


def test_collapse_guards(spark):
    rows = lambda board, n: [("bulk", board, "added", f"k{i:02}", f"k{i:02}", False) for i in range(n)]
    changes = spark.createDataFrame(rows("acme", 26) + rows("zeta", 1), "source_id string, section string, kind string, key string, identity string, structural boolean")
    got = SN.collapsed(changes, ["source_id", "section"], 25).collect()
    assert sorted((r.section, r.structural, r.total) for r in got) == [("acme", True, 26), ("zeta", False, None)]
    assert next(r for r in got if r.structural).samples == [f"k{i:02}" for i in range(10)]
    busy = changes.where("section = 'acme'").select("source_id", "kind", "key", "identity", "structural")
    sizes = lambda n: spark.createDataFrame([("bulk", n, n)], "source_id string, old_rows long, new_rows long")
    assert SN.collapsed(busy, ["source_id"], 25, sizes(500)).count() == 26  # a busy day of a large list
    assert SN.collapsed(busy, ["source_id"], 25, sizes(60)).count() == 1


def test_failed_sources_keep_their_baseline(spark):
    old = spark.createDataFrame([("a", "S", "k", "old", ""), ("b", "S", "k", "old", "")], ROWS)
    new = spark.createDataFrame([("a", "S", "k", "new", "")], ROWS)
    metrics = spark.createDataFrame([("a", True), ("b", None)], "source_id string, ok boolean")
    assert sorted((r.source_id, r.value) for r in SN.committed(old, new, metrics).collect()) == [("a", "new"), ("b", "old")]


def test_reports_at_zero_and_unknown(spark):
    rows = spark.createDataFrame([("a", "k1", 1, True), ("a", "k2", 2, None), ("a", "k3", 3, False)], "source_id string, key string, ord int, out boolean")
    sources = spark.createDataFrame([("a",), ("quiet",)], "source_id string")
    got = {r.source_id: (r.considered, r.removed, r.samples) for r in RP.filter_report(rows, F.col("out"), "f", "r", sources).collect()}
    assert got == {"a": (3, 1, ["k1"]), "quiet": (0, 0, [])}


def test_backoff_schedule(spark):
    assert values(spark, HL.backoff_hours(F.col("x")), [0, 2, 3, 4, 5, 6, 7, 40], "x int") == [0, 0, 6, 12, 24, 48, 72, 72]
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [("new", 3, None, None), ("hot", 3, None, at - datetime.timedelta(hours=1)), ("cold", 3, at, at - datetime.timedelta(hours=7))]
    got = {r.source_id: (r.skip, r.never_succeeded) for r in HL.quarantine(spark.createDataFrame(rows, "source_id string, failures int, last_success timestamp, last_attempt timestamp"), F.lit(at)).collect()}
    assert got == {"new": (False, True), "hot": (True, True), "cold": (False, False)}


def test_quarantined_runs_move_nothing(spark):
    states = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3)], "source_id string, failures long").withColumns({"last_success": F.lit(None).cast("timestamp"), "last_attempt": F.lit(None).cast("timestamp")})
    runs = spark.createDataFrame([("a", False, True), ("b", True, False), ("c", False, False)], "source_id string, ok boolean, quarantined boolean").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert {r.source_id: r.failures for r in HL.next_state(states, runs).collect()} == {"a": 3, "b": 0, "c": 4}


def test_headings_keys_and_lookalikes(spark):
    assert values(spark, text.stable_heading(F.col("x")), ["Jobs (300 employer-stated)", "Quantitative Finance (Advanced)"]) == ["Jobs", "Quantitative Finance (Advanced)"]
    assert values(spark, text.key_text(F.col("x")), ["🔥 Acme ✅", "🔥", "↳ x"]) == ["Acme", "🔥", "↳ x"]
    assert values(spark, text.folded(F.col("x")), ["ꓟachine ꓡearning", "ＡＢ"]) == ["Machine Learning", "AB"]
    assert values(spark, text.clean_cell(F.col("x")), ['<a href="https://x.org/?utm_source=q">Apply</a> **now**']) == ["[Apply](https://x.org/) now"]


def test_noise_and_countdowns(spark):
    aged = ["11 Hours Ago Saved", "Yesterday Saved", "Reposted 2 Days Ago Saved", "We opened yesterday"]
    assert values(spark, text.masked(F.col("x")), aged) == ["<age> Saved"] * 3 + ["We opened yesterday"]
    page = lambda n: f"<div>Days</div><div>{n}</div><p>Applications close in 5 days.</p><script>x</script>"
    a, b = values(spark, text.countdowns(text.page_lines(F.col("x"))), [page(7), page(6)])
    assert a == b == ["Days", "<n>", "Applications close in 5 days."]


def test_posting_identities(spark):
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    got = values(spark, urls.posting_identities(F.col("x")), ["https://x.wd1.myworkdayjobs.com/a/Quant_R-106745", "see https://firm.com/job/?gh_jid=8222414).", "https://job-boards.greenhouse.io/firm/jobs/8222414", f"https://list.jobs/p/{uuid.upper()} https://list.jobs/c/FIRM", "https://firm.com/careers", None])
    assert got == [["x.wd1.myworkdayjobs.com:R-106745"], ["greenhouse.io:8222414"], ["greenhouse.io:8222414"], [f"list.jobs:{uuid}"], [], []]


def test_redirects(spark):
    a = "https://www.x.org/jobs"
    finals = ["https://x.org/404", "https://x.org/careers", "http://x.org/jobs", "https://www.x.org/jobs/", "https://www.x.org/jobs?q=1", "", None]
    assert values(spark, urls.redirect_verdict(F.lit(a), F.col("x")), finals) == ["fail", "warn", "", "", "", "", ""]


def test_links_out(spark):
    html = '<a href="/jobs/all-jobs">a</a><a href="//x.org/positions#f">b</a><a href="https://off.com/positions">c</a><a href="positions/1">d</a><a href="/positions/2">e</a><a href="/positions/3">f</a>'
    got = values(spark, urls.links_out(F.col("x"), F.lit("https://www.x.org/team/"), 'href="([^"]*(?:all-jobs|positions)[^"]*)"'), [html])
    assert got == [["https://www.x.org/jobs/all-jobs", "https://x.org/positions", "https://www.x.org/team/positions/1"]]


def test_page_floors_and_exemptions(spark):
    rows = [(1, "x" * 600, 10**7, 700, "u"), (2, "Blocked", 100, None, "u"), (3, "x" * 600, 1000, 5000, "u"), (4, "x" * 600, 1000, None, "u"), (5, "x" * 600, 1000, 700, "https://a.org/404")]
    df = spark.createDataFrame(rows, "page_id int, text string, html_chars long, old_chars long, final string").select("*", F.lit("https://a.org/jobs").alias("requested"), F.lit(False).alias("rendered"), F.lit(False).alias("exempt"))
    got = {r.page_id: r.error for r in P.floors(df.withColumn("final", F.when(F.col("final") == "u", F.col("requested")).otherwise(F.col("final")))).collect()}
    assert got == {1: "almost no text in its markup", 2: "7 characters of text: Blocked", 3: "lost most of its text", 4: "", 5: "redirected to an error page"}
    lines = "a array<string>, b array<string>"
    cases = [(["a"], ["No events available"]), (["No events available", "a"], ["No events available"]), (["a"], ["b"]), (["a"], ["There are no events like the positions we hold"])]
    cases += [(['{"jobs": [1,', "2]}"], ['{"jobs": []}']), (['{"jobs": [1]}'], ['{"error": "blocked"}']), (["[1, 2]"], ["[]"]), (["{x", "y"], ["{x"])]
    assert values(spark, P.shrink_exempt(F.col("a"), F.col("b")), cases, lines) == [True, False, False, False, True, False, True, False]


def test_page_changes(spark):
    old = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a"])], "page_id int, lines array<string>")
    many = ["a"] + [f"Freshman line {i}" for i in range(12)]
    new = spark.createDataFrame([(1, ["b", "a"]), (2, many), (3, ["a", "Freshman day"])], "page_id int, lines array<string>")
    got = {r.page_id: (r.key, r.discovery) for r in P.changes(old, new).collect()}
    assert got == {1: ("page changed: 1 added, 1 removed", False), 2: ("page changed: 12 added, 0 removed", False), 3: ("page changed: 1 added, 0 removed", True)}


def test_student_and_place_screens(spark):
    titles = [("Quant", "Intern"), ("International Sales", ""), ("Campus Recruiter", ""), ("Summer Analyst", None), (None, None)]
    assert values(spark, S.wanted_title(F.col("t"), F.col("k")), titles, "t string, k string") == [True, False, False, True, False]
    assert values(spark, S.at_home(F.col("x")), ["Bay Area Offices", "London, NYC", "London", "Shanghai", "", None, "Narnia"]) == [True, True, False, False, True, True, True]


def test_rule_out_rules(spark):
    open_ = ["Expected graduation November 2027 or later", "graduating December 2027 and beyond", "graduating after August 2027", "Summer 2027 internship", "graduating between December 2027 and June 2030", "open to rising sophomores, juniors and seniors", "pursuing a Bachelor's, Master's or PhD", "", None]
    assert values(spark, S.verdict(F.lit("Engineer"), F.col("x")), open_) == [None] * len(open_)
    said = [("graduating in 2027 or 2028", "graduation-window"), ("graduating in winter of 2028 or the spring of 2029", "graduation-window"), ("must have junior-level standing", "advanced-standing"), ("must be a rising senior", "advanced-standing"), ("Pursuing a Master's or Ph.D.", "graduate-only"), ("Must have graduated with honours", "already-graduated")]
    assert [v and v.rule for v in values(spark, S.verdict(F.lit("Engineer"), F.col("x")), [x for x, _ in said])] == [r for _, r in said]
    titles = ["Human Resources Intern", "Marketing Data Scientist Intern", "Engineer - Sophomore Intern", "Rising Sophomore Program"]
    assert [v and v.rule for v in values(spark, S.verdict(F.col("x"), F.lit("")), titles)] == ["out-of-field-title", None, "sophomore-title", None]


def test_cycle_and_days(spark):
    dates = [datetime.date(2026, 6, 30), datetime.date(2026, 7, 1)]
    assert values(spark, keys.cycle(F.col("x")), dates, "x date") == [2026, 2027]
    a, b = values(spark, keys.change_key(F.lit("s"), F.lit("k"), F.col("x")), dates, "x date")
    assert a != b
    assert values(spark, keys.days_until(F.col("x"), F.lit("2024-01-10").cast("date")), ["2024-01-12", "2024-01-01", "rolling", "2024-13-01", None]) == [2, -9, None, None, None]


def test_dedupe_and_mutes(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["x"], True), (2, ["x", "y"], False), (3, ["y"], True), (4, [], False), (5, [], False)], "row long, ids array<string>, is_aggregator boolean")
    got = {r.component: (r.winner, r.members) for r in I.winners(I.posting_groups(rows, f"{tmp_path}/c")).collect()}
    assert got == {1: (2, 3), 4: (4, 1), 5: (5, 1)}
    muted = F.array(F.lit("A"), F.lit("B"))
    assert values(spark, I.all_muted(F.col("x"), muted), ["A|C", "A| B", "", None]) == [False, True, False, False]


def test_suppression_reports_at_zero(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "added", "k", [], False, "A", "m")], "row long, source_id string, kind string, key string, ids array<string>, is_aggregator boolean, program_name string, mute_key string")
    none = spark.createDataFrame([], "name string, mute_key string")
    kept, reports = I.suppressed(rows, none.select("name"), none.select("mute_key"), f"{tmp_path}/s")
    assert kept.count() == 1 and sorted((r.filter_id, r.removed) for r in reports.collect()) == [("applied", 0), ("duplicate-posting", 0), ("muted", 0), ("removed-row", 0)]


def test_overlap_is_exact(spark):
    import random

    rng = random.Random(1)
    sets = [rng.sample("abcdefghij", rng.randint(0, 6)) for _ in range(40)]
    rows = spark.createDataFrame([(i, "b", s) for i, s in enumerate(sets)], "row long, block string, words array<string>")
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if sets[i] and sets[j] and len(set(sets[i]) & set(sets[j])) >= 0.75 * min(len(sets[i]), len(sets[j]))}
    assert {(r.a, r.b) for r in C.overlap_pairs(rows).collect()} == want


def test_rank(spark):
    col = R.rank(F.col("d"), F.lit("2024-01-10").cast("date"), F.col("r"), F.col("p"), F.col("c"), F.col("k"))
    cases = [("2024-01-12", False, False, True, "low"), ("2024-03-01", False, False, True, "low"), ("soon", False, False, True, "low"), ("", True, False, False, ""), ("", False, True, True, "high"), ("", False, True, False, "high"), ("Rolling", False, False, True, "low"), ("2024-01-01", False, False, True, "low")]
    got = [tuple(x) for x in values(spark, col, cases, "d string, r boolean, p boolean, c boolean, k string")]
    assert got == [("High", "closes Jan 12 (2 days)"), ("Medium", "closes Mar 1"), ("Medium", "no deadline stated"), ("High", "rolling firm, fills early"), ("High", "discovery programme"), ("Medium", "unverified"), ("Medium", "rolling, no close date"), ("Medium", "deadline passed")]


def test_fit_states_what_is_withheld(spark):
    rows = spark.createDataFrame([(i, 10, "g") for i in range(10)], "n int, length int, g string")
    for most, shown in ((1000, 10), (80, 3)):
        assert R.withheld(R.fitted(rows, ["n"], "length", ["g"], 10, 10, most), ["g"]).first()[1:] == (shown, 10 - shown)


def test_pins(spark):
    pins = spark.createDataFrame([(i, s, "c", "p", d, "2024-01-01", "2024-01-02") for i, s, d in (("gone", "a", ""), ("live", "a", ""), ("down", "b", ""), ("late", "b", "2024-01-01"))], "change_id string, source_id string, company string, position string, deadline string, first_pinned string, last_seen string")
    one = lambda *x: spark.createDataFrame(list(x), "source_id string, change_id string")
    checked = spark.createDataFrame([("a",)], "source_id string")
    live = PN.live_ids(one(("a", "gone"), ("b", "down")), one(("a", "live")), checked)
    assert sorted(tuple(r) for r in live.collect()) == [("a", "live"), ("b", "down")]
    got = {r.change_id: (r.first_pinned, r.last_seen) for r in PN.refreshed(pins, pins.where("change_id = 'live'"), live, checked, F.lit("2024-01-10").cast("date")).collect()}
    assert got == {"live": ("2024-01-01", "2024-01-10"), "down": ("2024-01-01", "2024-01-10")}


def test_covering_pages(spark):
    targets = spark.createDataFrame([("same", "https://a.org/x/y", ""), ("domain", "https://b.org/other", ""), ("named", "https://c.org", "p1"), ("dangling", "https://c.org", "zz")], "target_id string, url string, source_id string")
    watched = spark.createDataFrame([("p1", "http://www.a.org/x/y/", 1), ("p2", "https://b.org/jobs", 2)], "source_id string, url string, ord int")
    parts = PG.partitioned(targets.select("target_id", "url"), PG.covering(targets, watched))
    assert {r.target_id: r.why for r in parts.collect()} == {"same": "covered by p1", "domain": "", "named": "covered by p1", "dangling": "kept: names a source that is not there"}


def test_judgments_and_cost(spark):
    rows = spark.createDataFrame([(1, '{"relevant": false, "confidence": "High"}'), (2, "oops"), (3, None), (4, "{}")], "n int, body string")
    got = {r.n: (r.outcome, r.relevant, r.confidence) for r in J.parsed(rows).collect()}
    assert got == {1: ("model", False, "high"), 2: ("error", True, "low"), 3: ("error", True, "low"), 4: ("model", True, "low")}
    assert values(spark, J.cost(F.col("i"), F.col("c"), F.col("o"), F.col("a"), F.col("b")), [(1_000_000, 500_000, 100_000, 1.0, 10.0), (1, 0, 1, None, None)], "i long, c long, o long, a double, b double") == [pytest.approx(1.55), None]


def test_triage_keeps_what_was_not_judged_low(spark):
    c = spark.createDataFrame([("k", x) for x in "abcd"], "kind string, key string")
    j = spark.createDataFrame([("k", "a", "LOW "), ("k", "b", "lowish"), ("k", "c", None)], "kind string, key string, priority string")
    assert {r.key: r.status for r in PG.triaged(c, j).collect()} == {"a": "discarded", "b": "proposed", "c": "proposed", "d": "proposed"}


def test_batch_refused_for_any_problem(spark):
    have = spark.createDataFrame([("Acme", 4)], "name string, rank int")
    schema = "name string, url string, status string, by_agent boolean, ord int"
    good = [(" ACME", "https://a.org", "", False, 1), ("New", "https://n.org", "", True, 2), ("new ", "https://n.org", "", False, 3)]
    assert [(r.name, r["rank"]) for r in PG.added(have, spark.createDataFrame(good, schema)).collect()] == [("New", 5)]
    assert PG.added(have, spark.createDataFrame([*good, ("Bad", "x", "YES", True, 4)], schema)).count() == 0
