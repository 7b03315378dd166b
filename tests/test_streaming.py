import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import health as HL
from tidewatch.operators import snapshot as SN
from tidewatch.streaming import diff, health

LOG = "source_id string, attempt_id long, ts timestamp, ok boolean, quarantined boolean"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def keyed_states(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, health.STATE_STORE)
    yield
    spark.conf.set(name, before)


def run_health(spark, tmp_path, batches, **options):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
    out = []

    def keep(batch, n):
        out.extend((n, r) for r in batch.collect())

    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")
    writer = health.source_health(stream, **options).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp")
    if options.get("timers", True):
        run, end = writer.start(), time.time() + 90
        while run.isActive and time.time() < end and len({n for n, _ in out}) < len(batches):
            time.sleep(0.5)
        run.stop()
    else:
        assert writer.trigger(availableNow=True).start().awaitTermination(120)
    return out


def test_any_order_gives_the_batch_answer(spark, tmp_path, keyed_states):
    rng = random.Random(4)
    rows = [(f"s{rng.randint(0, 3)}", k, T0 + timedelta(hours=k // 2), rng.random() < 0.3, rng.random() < 0.1) for k in range(120)]
    shuffled = rng.sample(rows, len(rows))
    out = run_health(spark, tmp_path, [shuffled[k::5] for k in range(5)], timers=False)
    last = {}
    for n, r in out:
        if r.kind == "state":
            last[r.source_id] = (n, r.failures, r.last_success, r.last_attempt)
    want = {r.source_id: (r.failures, r.last_success, r.last_attempt) for r in HL.failure_runs(spark.createDataFrame(rows, LOG)).collect()}
    assert {k: v[1:] for k, v in last.items()} == want
    assert not [r for _, r in out if r.kind == "late"]


def test_what_cannot_be_placed_is_counted(spark, tmp_path, keyed_states):
    fail = [("s", k, T0 + timedelta(hours=k), False, False) for k in range(1, 11)]
    late = [("s", 20, T0 + timedelta(hours=3, minutes=30), True, False)]
    early = [("s", 21, T0 + timedelta(hours=2, minutes=30), False, False)]
    new = [("s", 22, T0 + timedelta(hours=30), True, False)]
    out = run_health(spark, tmp_path, [fail, late, early, new], keep=4, timers=False)
    said = [(r.kind, r.failures, r.late, r.attempt_id) for _, r in out if r.kind != "retry"]
    assert said == [("state", 10, 0, None), ("state", 10, 1, None), ("late", 10, 1, 20), ("state", 11, 1, None), ("state", 0, 1, None)]


def test_the_end_of_a_backoff_comes_out(spark, tmp_path, keyed_states):
    fail = [("s", k, T0 + timedelta(hours=k), False, False) for k in range(4)] + [("t", 9, T0, True, False)]
    out = run_health(spark, tmp_path, [fail, [("t", 10, T0 + timedelta(hours=1), True, False)]])
    assert {(r.source_id, r.retry_after) for _, r in out if r.kind == "retry"} == {("s", T0 + timedelta(hours=3 + 12))}


ROWS = diff.SCHEMA


def versions(n):
    return [(f"s{k}", "a", f"k{i}", f"v{n if (k + i) % 3 == 0 else 0}", "") for k in range(30) for i in range(5)]


def stream(spark, tmp_path, folder, n, rows, checkpoint):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/v={n}")
    found = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in/v=*")
    diff.diff_stream(found, folder, checkpoint, buckets=16).awaitTermination(120)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    folder = f"{tmp_path}/base"
    stream(spark, tmp_path, folder, 0, versions(0), f"{tmp_path}/cp")
    first = files(f"{folder}/data")
    one = [("s3", "a", "k0", "new", ""), ("s3", "a", "k9", "v", "")]
    stream(spark, tmp_path, folder, 1, one, f"{tmp_path}/cp")
    assert len(files(f"{folder}/data") - first) == 1
    base = diff.Baseline(spark, folder, 16)
    manifest = base.manifest()
    assert sorted(manifest.values()).count(1) == 1
    got = sorted(tuple(r) for r in base.rows(manifest).collect())
    assert got == sorted([r for r in versions(0) if r[0] != "s3"] + one)
    changes = spark.read.parquet(f"{folder}/changes/version=1")
    old = spark.createDataFrame([r for r in versions(0) if r[0] == "s3"], ROWS)
    want = SN.diff(old, spark.createDataFrame(one, ROWS))
    assert sorted(map(str, changes.collect())) == sorted(map(str, want.collect()))
    base.vacuum(1)
    assert sorted(tuple(r) for r in base.rows(base.manifest()).collect()) == got


def test_a_retry_gives_equal_output(spark, tmp_path):
    folder = f"{tmp_path}/base"
    stream(spark, tmp_path, folder, 0, versions(0), f"{tmp_path}/cp")
    stream(spark, tmp_path, folder, 1, versions(1)[:40], f"{tmp_path}/cp")
    first = sorted(map(str, spark.read.parquet(f"{folder}/changes/version=1").collect()))
    before = sorted(map(str, diff.Baseline(spark, folder, 16).rows(diff.Baseline(spark, folder, 16).manifest()).collect()))
    # the batch's commit is lost, so the stream runs it again
    os.remove(f"{tmp_path}/cp/commits/1")
    for crc in (f"{tmp_path}/cp/commits/.1.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    found = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in/v=*")
    diff.diff_stream(found, folder, f"{tmp_path}/cp", buckets=16).awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(f"{folder}/changes/version=1").collect())) == first
    assert sorted(map(str, diff.Baseline(spark, folder, 16).rows(diff.Baseline(spark, folder, 16).manifest()).collect())) == before


def test_one_digest_a_date(spark, tmp_path):
    schema = "date string, body string"
    for n, rows in enumerate([[("d1", "b"), ("d1", "a")], [("d1", "c"), ("d2", "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/v={n}")
        found = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/v=*")
        diff.deliver_once(found, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/delivered").select("date", "body", F.col("batch")).collect()
    assert sorted(map(tuple, got)) == [("d1", "a", 0), ("d2", "x", 1)]


def test_stream_diff_without_broadcast_joins(spark, tmp_path):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        for n in range(2):
            spark.createDataFrame(versions(n), ROWS).write.parquet(f"{tmp_path}/in/v={n}")
            stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in/v=*")
            assert diff.diff_stream(stream, f"{tmp_path}/base", f"{tmp_path}/cp", buckets=8).awaitTermination(120)
        got = {r.change_id for r in spark.read.parquet(f"{tmp_path}/base/changes/version=1").collect()}
    finally:
        spark.conf.set(name, before)
    old, new = (spark.createDataFrame(versions(n), ROWS) for n in range(2))
    want = {r.change_id for r in SN.diff(old, new).collect()}
    assert got == want and want


class FakeState:
    """A processor's states in memory; counts the calls to them."""

    def __init__(self):
        self.value, self.items, self.calls = None, [], 0

    def getValueState(self, *_):
        return Held(self, "value")

    def getListState(self, *_):
        return Held(self, "items")


class Held:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def get(self):
        self.state.calls += 1
        return getattr(self.state, self.name)

    def update(self, new):
        self.state.calls += 1
        setattr(self.state, self.name, new)

    put = update

    def clear(self):
        self.update([])


def test_a_source_of_a_batch_is_cheap():
    rng, state = random.Random(8), FakeState()
    one = health.Health(timers=False)
    one.init(state)
    at = [None if k % 50 == 0 else k // 2 * health.HOUR for k in range(1, 201)]
    log = [dict(attempt_id=k, ts=t, ok=rng.choice([True, False, False, None]) and t is not None, quarantined=rng.choice([True, False, None])) for k, t in enumerate(at, 1)]
    rng.shuffle(log)
    for a in range(0, 200, 20):
        (last,) = one.handleInputRows(("s",), iter(log[a : a + 20]), None)
    tried = [((-1 if r["ts"] is None else r["ts"]), r["attempt_id"], r["ok"]) for r in log if not r["quarantined"]]
    good = max(x[:2] for x in tried if x[2])
    want = (sum(not x[2] and x[:2] > good for x in tried), good[0], max(x[0] for x in tried))
    assert (last["failures"], last["last_success"], last["last_attempt"]) == want
    good_only = [dict(attempt_id=1, ts=health.HOUR, ok=True, quarantined=False)]
    began, calls = time.process_time(), 0
    for _ in range(2000):
        state = FakeState()
        one.init(state)
        list(one.handleInputRows(("s",), iter(good_only), None))
        calls = max(calls, state.calls)
    # one read and one write, and no data frame for each source
    assert calls == 2 and time.process_time() - began < 1
