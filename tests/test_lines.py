import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import lines as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def pages(spark, versions):
    rows = [(k, i, x) for k, v in enumerate(versions) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "page_id long, pos int, line string")


def check(spark, tmp_path, cases, exact=True):
    old, new = (pages(spark, [c[k] for c in cases]) for k in (0, 1))
    found = [(r.page_id, r.i, r.j) for r in L.common_lines(old, new, f"{tmp_path}/l").collect()]
    for k, (a, b) in enumerate(cases):
        pairs = sorted((i, j) for p, i, j in found if p == k)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        if exact:
            assert len(pairs) == lcs(a, b), (a, b)


def edited(rng, a, n):
    b = list(a)
    for _ in range(n):
        k = rng.randint(0, len(b))
        b[k : k + rng.randint(0, 3)] = [f"new {rng.randint(0, 50)}" for _ in range(rng.randint(0, 3))]
    return b


def test_equals_a_plain_subsequence(spark, tmp_path):
    rng = random.Random(1)
    cases = []
    for _ in range(40):
        a = [rng.choice([f"line {k}", "Apply", "More", f"s{k % 4}"]) for k in range(rng.randint(0, 60))]
        cases.append((a, edited(rng, a, rng.randint(0, 6))))
    check(spark, tmp_path, cases)


def test_repeated_lines_only(spark, tmp_path):
    rng = random.Random(2)
    cases = [([rng.choice("ab") * 2 for _ in range(rng.randint(2, 150))], [rng.choice("abc") * 2 for _ in range(rng.randint(2, 150))]) for _ in range(25)]
    cases += [(["x"] * 200, ["x"] * 130), (["x"] * 2, []), ([], ["x"] * 2), ([""] * 3, [""] * 2)]
    check(spark, tmp_path, cases)


def test_moved_lines_keep_the_heaviest_chain(spark, tmp_path):
    a = [f"l{k}" for k in range(40)]
    cases = [(a, a[20:] + a[:20]), (a, a[:5] + a[8:30] + a[5:8] + a[30:]), (a, a[::-1]), (a, a[10:30] + a[:10] + a[30:])]
    check(spark, tmp_path, cases)


def test_a_long_page(spark, tmp_path):
    rng = random.Random(3)
    a = [f"job {k} {rng.random()}" if k % 2 else "Apply now" for k in range(10_000)]
    b = edited(rng, a, 60)
    old, new = pages(spark, [a]), pages(spark, [b])
    rows = L.ordered_diff(old, new, f"{tmp_path}/long").collect()
    added, removed = (sorted((r.pos, r.line) for r in rows if r.kind == k) for k in ("added", "removed"))
    kept_a = [x for i, x in enumerate(a) if i not in {p for p, _ in removed}]
    kept_b = [x for i, x in enumerate(b) if i not in {p for p, _ in added}]
    assert kept_a == kept_b and len(added) < 300


@pytest.mark.parametrize("weights", [[(3, 1), (1, 5), (2, 1)], [(1, 1)], [(2, 4), (1, 3), (3, 1)]])
def test_heaviest_chain(spark, weights):
    got = spark.createDataFrame([(weights,)], "xs array<struct<r:bigint,w:bigint>>").select(L.heaviest_chain(F.col("xs")).alias("c")).first().c
    best = 0
    for m in range(1 << len(weights)):
        some = [weights[k] for k in range(len(weights)) if m >> k & 1]
        if all(x[0] < y[0] for x, y in zip(some, some[1:], strict=False)):
            best = max(best, sum(w for _, w in some))
    chosen = [weights[k] for k in sorted(got)]
    assert sum(w for _, w in chosen) == best and all(x[0] < y[0] for x, y in zip(chosen, chosen[1:], strict=False))
