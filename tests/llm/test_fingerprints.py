import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import fingerprints as P


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def prints(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.p for r in rows.withColumn("p", P.fingerprint(F.col("text"))).orderBy("i").collect()]


def test_bins_densify_and_pack_as_plain_code_does(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(n)) for n in (1, 4, 5, 6, 30, 400, 3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i")
    hashes = [r.h for r in rows.select(P.shingle_hashes(F.col("text")).alias("h")).collect()]
    assert [len(set(h)) for h in hashes] == [len(shingles(t)) for t in texts]
    probes = [list(r) for r in spark.range(P.BINS).select(*[F.pmod(F.xxhash64(F.lit(t), F.col("id").cast("int")), F.lit(P.BINS)) for t in range(P.PROBES)]).orderBy("id").collect()]
    pairs = {(r.i, r.j): r.h >> P.KEPT for r in spark.range(P.BINS).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(P.BINS).select(F.col("id").alias("j"))).select("i", "j", F.xxhash64("i", "j").alias("h")).collect()}
    kept = (1 << P.KEPT) - 1
    for h, got in zip(hashes, prints(spark, texts), strict=True):
        bins = [None] * P.BINS
        for x in h:
            k = (x >> 64 - P.BIN_BITS) + P.BINS // 2
            bins[k] = x if bins[k] is None else min(bins[k], x)
        held = [k for k in range(P.BINS) if bins[k] is not None]
        full = [bins[next((p for p in [i, *probes[i]] if bins[p] is not None), None) or 0] if any(bins[p] is not None for p in [i, *probes[i]]) else bins[min(held, key=lambda j: pairs[i, j])] for i in range(P.BINS)]
        again = spark.createDataFrame([(x & kept, i) for i, x in enumerate(full)], "v long, i int")
        low = [r.h & (1 << P.BITS) - 1 for r in again.select("i", F.xxhash64("v", "i").alias("h")).orderBy("i").collect()]
        want = [sum(low[j * P.PER_WORD + k] << P.BITS * k for k in range(P.PER_WORD)) for j in range(P.BINS // P.PER_WORD)]
        assert [x % (1 << 64) for x in got] == want


def test_likeness_is_near_the_exact_one(spark):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randint(0, 10**6))
    pairs = []
    for n in (6, 20, 100, 600, 3000):
        for share in (0.0, 0.05, 0.3, 0.7, 1.0):
            a = [word() for _ in range(n)]
            b = a[: int(n * share)] + [word() for _ in range(n - int(n * share))]
            pairs.append((" ".join(a), " ".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("x", P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("b")))).collect()
    errors = [r.x - jaccard(r.a, r.b) for r in rows]
    assert max(map(abs, errors)) < 0.13 and abs(sum(errors) / len(errors)) < 0.02


def test_empty_equal_and_short_texts(spark):
    texts = [None, "", " \t\n", "a", "a ", "a b c d", "a b c d e", "A b c d e", "a b  c\td e"]
    p = prints(spark, texts)
    assert p[0] == p[1] == p[2] == [] and p[3] == p[4] != p[5] and p[6] == p[8] != p[7]
    rows = spark.createDataFrame([([], []), ([], p[3]), (p[3], p[3])], "a array<long>, b array<long>")
    assert [r.x for r in rows.select(P.likeness(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 1.0]


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_every_row_meets_the_next(docs_of, block):
    rng = random.Random(block)
    ids = [None, *rng.sample(range(-1000, 1000), 120), 5000, 5000]
    texts = [f"text {i} é" * rng.randint(0, 3) for i in range(len(ids))]
    rows = P.fingerprinted(docs_of(texts, ids), block).collect()
    order = sorted(rows, key=lambda r: (r.key, r.row_id))
    assert len(rows) == len(ids)
    assert [r.next_text for r in order] == [order[(k + 1) % len(order)].text for k in range(len(order))]
    assert all(r.next_print == order[(k + 1) % len(order)].print for k, r in enumerate(order))


def test_query_columns(docs_of, spark, tmp_path):
    texts = ["Ünï " * 10, None, "b", "x " * 200_000, ""]
    docs_of(texts, [3, 1, 2, 9, 4], clashes=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in P.query(spark, str(tmp_path)).collect()}
    by = dict(zip([3, 1, 2, 9, 4], [t or "" for t in texts], strict=True))
    order = sorted(by)
    for k, d in enumerate(order):
        t, after, half = by[d], by[order[(k + 1) % 5]], len(by[d]) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(got[d].near_edited - jaccard(t, edited)) < 0.15
    docs_of([], clashes=False).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.query(spark, f"{tmp_path}/none").count() == 0
