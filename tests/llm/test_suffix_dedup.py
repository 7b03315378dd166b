import hashlib
import random

import numpy as np
import pytest

from tidewatch.llm import suffix_dedup as S


def brute(texts, match):
    seen, out = {}, []
    for t in texts:
        for p in range(len(t) - match + 1):
            seen[t[p : p + match]] = seen.get(t[p : p + match], 0) + 1
    for t in texts:
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - match + 1):
            if seen[t[p : p + match]] > 1:
                mask[p : p + match] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        out.append((len(t), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 300))) for _ in range(10)]
    out = ["".join(rng.choice(base)[rng.randint(0, 100) :][: rng.randint(0, 250)] for _ in range(rng.randint(0, 4))) for _ in range(80)]
    return [*out, "a" * 500, "ab" * 200, "", None, "a" * 61, *out[:3]]


@pytest.mark.parametrize(("batches", "group_runs"), [(1, 2000), (4, 2000), (5, 1)])
def test_matches_brute_force(docs_of, batches, group_runs):
    got = S.substring_deduplicated(docs_of(texts()), match=60, seed=20, batches=batches, group_runs=group_runs).toPandas().sort_values("doc_id")
    assert [(r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got.itertuples()] == brute([(t or "").encode() for t in texts()], 60)


def test_long_document_in_pieces(docs_of):
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(900))
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000)) + part + "x" * 50 + part
    got = S.substring_deduplicated(docs_of([long, part[100:500]]), match=60, seed=20, piece=700).toPandas().sort_values("doc_id")
    assert [(r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got.itertuples()] == brute([long.encode(), part[100:500].encode()], 60)


def test_empty_table_and_levels(docs_of, spark, tmp_path):
    assert S.substring_deduplicated(docs_of([])).count() == 0
    family = S.Family(spark, f"{tmp_path}/family")
    schema = "head long, suffix long, run long"
    for k in range(5):
        family.insert(spark.createDataFrame([(k, k, 1), (9, 9, k)], schema))
    assert sorted(family.levels) == [0, 2]  # five batches: one of four and one of one
    assert [(r.suffix, r.contested) for r in family.repeats().collect()] == [(9, True)]


def test_bad_parameters(docs_of):
    with pytest.raises(ValueError):
        S.substring_deduplicated(docs_of(["a"]), match=10, seed=20)
