import hashlib
import random
import re

from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup as E


def brute(texts, ids):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    out = []
    for i, x in enumerate(norm):
        group = [j for j in range(len(texts)) if norm[j] == x]
        best = min(group, key=lambda j: (-len(texts[j] or ""), ids[j] is None, ids[j] if ids[j] is not None else 0))
        out.append((ids[i], ids[best], len(group), hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(docs_of):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \t\né ") for _ in range(rng.randint(0, 5))) for _ in range(200)] + [None, "", "x" * 100_000, "x " * 100_000]
    ids = [*range(len(texts) - 3), -5, None, 2**62]
    got = E.exact_groups(docs_of(texts, ids)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(texts, ids)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_repeated_rows_keep_one(docs_of):
    docs = docs_of(["a b", "a b", "ab"], [7, 7, 3], clashes=False)
    assert E.deduplicated(docs).select("doc_id", "text").collect() == [(7, "a b")]
    assert E.deduplicated(docs).columns == docs.columns


def test_history_and_empty_tables(docs_of):
    docs = docs_of(["a", "b", "a ", "c", "c"])
    for history in (F.lit(True), F.lit(False), F.col("doc_id") < 2):
        got = E.exact_groups(docs, history).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(0, 2, 2), (1, 1, 1), (2, 2, 2), (3, 3, 2), (4, 3, 2)]
    assert E.exact_groups(docs_of([])).count() == 0


def test_hash_is_minimal_and_perfect():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    levels, slots = E.build_levels(digests)
    assert sorted(slots) == list(range(5000))
    assert (E.slot_of(levels, digests) == slots).all()
    others = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(1000)]
    assert all(s == -1 or digests[list(slots).index(s)] != o for s, o in zip(E.slot_of(levels, others), others, strict=True))
