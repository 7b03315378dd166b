import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i // 8 * 8
        out.append((nodes[a:i], nodes[i + 1 : a + 8]))
        i //= 8
    return out


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded root of rows (doc_id, source, lang, n_chars, text)."""
    null_first = lambda x: (x is not None, x if x is not None else 0)
    by = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if changed else r[4]
        by[r[2]].append((null_first(r[0]), H(*map(field, r)), H(*map(field, (*r[:4], text))), r[0]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf for _, leaf, _, _ in sorted(by[x], key=lambda t: t[:2])]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, leaf, alt, doc) in enumerate(sorted(by[x], key=lambda t: t[:2])):
            steps = path(trees[x], i) + path(top, k)
            h = alt
            for left, right in steps:
                h = H(*left, h, *right)
            out.append((doc, leaf, trees[x][-1][0], top[-1][0], H(*[y for left, right in steps for y in left + right]), h, h == top[-1][0]))
    return sorted(out, key=str)


def run(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = M.verified(M.manifest(docs, tampered)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_matches_brute_force(docs_of, monkeypatch, digits):
    monkeypatch.setattr(M, "DIGITS", digits)
    rng = random.Random(digits)
    n = 600
    langs = ["en"] * 530 + ["fr"] * 8 + ["de"] * 9 + ["es"] + ["é"] * 12 + ["zz"] * 40
    texts = [rng.choice([None, "", "A b", "é Ü X", "Aa " * rng.randint(0, 50)]) for _ in range(n)]
    ids = rng.sample(range(-5, 10_000), n)
    docs = docs_of(texts, ids, lang=langs[:n])
    assert run(docs) == brute(rows_of(docs))


def test_full_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(M, "DIGITS", 1)
    for n in (1, 7, 8, 9, 64, 65):
        docs = docs_of([f"T{i}" for i in range(n)], clashes=False)
        assert run(docs) == brute(rows_of(docs))


def test_nulls_repeats_long_and_empty(docs_of):
    docs = docs_of([None, "x", "x", "Long " * 200_000, "y"], [None, 7, 7, 3, None], lang=[None, "en", "en", None, "en"])
    got = run(docs)
    assert got == brute(rows_of(docs)) and len(got) == 5
    assert M.manifest(docs_of([])).count() == 0


def test_a_changed_row_is_found(docs_of):
    docs = docs_of([f"Doc {i}" for i in range(20)])
    rows = M.verified(M.manifest(docs, F.col("doc_id") == 5)).collect()
    assert [r.doc_id for r in rows if not r.verified] == [5]
