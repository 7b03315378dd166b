import random
import re

import pytest

from tidewatch.llm import decontaminate as D

WORDS = [f"w{i}" for i in range(400)]


def brute(text, item, k=5):
    """Greedy tiling as its definition says: the longest unmarked match first, earliest in the document, then in the item."""
    doc, item = (re.findall(r"\w+", (x or "").lower()) for x in (text, item))
    a, b, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and not a[d + n] and not b[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < min(k, max(1, len(item))):
            return covered / len(item) if item else 0
        for x in range(n):
            a[d + x] = b[i + x] = True
        covered += n


@pytest.fixture
def items(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (30, 12, 20, 3)] + [None, ""]
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"), texts


def test_matches_brute_force(docs_of, items):
    rng = random.Random(8)
    bench, texts = items
    noise = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    w = texts[0].split()
    docs = [
        f"{noise(20)} {texts[0].upper()}, {noise(9)}", f"{noise(4)} {' '.join(w[15:])}! {noise(6)} {' '.join(w[:15])}", " ".join(w[:20]), " ".join(w[:24]) + " x", noise(300), None, "", texts[3],
        f"{texts[1]} {texts[2]}", f"x {texts[3]}", texts[3].rsplit(" ", 1)[0], " ".join(w[:8] * 5), ("- ".join(w[:10])) + " " + " ".join(w[5:30]), f"{noise(30000)} {texts[2]} {noise(10)}",
    ]
    got = {r.doc_id: r for r in D.contamination(docs_of(docs), bench).collect()}
    for i, t in enumerate(docs[:-1]):
        want = {k: c for k, x in enumerate(texts) if (c := brute(t, x)) >= D.COVERAGE}
        assert got[i]["items"] == sorted(want) and got[i].contaminated == bool(want), (i, got[i], want)
        assert got[i].coverage is None if not want else abs(got[i].coverage - max(want.values())) < 1e-9
    assert got[len(docs) - 1]["items"] == [2]


def test_blocks_and_empty_sides(docs_of, items, spark):
    bench, texts = items
    docs = docs_of([f"{texts[0]} {texts[1]}", "clean"])
    assert [(r.doc_id, r["items"]) for r in sorted(D.contamination(docs, bench, block_words=5).collect())] == [(0, [0, 1]), (1, [])]
    assert not any(r.contaminated for r in D.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect())
    assert D.contamination(docs_of([]), bench).count() == 0


def test_filter_keeps_columns(docs_of, items):
    bench, texts = items
    docs = docs_of([texts[0], "clean text", None])
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_repeated_words_of_a_very_long_text(docs_of, spark):
    bench = spark.createDataFrame([(0, "a " * 400), (1, "a b " * 200), (2, "b a " * 30 + "c d e f g " * 20)], "item_id long, text string")
    got = D.contamination(docs_of(["a " * 1_000_000, "b " + "a b " * 100_000, "a " * 399]), bench).collect()
    assert [r["items"] for r in sorted(got)] == [[0], [1], [0]]


def test_portions_make_the_same_matches(monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))) for k in range(30)]
    seeds = D.Seeds(items)
    hashes, _ = D.words(*(lambda x: (D.np.frombuffer(x.encode(), D.np.uint8), D.np.array([0, len(x)])))(" ".join(rng.choice("abc") for _ in range(400))))
    whole = seeds.covered(hashes, D.shingles(hashes, 5), 0.5)
    monkeypatch.setattr(D, "PAIRS", 7)
    assert seeds.covered(hashes, D.shingles(hashes, 5), 0.5) == whole and len(whole) > 3
