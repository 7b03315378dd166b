import random
from itertools import product

import numpy as np

from tidewatch.llm import mixing as M


def brute_targets(sizes, weights=(3, 1, 2), epochs=1.5, cap=2.0):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, out = epochs * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def texts_of(rng, n):
    return [" ".join("w" for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_targets_and_taken(docs_of):
    rng = random.Random(6)
    texts = [*texts_of(rng, 400), None, "", "a\x0bb\tc", "é" * 50_000]
    source = [rng.choice(["a", "b", "B", "c", None, "hot", "hot", "hot"]) for _ in texts]
    docs = docs_of(texts, source=source)
    got = M.mixed(docs).collect()
    again = M.mixed(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {}
    for t, s in zip(texts, source, strict=True):
        size[s] = size.get(s, 0) + len((t or "").replace("\x0b", " ").split())
    want = brute_targets(size)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in size:
        assert want[s] - 3 < taken[s] <= want[s] + 1e-6


def test_fit_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 15, rng.integers(1, 5)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 2))
        taken = M.fit(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        best = max(s for c in product(*[range(n + 1) for n in counts]) if (s := int((lengths * c).sum())) <= budget)
        assert (lengths * taken).sum() == best


def test_lengths_are_taken_alike():
    for each in (1, 3):
        lengths, counts = np.arange(1, 3001), np.full(3000, each)
        budget = int((lengths * counts).sum()) // 2
        shares = np.zeros(3)
        for seed in range(10):
            taken = M.fit(lengths, counts, budget, seed)
            assert (lengths * taken).sum() == budget and (taken <= counts).all() and (taken >= 0).all()
            shares += taken.reshape(3, 1000).sum(1) / counts.reshape(3, 1000).sum(1) / 10
        assert (abs(shares - 0.5) < 0.03).all(), shares


def test_empty_tables(docs_of):
    assert M.mixed(docs_of([])).count() == 0
    assert [r.taken for r in M.mixed(docs_of(["", None])).collect()] == [0, 0]
