import os
import random

import numpy as np

from tidewatch.llm import exact_dedup
from tidewatch.llm import order_minhash as M
from tidewatch.llm.flat import mixed
from tidewatch.session import shared_folder

WORDS = [f"w{i}" for i in range(2000)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_edits():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        for most in (0, 1, 2, 5, 14):
            assert M.edits(a, b, most) == min(distance(a, b), most + 1), (a, b, most)


def test_labels_and_order_matter():
    a = mixed(np.arange(50, dtype=np.uint64))
    assert len(set(M.labelled(np.repeat(a[:1], 9)))) == 9
    assert (M.sketches(a) == M.sketches(a.copy())).all() and (M.sketches(a) != M.sketches(a[::-1].copy())).all()


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def test_classes(docs_of):
    rng = random.Random(10)
    base = [[rng.choice(WORDS) for _ in range(200)] for _ in range(6)]
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    texts, group = [], []
    for g, words in enumerate(base):
        for _ in range(5 + 30 * (g == 0)):
            texts.append(" ".join(edited(rng, words, rng.randint(0, 6))))
            group.append(g)
    for k in range(20):  # a passage in common makes no copies
        texts.append(" ".join(rng.choice(WORDS) for _ in range(150)) + " " + passage)
        group.append(100 + k)
    texts += [texts[0].upper() + "!", "", None, "one two", "One, two."]
    group += [0, 200, 200, 201, 201]
    got = {r.doc_id: r for r in M.near_classes(docs_of(texts)).collect()}
    for g in set(group):
        ids = [i for i, x in enumerate(group) if x == g]
        assert {got[i].class_id for i in ids} == {min(ids)}, g
        assert {got[i].class_size for i in ids} == {len(ids)} and sum(got[i]["first"] for i in ids) == 1


def test_long_text_empty_table_and_filter(docs_of):
    rng = random.Random(11)
    long = [rng.choice(WORDS) for _ in range(30_000)]
    docs = docs_of([" ".join(long), " ".join(edited(rng, long, 300)), "a", "a"], [5, 3, None, None])
    got = M.near_classes(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == [("3", "3", 2), ("5", "3", 2), ("None", "None", 2), ("None", "None", 2)]
    kept = M.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "None"]
    assert M.near_classes(docs_of([])).count() == 0


def test_bounds_keep_similar_texts():
    rng = random.Random(13)
    for _ in range(300):
        a = [rng.choice(WORDS) for _ in range(rng.randint(5, 120))]
        b = edited(rng, a, rng.randint(0, len(a) // 4))
        if M.similar(" ".join(a), " ".join(b)):
            x, y = (M.bit_map(mixed(np.array([int(w[1:]) for w in t], np.uint64))).view(np.uint64) for t in (a, b))
            assert max(np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()) <= len(a) // 5


def test_recall_at_the_link_test(docs_of):
    """Pairs of scattered edits up to the link test's own bound, against brute-force alignment."""
    rng = random.Random(14)
    texts = []
    for size in [10, 20, 40, 80, 150, 300] * 25:
        base = [rng.choice(WORDS) for _ in range(size)]
        texts += [" ".join(base), " ".join(edited(rng, base, rng.choice([size // 5, size // 8, size // 10])))]
    want = [i for i in range(0, len(texts), 2) if M.similar(texts[i], texts[i + 1])]
    got = {r.doc_id: r.class_id for r in M.near_classes(docs_of(texts)).collect()}
    assert len(want) > 140 and sum(got[i] == got[i + 1] for i in want) >= 0.99 * len(want)
    assert all(M.similar(texts[i], texts[got[i]]) for i in got)


def test_spent_tables_are_deleted(docs_of, tmp_path):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(60)] for _ in range(8)]
    docs = docs_of([" ".join(edited(rng, base[k % 8], k % 4)) for k in range(40)])
    folder = f"{tmp_path}/near"
    rows = M.near_classes(docs, folder=folder).collect()
    assert len(rows) == 40 and len({r.class_id for r in rows}) == 8
    left = {d for d, _, names in os.walk(folder) if any(x.endswith(".parquet") for x in names)}
    assert left == {f"{folder}/marked"}
    assert M.deduplicated(docs, folder=f"{tmp_path}/filter").count() == 8
    shared = shared_folder(docs.sparkSession).removeprefix("file://") + "/tidewatch"
    before = set(os.listdir(shared))
    assert exact_dedup.deduplicated(docs).count() + M.deduplicated(docs).count() > 8
    assert {x.split("-")[0] for x in set(os.listdir(shared)) - before} <= {"marks", "numbered"}


def test_wide_maps_settle_long_texts(spark):
    """Unlike long texts of common words, which the fixed map leaves open; pairs within the limit stay, also across widths."""
    rng = random.Random(15)
    number = lambda t: mixed(np.array([int(w[1:]) for w in t], np.uint64))
    texts, alike, unlike = [], [], []
    for size in [40, 70, 240, 250, 1000, 1030, 2500] * 6:
        base = [rng.choice(WORDS) for _ in range(size)]
        more = edited(rng, base, size // 12) + [rng.choice(WORDS) for _ in range(size // 12)]
        if M.similar(" ".join(base), " ".join(more)):
            alike.append((len(texts), len(texts) + 1))
        unlike.append((len(texts), len(texts) + 2))
        texts += [base, more, [rng.choice(WORDS) for _ in range(size)]]
    profiles = spark.createDataFrame([(k, len(t), M.wide_map(number(t)).tolist()) for k, t in enumerate(texts)], "node long, size long, wide array<long>")
    left = {tuple(r) for r in M.wide_open(spark.createDataFrame(alike + unlike, "a long, b long"), profiles, M.SIMILARITY).collect()}
    assert len(alike) > 36 and any(len(M.wide_map(number(texts[a]))) < len(M.wide_map(number(texts[b]))) for a, b in alike)
    assert left == set(alike)
    fixed = [[M.bit_map(number(texts[i])).view(np.uint64) for i in p] for p in unlike if len(texts[p[0]]) >= 1000]
    assert all(max(np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()) < 200 for x, y in fixed)


def test_bags_never_hide_a_similar_pair():
    rng = random.Random(16)
    number = lambda t: mixed(np.array([int(w[1:]) for w in t], np.uint64))
    for _ in range(300):
        a = [rng.choice(WORDS[:40]) for _ in range(rng.randint(1, 120))]
        b = edited(rng, a, rng.randint(0, len(a))) + [rng.choice(WORDS) for _ in range(rng.randint(0, 5))]
        lacks = len(np.setdiff1d(M.bag(number(b)), M.bag(number(a))))
        assert lacks <= M.edits(a, b, len(a) + len(b))
        assert lacks == sum((M.Counter(b) - M.Counter(a)).values())


def test_pairs_of_a_group_grow_with_its_size(docs_of, monkeypatch):
    """Texts with a passage in common and 23 % own words, which no class joins, and a chain of copies of copies."""
    rng, plain, made = random.Random(17), M.verified, []

    def verified(pairs, *rest):
        made[-1] += pairs.count()
        return plain(pairs, *rest)

    monkeypatch.setattr(M, "verified", verified)
    passage = [rng.choice(WORDS) for _ in range(230)]
    group = [passage + [f"own{k}x{i}" for i in range(70)] for k in range(160)]
    chain = [[rng.choice(WORDS) for _ in range(200)]]
    while len(chain) < 30:
        chain.append(edited(rng, chain[-1], 16))
    for size in (80, 160):
        made.append(0)
        texts = [" ".join(t) for t in chain + group[:size]]
        got = {r.doc_id: r.class_id for r in M.near_classes(docs_of(texts)).collect()}
        assert got == {i: 0 if i < len(chain) else i for i in range(len(texts))}
    assert made[1] < 2.5 * made[0], made
