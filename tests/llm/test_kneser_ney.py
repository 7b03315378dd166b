import math
import random
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import kneser_ney as K


def brute(trusted, texts, order):
    """The same model from dictionaries."""
    pad = bytes([10]) * (order - 1)
    counts = {order: Counter()}
    for t in trusted:
        data = pad + t.encode()
        counts[order].update(data[i : i + order] for i in range(len(data) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut, total, spare = {}, {}, {}
    for n in counts:
        few = Counter(counts[n].values())
        cut[n] = K.discounts([few[k] for k in (1, 2, 3, 4)])
        total[n], spare[n] = defaultdict(int), defaultdict(float)
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            spare[n][g[:-1]] += cut[n][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        n = len(g)
        if g[:-1] not in total[n]:
            return p(g[1:])
        c = counts[n][g]
        own = c - cut[n][min(c, 3) - 1] if c else 0
        return (own + spare[n][g[:-1]] * p(g[1:])) / total[n][g[:-1]]

    out = []
    for t in texts:
        data = pad + (t or "").encode()
        logs = [math.log(p(data[i : i + order])) for i in range(len(data) - order + 1)]
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out


@pytest.fixture
def corpus(spark):
    rng = random.Random(12)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "été"]) for _ in range(rng.randint(3, 40))) for _ in range(60)]
    junk = ["".join(rng.choice("XQZ#%!7") for _ in range(rng.randint(20, 200))) for _ in range(15)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(0, 1, 0), (41, 1, 1), (60, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return [*good, *junk, "", None], labels


@pytest.mark.parametrize("order", [2, 4])
def test_perplexity_and_worst_passage(docs_of, corpus, tmp_path, order, monkeypatch):
    texts, labels = corpus
    texts = [*texts, texts[3] * 300]
    want = brute(texts[:40], texts, order)
    got = {r.doc_id: r for r in K.scored(docs_of(texts), labels, f"{tmp_path}/whole", order=order).collect()}
    monkeypatch.setattr(K, "BLOCK_BYTES", 500)
    monkeypatch.setattr(K, "HELD_GRAMS", 100)
    small = {r.doc_id: r for r in K.scored(docs_of(texts), labels, f"{tmp_path}/blocks", order=order).collect()}
    assert len(got) == len(small) == len(texts)
    for i, x in enumerate(want):
        if x is None:
            assert got[i].perplexity is None and small[i].perplexity is None
        else:
            assert abs(got[i].perplexity - x) < 1e-4 * x and abs(small[i].perplexity - x) < 1e-4 * x, (i, x)
            assert abs(got[i].worst - small[i].worst) < 1e-4


def test_junk_goes_and_clean_text_stays(docs_of, corpus):
    texts, labels = corpus
    lang = ["en" if i % 2 else None for i in range(len(texts))]
    got = {r.doc_id: r for r in K.classified(docs_of(texts, lang=lang), labels).collect()}
    assert len(got) == len(texts)
    assert sum(got[i].kept for i in range(60)) >= 58 and not any(got[i].kept for i in range(60, len(texts)))
    docs = docs_of(texts)
    assert K.filtered(docs, labels).columns == docs.columns


def test_probabilities_sum_to_one(docs_of, corpus, tmp_path):
    texts, labels = corpus
    docs = docs_of(texts)
    probs, backs = K.train(docs.select("text").limit(30), f"{tmp_path}/m", 3)
    contexts = [a << 8 | b for a, b in (b"th", b"e ", b"zz", b"\n\n", b"\xff\x00")]
    every = docs.sparkSession.createDataFrame([(c << 8 | x,) for c in contexts for x in range(256)], "gram long")
    sums = {c: 0.0 for c in contexts}
    for r in K.resolved(every, probs, backs).collect():
        sums[r.gram >> 8] += math.exp(r.logp)
    assert all(abs(x - 1) < 1e-4 for x in sums.values())


def test_without_labels_or_rows(docs_of, corpus, spark):
    texts, labels = corpus
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in K.classified(docs_of(["a b", "", None]), none).collect()} == {0: True, 1: False, 2: False}
    assert K.classified(docs_of([]), labels).count() == 0


def test_toxic_words_in_clean_prose_go(docs_of, spark, tmp_path):
    """A few abusive words hardly move the mean of a long text; its worst passage shows them."""
    rng = random.Random(13)
    parts = ["th", "er", "an", "en", "re", "on", "st", "ing", "ed", "at"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(250)) for _ in range(160)]
    for i in range(140, 160):
        words = texts[i].split()
        words[rng.randrange(250)] = rng.choice(["idiot", "moron", "scum"])
        texts[i] = " ".join(words)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(i, 1, 1) for i in range(140, 160)], "doc_id long, quality int, toxic int")
    docs = docs_of(texts)
    got = {r.doc_id: r.kept for r in K.classified(docs, labels).collect()}
    assert sum(got[i] for i in range(140)) >= 137 and not any(got[i] for i in range(140, 160))


def test_training_and_lookup_take_few_tasks(spark, docs_of, corpus, tmp_path):
    """Shuffles of 40 partitions: tables of one and two bytes and counts of counts aren't dealt over all of them, so the driver has fewer tasks to keep."""
    texts, _ = corpus
    docs, tracker = docs_of(texts), spark.sparkContext.statusTracker()
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(x) for x in names]
    try:
        for x, value in zip(names, ("40", "false"), strict=True):
            spark.conf.set(x, value)
        spark.sparkContext.setJobGroup("kneser-ney-tasks", "")
        probs, backs = K.train(docs.select("text"), f"{tmp_path}/m", 4)
        wanted = K.gram_counts(docs.select("text")).select("gram")
        assert K.resolved(wanted, probs, backs).where("logp IS NULL").count() == 0 < wanted.count()
        stages = {s for j in tracker.getJobIdsForGroup("kneser-ney-tasks") for s in tracker.getJobInfo(j).stageIds}
        assert sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks) < 600
    finally:
        for x, value in zip(names, before, strict=True):
            spark.conf.set(x, value)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
