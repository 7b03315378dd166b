import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidewatch.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, g string, place string, node string, arc string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + x[h:]
    members, saved, leaves, kids = defaultdict(list), {}, {}, defaultdict(set)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
            if d:
                kids[tuple(full[c][: d - 1])].add(tuple(full[c][:d]))
    for node in sorted(members, key=len, reverse=True):
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(full[c]) == len(node))
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def talks(spark, tmp_path):
    made = []

    def make(rows):
        made.append(f"{tmp_path}/c{len(made)}")
        spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).coalesce(2).write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    return make


def run(*args, **more):
    return sorted((tuple(r) for r in T.prefix_trie(*args, **more).collect()), key=str)


@pytest.mark.parametrize("folds", [(1024, 1 << 14), (2, 20)])
def test_matches_brute_force(talks, folds):
    rng = random.Random(7)
    rows = []
    for c in rng.sample(range(400), 150):
        for turn in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(["a", "bé", "", None])))
    rows += [(900, k, "user", f"long {k % 3}") for k in range(300)] + [(905, k, "user", f"long {k % 3}") for k in range(300)]
    rows += [(7001, None, "user", "first"), (7001, 0, "user", "x" * 300_000), (7001, 3, None, None)]
    rng.shuffle(rows)
    assert run(talks(rows), run=folds[0], last=folds[1]) == brute(rows)


def test_one_turn_shared_by_all(talks):
    rows = [(c, 0, "user", "hello") for c in range(200)] + [(c, 1, "bot", str(c)) for c in range(200)]
    assert run(talks(rows), last=30) == brute(rows)


def test_empty_null_and_repeated_rows(talks):
    assert run(talks([])) == []
    assert run(talks([(None, 0, "user", "a")])) == []
    rows = [(4, 0, "user", "a"), (4, 0, "user", "a"), (4, 0, "user", "b")]
    got = run(talks(rows))
    assert sum(1 for r in got if r[1] == 0) == 1 and max(r[1] for r in got) <= 3
