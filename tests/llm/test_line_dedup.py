import random

from tidewatch.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, n):
    for _ in range(n):
        k = rng.randrange(len(line))
        line = rng.choice([line[:k] + line[k + 1 :], line[:k] + rng.choice("abé") + line[k:], line[:k] + rng.choice("abé") + line[k + 1 :]])
    return line


def test_distance_is_exact_within_the_band(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(5, 20)))
        pairs.append((a, edited(rng, a, rng.randint(0, 4))))
    pairs += [(a * 8, edited(rng, a * 8, rng.randint(0, 4))) for a, _ in pairs[:60]]
    kept = [(i, -i, a, b) for i, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= 2]
    for r in L.distances(spark.createDataFrame(kept, "a long, b long, x string, y string"), 2).collect():
        d = distance(*pairs[r.a])
        assert r.edits == (d if d <= 2 else None), pairs[r.a]


def brute(texts, edits, per_edit):
    lines = [(i, n, x.strip(" \t\r")) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    nodes = list(dict.fromkeys(x[2] for x in lines))
    near = {x: [y for y in nodes if y != x and distance(x, y) <= min(edits, max(len(x), len(y)) // per_edit)] for x in nodes}
    root = {}
    for x in nodes:
        if x not in root:
            todo, seen = [x], {x}
            while todo:
                for y in near[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            root |= dict.fromkeys(seen, x)
    head = {}
    for i, n, x in lines:
        head.setdefault(root[x], (i, n))
    return sorted((i, n, len(near[x]), *head[root[x]], (i, n) == head[root[x]]) for i, n, x in lines)


def test_matches_brute_force(docs_of):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randint(5, 30))).strip() or "x" for _ in range(12)]
    texts = ["\n".join(edited(rng, rng.choice(base) + "z", rng.randint(0, 3)) for _ in range(rng.randint(1, 5))) for _ in range(25)]
    texts += ["", None, "\n\n \t\n", texts[0], "short\nshort\nshorn", "y" * 3000 + "\n" + "y" * 3001]
    got = L.line_classes(docs_of(texts), edits=2, per_edit=10).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, 2, 10)


def test_empty_table(docs_of):
    assert L.line_classes(docs_of([])).count() == 0


def test_keys_of_ascii_and_other_lines_meet(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(40)).strip() + "xy"
    lines = [base, base[:-1] + "é", "ü" + base[1:-1] + "é", base[:30] + base[31:], "é" * 12, "é" * 11]
    nodes = L.with_letters(spark.createDataFrame(list(enumerate(lines)), "node long, line string"))
    for r in nodes.collect():
        assert [r.letters >> 6 * (9 - k) & 63 for k in range(10)] == [r.line.count(x) for x in L.LETTERS]
    index = {(r.k, r.node) for r in L.keyed_parts(nodes, L.index_probes(2), 2).collect()}
    met = {frozenset((r.node, n)) for r in L.keyed_parts(nodes, L.search_probes(2), 2).collect() for k, n in index if k == r.k and n != r.node}
    want = {frozenset((a, b)) for a in range(6) for b in range(6) if a != b and distance(lines[a], lines[b]) <= 2}
    assert want and want <= met
    plan = L.keyed_parts(nodes, L.search_probes(2), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "UTF-32" not in plan


def test_only_lines_that_share_a_segment_are_counted(spark, tmp_path):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(100)]
    lines += [lines[0] + "x", "y" + lines[1][1:], lines[2][:30] + lines[2][31:], lines[3][:20] + lines[4][20:]]
    nodes = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    got = {frozenset((r.a, r.b)): r.edits for r in L.near_pairs(nodes, f"{tmp_path}/near").collect()}
    assert got == {frozenset((0, 100)): 1, frozenset((1, 101)): distance(lines[1], lines[101]), frozenset((2, 102)): 1}
    texts = spark.read.parquet(f"{tmp_path}/near/texts")
    assert "letters" in texts.columns
    assert set(range(3)) <= {r.node for r in texts.collect()} <= {0, 1, 2, 3, 4, 100, 101, 102, 103}


def test_what_lines_begin_and_end_with_is_not_aligned(spark):
    rng = random.Random(5)
    same = "".join(rng.choice("abé") for _ in range(9000))
    pairs = [(same + "x" + same[:3000], same + "yz" + same[:3000]), ("aaaa", "aaa"), ("abab" * 5, "ab" + "abab" * 5), ("", "a"), (same, "q" + same), (same[:50] + "bb" + same[:50], "a" + same[:50] + "bb" + same[:49])]
    rows = spark.createDataFrame([(i, -i, *x) for i, x in enumerate(pairs)], "a long, b long, x string, y string")
    want = {0: 2, 1: 1, 2: 2, 3: 1, 4: 1, 5: 2}
    assert {r.a: r.edits for r in L.distances(rows, 2).collect()} == want
    plan = L.distances(rows, 2)._jdf.queryExecution().analyzed().toString()
    assert plan.count("reverse(") >= 4
