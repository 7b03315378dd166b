"""The pipeline against plain versions of its stages, each on its own input."""

import random

import corpus_pipeline as P
import pandas as pd
import pytest

from tests.llm.test_decontaminate import brute as tiled
from tests.llm.test_mixing import brute_targets
from tidewatch.llm import kneser_ney as K
from tidewatch.llm import order_minhash as M


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.randint(20, 150)) for _ in range(80)]
    items = [text(25) for _ in range(4)]
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1], " ".join(w if i != 9 else "zzz" for i, w in enumerate(texts[2].split()))]
    texts += [f"{text(30)} {items[0]} {text(10)}", items[2], "%%%!!! " * 40, "QQQ@@@" * 50, "", None]
    docs = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, items


def test_stages_and_run(spark, tables, tmp_path):
    folder, rows, items = tables
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        assert k == len(P.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    by_id = {r[0]: r for r in rows}
    everything = set(by_id)
    marks = K.classified(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert kept[0] == {r.doc_id for r in marks if r.kept} and everything - kept[0] >= {86, 87, 88, 89} and len(kept[0] & set(range(84))) >= 82
    groups = {}
    for i in kept[0]:
        groups.setdefault("".join(by_id[i][1].split()), []).append(i)
    assert kept[1] == {min(g, key=lambda i: (-len(by_id[i][1]), i)) for g in groups.values()}
    left = sorted(kept[1])
    root = {i: i for i in left}
    for a in left:
        for b in left:
            if a < b and M.similar(by_id[a][1].lower(), by_id[b][1].lower()):
                root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
    assert kept[2] == set(root.values())
    assert kept[3] == {i for i in kept[2] if all(tiled(by_id[i][1], x) < 0.8 for x in items)} and not kept[3] & {84, 85}
    assert kept[4] == kept[3]
    mix = docs.toPandas()
    size = {}
    for i in kept[3]:
        size[by_id[i][3]] = size.get(by_id[i][3], 0) + len(by_id[i][1].split())
    want = brute_targets(size)
    for r in mix.itertuples():
        assert abs(r.target - want[by_id[r.doc_id][3]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    again = P.run(spark, folder).toPandas()
    pd.testing.assert_frame_equal(*(x.sort_values("doc_id", ignore_index=True) for x in (mix, again)))


def written(spark, folder, docs, clashes=True):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = ["row_id", "digest", "node", "size", "target", "kept", "first", "words"] if clashes else []
    rows = [(*d, *["x"] * len(more)) for d in docs]
    spark.createDataFrame(rows, schema + "".join(f", {c} string" for c in more)).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d[0], 1, 0) for d in docs if d[0] is not None], "doc_id long, quality int, toxic int").distinct().write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_an_empty_table(spark, tmp_path):
    written(spark, str(tmp_path), [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_repeated_rows_and_a_long_text(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(60), "en", "s", 1) for i in range(60)]
    docs += [docs[3], docs[3], (None, docs[4][1], None, None, None), (500, text(120_000), "en", "t", 1)]
    written(spark, str(tmp_path), docs)
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, source, str(tmp_path)).columns == source.columns
    got = [r.doc_id for r in P.run(spark, str(tmp_path)).collect()]
    # equal rows leave one, and of equal texts the one that names an id stays
    assert len(got) == len(set(got)) and 3 in got and 500 in got and None not in got and len(set(got) & set(range(60))) >= 58
