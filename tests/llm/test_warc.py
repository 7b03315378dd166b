import base64
import gzip
import hashlib

import pytest

from tidewatch.llm import warc as W


@pytest.fixture
def pages(spark, tmp_path):
    rows = [(i, f"https://www.h{i % 3}.example.org/p/{i % 7}?q=é {i}#x", ["same", f"own {i}", "", None, "é" * 5000 + "\r\n\r\nWARC/1.0\r\n"][i % 5], "x") for i in range(60)]
    rows += [(None, None, "same", "x"), (59, "not a url\n", "own 59", "x"), (59, "http://[bad/", "own 59", "x"), (-3, "", "same", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, key string").coalesce(3).write.parquet(f"{tmp_path}/pages.parquet")
    return rows, spark.read.parquet(f"{tmp_path}/pages.parquet")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(pages, least):
    rows, df = pages
    got = W.archived(df, least=least).collect()
    best, n = {}, {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        best[data] = max(best.get(data, -(10**9)), page if page is not None else -(10**9))
        n[data] = n.get(data, 0) + 1
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = len(data) >= least and page != best[data]
        want.append((page, len(data), digest, "revisit" if again else "response", best[data] if again else None))
    # rows repeated in full: one is the response, the others revisit it
    digest = next(w[2] for w in want if w[0] == 59 and w[1] == 6)
    want = [w for w in want if not (w[0] == 59 and w[2] == digest)] + [(59, 6, digest, "response", None)] + [(59, 6, digest, "revisit", 59)] * (n[b"own 59"] - 1 if b"own 59" in n else 0)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_members_index_and_keys(pages, tmp_path):
    _, df = pages
    folder = f"file://{tmp_path}/w"
    records = W.write_archives(df, folder)
    directory = W.build_index(records, folder, block_lines=4)
    assert directory.count() >= 16
    r = records.where("page_id = 1").first()
    with open(r.file.removeprefix("file://"), "rb") as f:
        f.seek(r.offset)
        got = W.parsed(gzip.decompress(f.read(r.length)))
    assert got["payload"] == b"own 1" and got["headers"]["WARC-Target-URI"].endswith("q=é%201#x")
    missing = df.sparkSession.createDataFrame([(1, "zzz nothing"), (2, "")], "row_id long, line string")
    assert W.located(missing, directory).count() == 0
    assert W.surt("https://www.B.a.org:80/x?y#z") == "org,a,b)/x?y" and W.surt(None) == "" and W.surt("http://[bad/") == "http://[bad/"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none")
    assert W.archived(spark.read.parquet(f"{tmp_path}/none")).count() == 0
