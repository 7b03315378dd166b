import hashlib
import re

from pyspark.sql import functions as F

from tidewatch.llm import secret_scan as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    "password = 'hunter22' and Token:abc and secret=abcdef, AKIA" + "A" * 16 + "AKIA1",
    "token=token: abcdefgh é secret: ünïcode " + "0123456789abcdef" * 2,
    "é🙂 API_KEY=abcdef123 apikey: x passwd=secret=abcdef " + "f" * 23 + " g" + "f" * 24,
    "", None, "no secrets", "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 12, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 40, "deadbeef" * 4000,
]


def brute(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_matches_brute_force(docs_of, tmp_path):
    texts = [*TEXTS, TEXTS[0], TEXTS[0]]
    got = S.scanned(docs_of(texts), f"{tmp_path}/ledger").toPandas()
    by = {r.doc_id: [(x["start"], x["k"], x["kind"], x["end"]) for x in r.found if x["k"] < 3] for r in got.itertuples()}
    assert by == {i: brute(t) for i, t in enumerate(texts)}
    assert {x["kind"] for r in got.itertuples() for x in r.found} == {"assign", "access", "hex", "pem", "grant"}


def test_scans_only_unseen_pairs(docs_of, spark, tmp_path):
    folder = f"{tmp_path}/ledger"
    S.scanned(docs_of(TEXTS), folder, increments=1).count()
    ledger = S.Ledger(spark, folder)
    first = ledger.scans().count()
    assert first == len({t or "" for t in TEXTS})
    S.scanned(docs_of([*TEXTS, "token = brandnew1"]), folder, increments=1).count()
    assert ledger.scans().count() == first + 1
    newer = [("assign", 2, *S.RULES[0][2:]), *S.RULES[1:]]  # a new version of one rule scans every blob once more, with that rule
    S.scanned(docs_of(TEXTS), folder, increments=1, rules=newer).count()
    assert ledger.scans().where(F.array_contains("rules", "assign:2")).where(F.size("rules") == 1).count() == first


def test_query_columns(spark, tmp_path, docs_of):
    docs_of(TEXTS, clashes=False).write.parquet(f"{tmp_path}/sf/documents.parquet")
    got = S.query(spark, f"{tmp_path}/sf").toPandas().set_index("doc_id")
    for i, t in enumerate(TEXTS):
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in brute(t))
        assert got.loc[i, "base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert got.loc[i, "n_hex"] == sum(k == 2 for _, k, _, _ in brute(t))


def test_empty_table(docs_of, tmp_path):
    assert S.scanned(docs_of([]), f"{tmp_path}/ledger").count() == 0
