import pandas as pd
import pytest

CLASHES = ["row_id", "digest", "shard", "key", "size", "line", "node", "words", "batch", "first", "kept", "n", "blob", "target"]


@pytest.fixture
def docs_of(spark, tmp_path):
    """A documents table on disk, with columns of clashing names."""

    made = []

    def make(texts, ids=None, lang=None, source=None, clashes=True):
        n = len(texts)
        pdf = pd.DataFrame({"doc_id": pd.array(list(range(n)) if ids is None else ids, "Int64"), "text": texts, "lang": lang or ["en"] * n, "source": source or ["s"] * n, "n_chars": pd.array([len(t or "") for t in texts], "Int64")})
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if clashes:
            for c in CLASHES:
                pdf[c] = "x"
                schema += f", {c} string"
        path = f"{tmp_path}/docs{len(made)}"
        made.append(path)
        rows = [tuple(None if x is pd.NA or x is None else x for x in r) for r in pdf.astype(object).itertuples(index=False)]
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return make
