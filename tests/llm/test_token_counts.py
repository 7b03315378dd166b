import pytest

from tidewatch.llm import token_counts as T

TEXTS = ["one two three", "", None, "", "<|endoftext|> as text <|endoftext|>", "é🙂 " * 50, "word " * 30_000, "one two three", ""]


@pytest.mark.parametrize("block", [1, 7, 1000, T.BLOCK_TOKENS])
def test_matches_encoding(docs_of, block):
    with open(T.VOCABULARY, "rb") as f:
        encode = T._encoding(f.read(), T.SPLIT).encode_ordinary
    texts = TEXTS if block > 7 else [t[:60] if t else t for t in TEXTS]
    got = T.token_counts(docs_of(texts), block_tokens=block).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len(encode(t or ""))) for i, t in enumerate(texts)]


def test_flat_files_decode_back(docs_of, spark, tmp_path):
    import numpy as np

    manifest = T.write_tokens(docs_of(TEXTS), f"file://{tmp_path}/t")
    files = manifest.where("place < 0").collect()
    with open(T.VOCABULARY, "rb") as f:
        decode = T._encoding(f.read(), T.SPLIT).decode
    texts = []
    for r in sorted(files, key=lambda r: r.file):
        ids = np.fromfile(r.file.removeprefix("file://"), "<u2")
        ends = np.flatnonzero(ids == 50256)
        texts += [decode(ids[a:b].tolist()) for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)] if len(ends) else []
    assert sorted(texts) == sorted(t or "" for t in TEXTS)


def test_empty_table_and_width(docs_of):
    assert T.token_counts(docs_of([])).count() == 0
    assert (T.id_type(50256), T.id_type(70000)) == ("<u2", "<u4")


def test_long_white_space_makes_the_same_tokens():
    with open(T.VOCABULARY, "rb") as f:
        encoding = T._encoding(f.read(), T.SPLIT)
    for space in (" ", "\n", "\t ", "\u3000", " \x85"):
        for n in (499, 500, 501, 3000):
            run = (space * n)[:n]
            for text in (run, f"a{run}", f"{run}b", f"a{run}b", f"a {run}9{run}.x", f"a{run}'s", f"{run}\x1c{run}b"):
                assert T.tokens_of(encoding, text) == encoding.encode_ordinary(text), (space, n, text[:3])
    assert len(T.tokens_of(encoding, "a" + " " * 1_000_000 + "b")) > 2
