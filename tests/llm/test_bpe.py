"""BPE coding against the tokenizers library on whole texts."""

import hashlib

import duckdb
import numpy as np
import pytest

from arborquill.llm import bpe

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "a", "ab  cd", "tab\tand\x0bvertical\x0c\r\n", "naïve café", "😀 zero​width", " nbsp em", "[UNK] [CLS] <s> </s> <|endoftext|>", "x" * 5000, "word " * 20000, "é combining", "中文 字符", "\x1c\x1d\x1e\x1f unit", "\x85 next", "UPPER lower 123 4,567.89"]


@pytest.fixture(scope="module")
def rows():
    real = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 300").fetchall()]
    return list(enumerate(ODD + real + ODD[:3]))


def test_as_the_library(spark, rows):
    tokenizer = bpe.load(bpe.default_path())
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "text AS n_tokens").repartition(4)
    digests = {r["doc_id"]: r for r in bpe.bpe_digests(frame).collect()}
    coded = bpe.encode_bpe(frame)
    ids = {r["doc_id"]: r["ids"] for r in coded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_bpe(coded).collect()}
    assert len(digests) == len(rows)
    for i, text in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        plain = tokenizer.decode(want, skip_special_tokens=False)
        assert ids[i] == want, text
        assert back[i] == plain, text
        r = digests[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()), text


def test_ids_that_are_no_pieces(spark):
    frame = spark.createDataFrame([(1, [5, 10**8, -1, 6]), (2, None), (3, [])], "doc_id long, ids array<int>")
    tokenizer = bpe.load(bpe.default_path())
    back = {r["doc_id"]: r["text"] for r in bpe.decode_bpe(frame).collect()}
    assert back == {1: tokenizer.decode([5, 6], skip_special_tokens=False), 2: "", 3: ""}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_digests(frame).count() == 0 and bpe.decode_bpe(bpe.encode_bpe(frame)).count() == 0


def test_table_that_starts_anew(spark, rows, monkeypatch):
    tokenizer = bpe.load(bpe.default_path())
    monkeypatch.setattr(bpe, "WORDS", 50)
    words = bpe.WordTable(bpe.default_path())
    import pyarrow as pa

    texts = [t or "" for _, t in rows[:80]]
    assert [x.as_py() for t in texts for x in words.encode(pa.array([t]))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizers_that_keep_white_space_are_refused(spark):
    import public_tokenizers

    with pytest.raises(ValueError, match="decoder of its own"):
        bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
