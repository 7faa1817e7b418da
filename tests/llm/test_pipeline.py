"""The pipeline's stages, each on its own input, against the operators and brute force."""

import math
import re
import string
import zlib

import duckdb
import pytest

import corpus_pipeline
from arborquill.llm import bpe, line_dedup, toxicity

from .test_decontaminate import brute, parsed

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    yield out
    for x in out[1:]:
        x.unpersist()


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "bpe_coding"]
    assert all(x.schema.simpleString() == steps[0].schema.simpleString() for x in steps[1:-1])
    assert steps[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    counts = [x.count() for x in steps]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > counts[0] // 2


def test_line_stage(spark, steps):
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in steps[2].collect()}
    con = duckdb.connect()
    con.register("input", steps[1].toArrow())
    want = con.sql(line_dedup.line_sql("input")).fetchall()
    assert got == {i: (text, len(text)) for i, _, _, text in want}


def grams(text):
    """Bags of five words, as a set."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_stage(steps):
    """One document of each group of Jaccard similarity 0.8, by comparing all pairs."""
    sets = {r["doc_id"]: grams(r["text"]) for r in steps[2].collect()}
    kept, seen = [], set()
    for i in sorted(sets):
        if i in seen:
            continue
        kept.append(i)
        todo = [i]
        while todo:
            a = todo.pop()
            seen.add(a)
            todo += [b for b in sets if b not in seen and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    assert sorted(r["doc_id"] for r in steps[3].collect()) == kept and len(kept) < len(sets)


def test_toxicity_stage(spark, steps):
    """The score of each text computed word by word from the model's weights."""
    model = toxicity.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))

    def score(text):
        total = n = 0
        for word in (text or "").split():
            word = word.lower().strip(string.punctuation)
            if word:
                whole = f"<{word}>"
                parts = ([whole] if len(whole) > 5 else []) + [whole[i : i + k] for k in (3, 4, 5) for i in range(len(whole) - k + 1)]
                total += sum(model.weights[zlib.crc32(x.encode()) % len(model.weights)] for x in parts)
                n += len(parts)
        return 1 / (1 + math.exp(-(model.bias + total / (toxicity.PADDING + n))))

    want = {r["doc_id"] for r in steps[0].collect() if score(r["text"]) < 0.3}
    assert {r["doc_id"] for r in steps[1].collect()} == want and 0 < len(want) < steps[0].count()


def test_decontamination_stage(spark, steps):
    """The documents in which brute force finds no item."""
    docs = [(r["doc_id"], r["text"]) for r in steps[3].collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # a leak needs a common run of words, so brute force may be spared where there is none
    runs = {tuple(w[i : i + 4]) for _, t in items for w in [[x[1] for x in parsed(t)]] for i in range(max(1, len(w) - 3))}
    some = [(i, t) for i, t in docs for w in [[x[1] for x in parsed(t)]] if any(tuple(w[k : k + 4]) in runs for k in range(len(w)))]
    leaking = {i for i, _ in brute(some, items)}
    assert {r["doc_id"] for r in steps[4].collect()} == {i for i, _ in docs} - leaking and leaking


def test_coding_stage(steps):
    tokenizer = bpe.load(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in steps[5].collect()} == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}


def test_run(spark, steps):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, steps[-1].collect()))


def test_empty_and_odd_tables(spark, steps):
    schema = steps[0].schema
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (None, "a b", None, None, None)], schema)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, odd, SF).count() == (2 if i == 2 else 4)
