"""Toxicity: accuracy on held-out labels, and what the scores depend on."""

import zlib

import duckdb
import pytest

from arborquill.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    return model, toxicity.score_toxicity(docs, model).toPandas()


def test_held_out_accuracy(scored):
    _, found = scored
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").df()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    both = found[found.held_out].merge(labels, on="doc_id")
    ranks, positive = both.score.rank(), both.toxic == 1
    auc = (ranks[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    hit = both.predicted == 1
    assert auc > 0.94 and positive[hit].mean() > 0.75 and hit[positive].mean() > 0.72


def test_labels_of_held_out_rows_are_not_read(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 2000")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 2000")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.bucket_of(toxicity.F.col("doc_id")) == 2, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.train(docs, labels, sample=300), toxicity.train(docs, turned, sample=300)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_misspellings_share_ngrams(scored):
    score = scored[0].scorer()
    assert len(set(toxicity.bag("wretched")) & set(toxicity.bag("wretchedd"))) > len(toxicity.bag("wretched")) // 2
    assert 0.08 < score("") < 0.16 and score("a word") == scored[0].scorer()("a word")


def test_edges(spark):
    rows = [(1, None, 3), (2, "", 4), (3, "…", 5), (None, "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long").selectExpr("*", "7 AS id", "8 AS label")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == 4 and got[1]["score"] == got[2]["score"] < 0.01 and got[None]["held_out"] is False
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    always = toxicity.train(docs, spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int"))
    assert all(r["predicted"] == 1 for r in toxicity.score_toxicity(docs, always).collect()) and toxicity.keep_clean(docs, always).count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_entries_bound_the_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 2000")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 2000")
    some = toxicity.train(docs, labels, sample=300, entries=30_000)
    whole, same = (toxicity.train(docs, labels, sample=300, entries=n) for n in (10**9, 10**8))
    assert (whole.weights == same.weights).all() and (some.weights != whole.weights).any()
    assert not toxicity.train(docs, labels, sample=300, entries=0).weights.any()


def test_sample_is_not_sent_to_the_driver(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").where("doc_id < 500") for t in ("documents", "labels"))
    rows = []

    def counted(self, collect=type(docs).collect):
        found = collect(self)
        rows.extend(x for r in found for x in r if isinstance(x, list))
        return found

    monkeypatch.setattr(type(docs), "toArrow", lambda self: pytest.fail("the sample was gathered"))
    monkeypatch.setattr(type(docs), "collect", counted)
    assert toxicity.train(docs, labels, sample=300).weights.any() and not rows
