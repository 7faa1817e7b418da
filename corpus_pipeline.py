"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Each stage's function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` checkpoints in between; a caller may write each stage's rows and read
them again instead.

Near-duplicates have a Jaccard similarity of at least 0.8 between their sets of five-word shingles. The
SimHash operator's contract (two of 64 bits) misses most of these, so after SimHash's links the stage searches
on by MinHash bands, and candidates of either are checked exactly.

Edge cases: null and empty texts pass the first two stages, are copies of each other for the third, and
have no ids; empty tables give empty results. Columns beside doc_id and text are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborquill.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from arborquill.llm.common import durable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labelled rows of documents."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of three-line windows that occurred before."""
    return with_length(line_dedup.replace_lines(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id."""
    return near_dedup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks, re-parameterised or not."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def code_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text that they decode to."""
    return bpe.bpe_digests(docs)


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there's such a column, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("bpe_coding", code_bpe),
]

#: Two stages hold models or a public tokenizer, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:  # each stage reads its input more than once
            docs = durable(docs)
    return docs
