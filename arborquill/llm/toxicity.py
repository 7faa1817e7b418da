"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's bag is the word itself and its character n-grams (3 to 5, with ``<`` and ``>`` around it),
hashed into ``BUCKETS``. A text's vector is the mean of the embeddings of all its words' bags; a
linear softmax over two classes scores it. Embeddings and softmax are trained together by Adagrad,
in numpy, in one task, on a bounded sample of labelled rows: ``SAMPLE`` rows with ``ENTRIES`` entries, a third of
label 1 at most, those with the smallest hash of their id; the bias is then moved from the sample's share of label 1 to that
of all rows learnt from. The mean counts ``PADDING`` zero vectors, too, so that a few unseen words
can't decide a very short text. A misspelling shares most n-grams with the word it's made from.

Scoring is linear in the text, so each distinct word's share of the score is computed once a task.

Edge cases: a null or empty text has the share of label 1 as its score; without labelled rows of
both classes every score is the share of label 1 (0 without any). Null labels are no labels. Rows are
independent, so repeated rows score alike; if a label is repeated, its row counts twice.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, keyed, sliced

#: Labelled rows to learn from, and entries (a bucket of a text) that these may have in sum: the documented
#: bounds of the fit. Rows beyond the entries, in the order of their ids' hash, are left out of the sample.
SAMPLE, ENTRIES = 6000, 20_000_000
BUCKETS, DIMENSIONS, EPOCHS, RATE, BATCH, DAMPING, PADDING = 1 << 17, 8, 8, 0.5, 64, 1e-5, 100
SHORT, LONG = 3, 5
THRESHOLD = 0.3
#: Words in a task's cache, which starts anew beyond that.
WORDS = 400_000
STRIP = re.compile(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


def bag(word: str) -> list[int]:
    """The buckets of a word (lower-cased here; punctuation around it is left out)."""
    word = STRIP.sub("", word.lower())
    if not word:
        return []
    w = f"<{word}>"
    grams = [w] if len(w) > LONG else []
    grams += [w[i : i + n] for n in range(SHORT, LONG + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


class Bags(dict):
    """word -> bag, bounded."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > WORDS // 4:
            self.clear()
        self[word] = found = bag(word)
        return found


def bags_of(rows: DataFrame) -> DataFrame:
    """From id, text and label: label, buckets and their shares (sorted by bucket)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        cache = Bags()
        for batch in sliced(batches, 1 << 20):
            buckets, shares = [], []
            for text in batch.column(1).to_pylist():
                found = np.array([i for w in text.split() for i in cache[w]], np.int32)
                at, n = np.unique(found, return_counts=True)
                buckets.append(at)
                shares.append((n / (PADDING + len(found))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["id", "label", "buckets", "shares"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, label int, buckets array<int>, shares array<float>")


def fit(labels: np.ndarray, buckets: list[np.ndarray], shares: list[np.ndarray], seed: int = 7) -> tuple[np.ndarray, float]:
    """(each bucket's logit, bias), after joint training of embeddings and softmax; the bias stays at the
    labels' odds, so that a text without words has their share as its score."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    odds = np.log(labels.mean() / (1 - labels.mean()))
    bias = np.array([-odds / 2, odds / 2], np.float32)
    squares, out2 = np.full(BUCKETS, DAMPING, np.float32), np.full_like(out, 1e-4)
    target = np.eye(2, dtype=np.float32)[labels]
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
            at = np.concatenate([buckets[i] for i in rows])
            sizes = [len(buckets[i]) for i in rows]
            of = np.repeat(np.arange(len(rows)), sizes)
            a = np.concatenate([shares[i] for i in rows])
            ends = np.cumsum(sizes)
            weighted = table[at] * a[:, None]
            sums = np.concatenate([np.zeros((1, DIMENSIONS), np.float32), np.cumsum(weighted, axis=0, dtype=np.float64)])
            mean = (sums[ends] - sums[ends - sizes]).astype(np.float32)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            wrong = p - target[rows]
            back = wrong @ out.T
            g_out = mean.T @ wrong / len(rows)
            distinct, where = np.unique(at, return_inverse=True)
            step = np.stack([np.bincount(where, a * back[of, k]) for k in range(DIMENSIONS)], axis=1).astype(np.float32)
            squares[distinct] += (step**2).mean(axis=1)
            table[distinct] -= RATE * step / np.sqrt(squares[distinct])[:, None]
            out2 += g_out**2
            out -= 0.1 * g_out / np.sqrt(out2)
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all bags, in one task: the weights and the bias of the fit, how many rows there are and how many of label 1."""
    rows = []
    for batch in batches:
        ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
        rows += zip(ids, labels, *([np.asarray(x.values) for x in batch.column(c)] for c in ("buckets", "shares")), strict=True)
    rows.sort(key=lambda r: r[:2])
    truth = np.array([r[1] for r in rows], np.int64)
    weights, bias = fit(truth, [r[2] for r in rows], [r[3] for r in rows]) if len(set(truth)) == 2 else (np.empty(0), 0.0)
    n, ones, batch = len(truth), int(truth.sum()), None
    rows.clear()
    pa.default_memory_pool().release_unused()  # the worker lives on
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias]), pa.array([n], pa.int64()), pa.array([ones], pa.int64())], ["weights", "bias", "n", "ones"])


class Model:
    """Each bucket's logit and the bias: what is left of embeddings and softmax for scoring."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        weights, bias, cache = self.weights, self.bias, {}

        def score(text: str) -> float:
            total, n = 0.0, 0
            if len(cache) > WORDS:
                cache.clear()
            for w in text.split():
                if (x := cache.get(w)) is None:
                    b = bag(w)
                    x = cache[w] = (float(weights[b].sum()) if b else 0.0, len(b))
                total += x[0]
                n += x[1]
            return float(1 / (1 + np.exp(-np.clip(bias + total / (PADDING + n), -60, 60))))

        return score


def bucket_of(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Learn from labelled rows whose crc32(id as text) mod 4 is not 2."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    named = named.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (bucket_of(F.col("id")) != 2))
    total = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}  # two rows at most
    most = (sample - sample // 3, sample // 3)
    chosen = [named.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most[k]) for k in (0, 1)]
    # sample rows of two numbers at most, so a broadcast is bounded
    picked = keyed(docs, id_col, text_col).join(F.broadcast(chosen[0].unionAll(chosen[1])), "id").select("id", "text", "label")
    bags = durable(bags_of(picked))
    rank = F.xxhash64("id")
    sizes = sorted(bags.select(rank, F.size("buckets")).collect())  # sample rows of two numbers
    ends = np.cumsum([n for _, n in sizes])
    if len(sizes) and ends[-1] > entries:
        bags = bags.where(rank < sizes[int(np.searchsorted(ends, entries, "right"))][0])
    # the sample stays with the executors: the driver gets the weights
    found = bags.coalesce(1).mapInArrow(fitted, "weights binary, bias double, n bigint, ones bigint").collect()
    weights, bias, n, ones = found[0] if found else (None, 0.0, 0, 0)
    if not 0 < ones < n:
        return Model(np.zeros(BUCKETS), 60.0 if ones else -60.0)
    shift = np.log(total[1] / total[0]) - np.log(ones / (n - ones))
    return Model(np.frombuffer(weights, np.float64), bias + float(shift))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted (1 if the score is at least ``THRESHOLD``)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in sliced(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(score, batch.column(1).to_pylist()), pa.float64())], ["id", "score"])

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, score double")
    held_out = F.coalesce(bucket_of(F.col("id")) == 2, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic."""
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            keep = [score(t or "") < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
