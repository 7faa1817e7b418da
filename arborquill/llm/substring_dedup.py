"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one text. A word goes if a window over it also starts in a
text with a smaller id; windows are judged on the input.

Anchors: ``COVER`` is a difference cover modulo ``PERIOD``: for any two alignments some shift below
the period puts both on a residue of the cover. So of two equal windows some shift has an anchor, the
hash of the ``WINDOW - PERIOD + 1`` words there, at both, and only 6 of 31 positions need hashing.

1. Texts with the same words as one of a smaller id go whole, if they hold a window. They take no
   further part: each of their windows also starts in that other text.
2. Anchors are counted; those in one text only, most of them, are dropped. The rest are joined back to
   their places, by one shuffle of all places at any size, and counted again among the texts left.
3. Extension: in the texts that share anchors, every window over a shared anchor is hashed (128 bits).
   Windows also found in a text of a smaller id cover their words, and covered words are removed.

Counts are summed before their shuffle, and no step pairs texts: a passage in a third of all texts is
one key of a sum, and of a join that adaptive execution splits. Nothing that grows with the input is
broadcast by this module. What a join meets is written out before, so that the join deals both sides anew
and may split a hot key, which it couldn't below a sum of the same key.

Edge cases: null and empty texts have no words; texts of fewer words than a window stay whole. A null id
is neither smaller nor larger than any, so it removes nothing and keeps all its words. Rows of equal id
don't remove each other's words, and equal rows get equal results. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, sliced

WINDOW, PERIOD = 50, 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
WORDS = 600_000
ODD = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """word -> 64 bits, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of all runs of some length, modulo 2^64, from prefix sums."""

    def __init__(self, odd: int):
        self.odd, self.inverse = odd, pow(odd, -1, 1 << 64)
        self.grow(1 << 10)

    def grow(self, n: int) -> None:
        def powers(x: int) -> np.ndarray:
            out = np.full(n, x, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.up, self.down = powers(self.odd), powers(self.inverse)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        if len(x) > len(self.up):
            self.grow(2 * len(x))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=sums[1:])
        return sums

    def at(self, sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        h = (sums[starts + size] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(31)
        return h * MIX


def anchor_starts(n: int) -> np.ndarray:
    """The cover's positions at which an anchor fits into n words, if a window does."""
    if n < WINDOW:
        return np.empty(0, np.int64)
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at <= n - ANCHOR]


def covered(starts: np.ndarray, n: int, before: int, after: int) -> np.ndarray:
    """Which of n positions lie in [start - before, start + after) of any start."""
    edge = np.zeros(n + 1, np.int64)
    starts = starts[starts < n]
    np.add.at(edge, np.maximum(starts - before, 0), 1)
    np.add.at(edge, np.minimum(starts + after, n), -1)
    return np.cumsum(edge[:n]) > 0


def batch_of(batch: pa.RecordBatch, rows: list[int], names: list[str], arrays: list) -> pa.RecordBatch:
    """Some rows' first and third column (id and mark) beside arrays."""
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *arrays], ["id", "mark", *names])


def long(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64))


def marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (bytes) and mark, a hash that tells rows of equal id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("mark"))


def summaries(rows: DataFrame) -> DataFrame:
    """id, mark, n, s1 and s2 (128 bits of the words), sha (of the words joined)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, high, low, sha = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = text.split()
                joined = b" ".join(words)
                d = xxhash.xxh3_128_intdigest(joined)
                n.append(len(words))
                high.append(d >> 64)
                low.append(d & (1 << 64) - 1)
                sha.append(hashlib.sha256(joined).hexdigest())
            split = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *split, pa.array(sha, pa.string())], ["id", "mark", "n", "s1", "s2", "sha"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, mark bigint, n bigint, s1 bigint, s2 bigint, sha string")


def anchor_hashes(rows: DataFrame) -> DataFrame:
    """h for each text's distinct anchors."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes, rolling = Hashes(), Rolling(ODD[0])
        for batch in sliced(batches):
            found = []
            for text in batch.column(1).to_pylist():
                words = text.split()
                if len(words) >= WINDOW:
                    found.append(np.unique(rolling.at(rolling.prefix(hashes.of(words)), anchor_starts(len(words)), ANCHOR)))
            yield pa.RecordBatch.from_arrays([long(found)], ["h"])

    return rows.mapInArrow(run, "h bigint")


def anchor_places(rows: DataFrame) -> DataFrame:
    """h, id, mark and pos for each anchor."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes, rolling = Hashes(), Rolling(ODD[0])
        for batch in sliced(batches, 2 << 20):
            of, found, places = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.split()
                if len(words) >= WINDOW:
                    at = anchor_starts(len(words))
                    found.append(rolling.at(rolling.prefix(hashes.of(words)), at, ANCHOR))
                    places.append(at)
                    of += [i] * len(at)
            yield batch_of(batch, of, ["h", "pos"], [long(found), long(places).cast(pa.int32())])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, mark bigint, h bigint, pos int")


def candidate_windows(texts: DataFrame) -> DataFrame:
    """From id, text, mark and anchors (positions): id, mark, pos, h and g of the windows over them."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes, one, two = Hashes(), Rolling(ODD[0]), Rolling(ODD[1])
        for batch in sliced(batches, 1 << 20):
            of, places, h, g = [], [], [], []
            for i, (text, anchors) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x = hashes.of(text.split())
                last = len(x) - WINDOW + 1
                if last < 1:
                    continue
                at = np.flatnonzero(covered(np.array(anchors, np.int64), len(x), PERIOD - 1, 1)[:last])
                h.append(one.at(one.prefix(x), at, WINDOW))
                g.append(two.at(two.prefix(x ^ (x >> np.uint64(29))), at, WINDOW))
                places.append(at)
                of += [i] * len(at)
            yield batch_of(batch, of, ["pos", "h", "g"], [long(places).cast(pa.int32()), long(h), long(g)])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text", "mark", "anchors").mapInArrow(run, f"id {kind}, mark bigint, pos int, h bigint, g bigint")


def removed(texts: DataFrame, with_text: bool) -> DataFrame:
    """From id, text, mark and starts (of windows): id, mark, n_removed and sha or text of the kept words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2 << 20):
            gone, kept = [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                out = covered(np.array(starts, np.int64), len(words), 0, WINDOW)
                left = b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x])
                gone.append(int(out.sum()))
                kept.append(left.decode() if with_text else hashlib.sha256(left).hexdigest())
            yield batch_of(batch, list(range(batch.num_rows)), ["n_removed", "kept"], [pa.array(gone, pa.int64()), pa.array(kept, pa.string())])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text", "mark", "starts").mapInArrow(run, f"id {kind}, mark bigint, n_removed bigint, kept string")


def joined(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, ["id", "mark"])


def with_copies(base: DataFrame) -> DataFrame:
    """Of summaries: id, mark, n, sha, copy (the text of a smaller id has the same words) and leads (it
    may stand for all of these)."""
    least = durable(base.groupBy("s1", "s2").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("s1", "s2", "least"))
    copy = F.coalesce((F.col("n") >= WINDOW) & (F.col("id") > F.col("least")), F.lit(False))
    leads = (F.col("n") >= WINDOW) & F.col("id").isNotNull() & ~copy
    return base.join(least.hint("merge"), ["s1", "s2"], "left").select("id", "mark", "n", "sha", copy.alias("copy"), leads.alias("leads"))


def changes(rows: DataFrame, base: DataFrame, with_text: bool = False) -> DataFrame:
    """id, mark, n_removed and kept of the texts that lose words, but for whole copies."""
    reps = base.where("leads").select("id", "mark").distinct()
    shared = durable(anchor_hashes(rows).groupBy("h").count().where("count > 1").select("h"))
    places = durable(joined(anchor_places(rows).join(shared.hint("merge"), "h"), reps))
    again = durable(places.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("h"))
    anchors = places.join(again, "h").groupBy("id", "mark").agg(F.collect_set("pos").alias("anchors"))
    texts = durable(joined(rows, anchors).dropDuplicates(["id", "mark"]))
    found = candidate_windows(texts)
    first = durable(found.groupBy("h", "g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("h", "g", "least"))
    later = found.join(first, ["h", "g"]).where("id > least").groupBy("id", "mark").agg(F.collect_set("pos").alias("starts"))
    return removed(joined(texts.drop("anchors"), later), with_text)


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed and kept_sha256 (of the kept words joined by one space)."""
    rows = marked(df, id_col, text_col)
    base = durable(with_copies(durable(summaries(rows))))
    out = base.join(changes(rows, base), ["id", "mark"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(none)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def substring_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
later AS (SELECT doc_id, i FROM x JOIN (SELECT h, min(doc_id) AS least FROM x GROUP BY h) USING (h) WHERE doc_id > least),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM later) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d) u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(ps) AS p FROM gone) g WHERE g.doc_id = u.doc_id AND g.p = u.i) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN k USING (doc_id)"""
