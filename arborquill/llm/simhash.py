"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set if it's set in over half the XXH64 hashes (seed 42) of a text's word
shingles, repeats included. Two link if they differ in at most ``radius`` bits.

Covering: each bit gets a non-zero vector of ``radius + 1`` bits, and each of the ``2^(radius+1) - 1``
masks keeps those bits whose vector has odd parity with the mask's number. The vectors of at most
``radius`` differing bits leave some number orthogonal to all of them, so in that mask's table the two
collide: no pair within the radius is lost. Tables hold distinct fingerprints, so copies add nothing.

Inside a bucket no pairs are made. Each fingerprint that shares a bucket names itself and its
neighbours at one flipped bit, within the bits that those masks leave out; two that are at most two bits
apart name a common point, and two that name a common point are at most two bits apart. So grouping by
point and linking each to the point's least fingerprint gives the same components from edges linear in
the bucket's size. (At radius 1 the points are the neighbours that are themselves fingerprints.)

Edge cases: null and empty texts have no words and fingerprint zero, linked like any other; fewer words
than a shingle make one shingle of all of them. Null ids are kept, and never a component's id unless
alone. Repeated rows give repeated rows; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, keyed, sliced
from .graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
BITS = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """As an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id_col and fp (bigint with the fingerprint's bits)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = np.fromiter((fingerprint(x, shingle) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    rows = keyed(df, id_col, text_col, binary=True)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def masks(radius: int = RADIUS) -> list[int]:
    """Covering masks over 64 bits, as signed numbers."""
    size = (1 << radius + 1) - 1
    vectors = [1 + i % size for i in range(BITS)]
    made = [sum(1 << i for i, v in enumerate(vectors) if (v & k).bit_count() & 1) for k in range(1, size + 1)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in made]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def flipped(fps: DataFrame, radius: int) -> tuple[DataFrame, Column]:
    """From distinct fp: those that share a bucket, and their neighbours at one flip of the bits left out there."""
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))))
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = rows.groupBy("t", "key").count().where("count > 1").select("t", "key")
    left_out = F.array(*(F.lit(~m) for m in masks(radius)))
    met = rows.join(shared, ["t", "key"]).groupBy("fp").agg(F.bit_or(F.element_at(left_out, F.col("t") + 1)).alias("free"))
    flips = F.expr("transform(filter(sequence(0, 63), b -> (shiftright(free, b) & 1L) = 1L), b -> fp ^ shiftleft(1L, b))")
    return met, flips


def points(fps: DataFrame) -> DataFrame:
    """From distinct fp: fp, each point that it shares with another, and b, the least that names the point. Two
    that are at most two bits apart share a point, and no others do."""
    met, flips = flipped(fps, 2)
    named = met.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    least = named.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top")
    return named.join(least, "point")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From distinct fp: edges (a, b) whose components are those of all pairs within the radius (1 or 2)."""
    if radius not in (1, 2):
        raise ValueError("radius 1 or 2")
    if radius == 1:
        met, flips = flipped(fps, radius)
        # points at one flip from one of the two only: the one names them, the other is one
        named = met.select("fp", F.explode(flips).alias("b"))
        return named.join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select(F.col("fp").alias("a"), "b")
    return points(fps).select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id_col, fp and component_id: the least id among all that are linked, directly or over others."""
    rows = durable(fingerprints(df, id_col, text_col, shingle))
    fps = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(fps.select("fp"), radius))
    of = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that are the first of their component: that of the least id (null ids
    last), of rows of one id that of the least text hash, and one of equal rows."""
    key = lambda x: F.struct(x.isNull().alias("none"), x.alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    found = near_duplicates(df.select(key(F.col(f"`{id_col}`")).alias("id"), F.col(text_col).alias("text")), "id", "text")
    stay = found.where(F.col("id") == F.col("component_id")).select(F.struct("id.*").alias("key_")).distinct()
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), key(F.col(f"`{id_col}`")).alias("key"))
    kept = rows.join(stay, F.col("key") == F.col("key_"), "left_semi").dropDuplicates(["key"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def simhash_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return near_duplicates(df, id_col, text_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
