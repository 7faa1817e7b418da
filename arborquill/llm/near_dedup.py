"""Near-duplicates by Jaccard similarity: SimHash and MinHash bands propose, exact sets of shingles decide.

A text is the set of its shingles of ``SHINGLE`` words (ASCII lower case; all words of a shorter text),
as 64-bit hashes. Two texts link if their sets' Jaccard similarity is at least ``NEAR`` (4/5, compared in
integers); a group is all that is linked, directly or over others.

Candidates are, first, all texts whose SimHash fingerprints (the operator's, see simhash.py) are equal or at
most two bits apart: they meet in a bucket of a point that both name. Most near copies are further apart, so
candidates are, too, those that share one of ``BANDS`` bands of ``ROWS`` MinHashes: two texts of similarity s
share none with probability (1 - s^3)^20, which is 5.9e-7 at 0.8. Texts of equal sets (128-bit hash) are one node.

No pairs are made within a bucket.
1. In rounds over more and more bands, SimHash's points in the first, each node is compared with one pivot of each of its buckets, another
   one in each band, unless they're of one group already. So what is similar to a fair share of a bucket
   joins its group, and rows are linear in the buckets.
2. Buckets whose nodes are now of one group, or a pair that was compared, need nothing more. In the others
   the nodes outside the bucket's largest group are queries against all of its nodes: they are dealt out in
   blocks of about ``QUERIES`` to tasks through which slices of the bucket's nodes pass. A task compares exactly
   and reports only links that join two groups, so its output is less than its number of groups.

Edge cases: null and empty texts have no words and are copies of each other; null ids are kept, and go
last within a group. Repeated rows are copies; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, keyed, sliced
from .graph import components
from .simhash import fingerprint, points

SHINGLE, NEAR = 5, (4, 5)
BANDS, ROWS = 20, 3
#: The rounds' bands end at these; nodes in a block of queries, and in a slice of a bucket, about.
ROUNDS, QUERIES, SLICE = (4, 10, 20), 256, 1024
#: The number of SimHash's points among the bands.
SIMHASH = -1
#: Edges up to which groups are joined in one task.
FEW = 1_000_000
CACHE = 400_000
BASE, MIX = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93)
_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIPS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class Hashes(dict):
    """word -> its hash"""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, cache: Hashes) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    if len(cache) > CACHE:
        cache.clear()
    words = text.lower().split()
    size = min(SHINGLE, len(words))
    if not size:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * BASE + h[i : i + n]
    return np.unique(mixed(out))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of MinHashes of a set, none for an empty one."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 11):
        least = np.minimum(least, ((found[None, at : at + (1 << 11)] ^ FLIPS[:, None]) * FACTORS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * BASE + column)
    return keys.view(np.int64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both)


def sets(df: DataFrame) -> DataFrame:
    """Of id and text: id, node (128-bit hash of the set), n (its size), bands and fp, SimHash's fingerprint."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in sliced(batches):
            nodes, sizes, keys, marks = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, cache)
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                keys.append(bands(found))
                marks.append(fingerprint(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(marks, np.uint64).view(np.int64))], ["id", "node", "n", "bands", "fp"])

    rows = keyed(df, "id", "text", binary=True)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, node binary, n bigint, bands array<bigint>, fp bigint")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' similarity is at least ``NEAR``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in batches:
            held: dict[bytes, np.ndarray] = {}
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            stay = []
            for left, right, s, t in zip(a, b, x, y, strict=True):
                for node, text in ((left, s), (right, t)):
                    if node not in held:
                        held[node] = shingles(text, cache)
                stay.append(near(held[left], held[right]))
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    text = lambda name, to: texts.select(F.col("node").alias(name), F.col("text").alias(to))
    rows = pairs.select("a", "b").join(text("b", "y"), "b").join(text("a", "x"), "a").select("a", "b", "x", "y")
    return rows.mapInArrow(run, "a binary, b binary")


def within(rows: DataFrame) -> DataFrame:
    """From group (a task's key), node, root, query and text, the queries of a group first: links (a, b) between
    queries and nodes of the group, enough to join all roots that are linked."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        now, queries, parent = None, [], {}
        hashes = owners = sizes = np.empty(0, np.int64)

        def top(x: bytes) -> bytes:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            a, b = [], []
            for group, node, root, query, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    now, queries, parent, hashes = group, [], {}, None
                found = shingles(text, cache)
                if query:
                    queries.append((node, root, found))
                    continue
                if hashes is None:  # the first of the slice: the queries are complete
                    every = np.concatenate([q[2] for q in queries] or [np.empty(0, np.uint64)])
                    order = np.argsort(every, kind="stable")
                    sizes = np.array([len(q[2]) for q in queries], np.int64)
                    hashes, owners = every[order], np.repeat(np.arange(len(queries)), sizes)[order]
                lo, n = np.searchsorted(hashes, found, "left"), 0
                spans = np.searchsorted(hashes, found, "right") - lo
                n = int(spans.sum())
                if not n:
                    continue
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(n)
                both = np.bincount(owners[at], minlength=len(queries))
                for q in np.flatnonzero(NEAR[1] * both >= NEAR[0] * (len(found) + sizes - both)).tolist():
                    x, y = top(queries[q][1]), top(root)
                    if x != y:
                        parent[x] = y
                        a.append(queries[q][0])
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.select("group", "node", "root", "query", "text").mapInArrow(run, "a binary, b binary")


def met_by_simhash(marks: DataFrame) -> DataFrame:
    """From distinct node, n and fp: node, n, and as key the points in which all nodes at most two bits apart meet."""
    near_by = points(marks.select("fp").distinct()).where("fp <> point").select("fp", "point")
    own = marks.select("node", "n", F.col("fp").alias("key"))
    return own.unionAll(marks.join(near_by, "fp").select("node", "n", F.col("point").alias("key"))).distinct()


def links(nodes: DataFrame, marks: DataFrame, texts) -> DataFrame:
    """From distinct node, n and bands, and distinct node, n and fp: edges (a, b) whose components are those of all
    similar candidates.

    ``texts`` gives node and text of the nodes of a DataFrame.
    """
    keys = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    keys = keys.unionAll(durable(met_by_simhash(marks)).select("node", "n", F.lit(SIMHASH).alias("band"), "key"))
    shared = durable(keys.groupBy("band", "key").count().where("count > 1"))
    met = durable(keys.join(shared.hint("merge"), ["band", "key"]).select("band", "key", "node", "n", F.col("count").alias("many")))
    of = durable(texts(met.select("node").distinct()))
    fits = lambda a, b: f"{NEAR[1]} * least({a}, {b}) >= {NEAR[0]} * greatest({a}, {b})"
    edges, roots, begin = None, None, SIMHASH

    def named(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    for end in ROUNDS:
        rows = durable(named(met.where(F.col("band").between(begin, end - 1))))
        pivot = F.min(F.struct(F.xxhash64("node", "band").alias("rank"), "node", "n", "root")).alias("x")
        pivots = rows.groupBy("band", "key").agg(pivot).selectExpr("band", "key", "x.node AS b", "x.n AS m", "x.root AS other")
        tried = rows.join(pivots.hint("merge"), ["band", "key"]).where("root <> other").where(fits("n", "m")).selectExpr("node AS a", "b").distinct()
        found = similar(tried, of)
        edges = durable(found if edges is None else edges.unionAll(found))
        roots = durable(components(edges, FEW))
        begin = end
    # pairs alone in their buckets have been compared
    rows = durable(named(met.where("many > 2")))
    sizes = rows.groupBy("band", "key", "root").count()
    buckets = sizes.groupBy("band", "key").agg(F.max(F.struct("count", "root")).alias("x"), F.sum("count").alias("many")).where("x.count < many")
    buckets = durable(buckets.selectExpr("band", "key", "x.root AS main", f"cast(ceil((many - x.count) / {QUERIES}) AS int) AS blocks", f"cast(ceil(many / {SLICE}) AS int) AS slices"))
    rows = rows.drop("many").join(buckets.hint("merge"), ["band", "key"])
    block, part = "cast(pmod(xxhash64(node), blocks) AS int)", "cast(pmod(xxhash64(node, 1), slices) AS int)"
    asked = rows.where("root <> main").selectExpr("*", f"{block} AS block", "explode(sequence(0, slices - 1)) AS slice", "true AS query")
    every = rows.selectExpr("*", "explode(sequence(0, blocks - 1)) AS block", f"{part} AS slice", "false AS query")
    group = F.xxhash64("band", "key", "block", "slice").alias("group")
    dealt = asked.unionAll(every).select(group, "node", "root", "query").join(of, "node").repartition("group").sortWithinPartitions("group", F.desc("query"))
    return edges.unionAll(within(dealt))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that are the first of their group: that of the least id (null ids
    last), of rows of one id that of the least text hash, and one of equal rows."""
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("mark"))
    source = df.select(key.alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = durable(sets(source))
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = durable(nodes)

    def texts(some: DataFrame) -> DataFrame:
        wanted = nodes.join(some, "node", "left_semi").select("node", F.col("least").alias("id"))
        return keyed(source, "id", "text", binary=True).join(wanted, "id").select("node", "text").dropDuplicates(["node"])

    roots = components(links(nodes.select("node", "n", "bands"), rows.select("node", "n", "fp").distinct(), texts), FEW).withColumnRenamed("node", "of")
    of = nodes.join(roots, nodes["node"] == roots["of"], "left").select(F.coalesce("root", "node").alias("root"), "least")
    stay = of.groupBy("root").agg(F.min("least").alias("key_"))
    kept = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), key.alias("key"))
    kept = kept.join(stay, F.col("key") == F.col("key_"), "left_semi").dropDuplicates(["key"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in df.columns))
