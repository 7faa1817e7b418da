"""Connected components by large-star and small-star rounds.

Every round is a grouped minimum and a join on the node; a node with very many neighbours only makes
a large key in a join that adaptive execution splits. Nothing is gathered in one task or the driver
but the count of what changed, and edges up to a bound that the caller may name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def joined(batches) -> Iterator[pa.RecordBatch]:
    """Of all edges (a, b), in one task: node and root."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    ends = pa.chunked_array([b.column(0) for b in batches] + [b.column(1) for b in batches]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    names, rank = ends.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    a, b = rank[ends.indices.to_numpy()].reshape(2, -1)
    root = np.arange(len(names))
    while ((x := root[a]) != (y := root[b])).any():
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], ["node", "root"])


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """From edges (a, b): one row (node, root) per node, root being the least of its component.

    Loops and repeated edges do no harm; no edges give no rows. Up to ``few`` distinct edges are joined in one
    task, as rounds cost the driver many small jobs; the result is the same.
    """
    edges = durable(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    if few and edges.limit(few + 1).count() <= few:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(joined, f"node {kind}, root {kind}")
    while True:
        # large star: each node's larger neighbours go to the least of its neighbours and itself
        both = edges.unionAll(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").distinct()
        # small star: each node's smaller neighbours, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("CASE WHEN b = m THEN a ELSE b END AS a", "m AS b").where("a <> b").distinct()
        # a star forest has one edge per node, and no node that is both a leaf and a root
        new = durable(small)
        leaves = new.selectExpr("a AS b")
        open_ = new.groupBy("a").count().where("count > 1").limit(1).count() or new.join(leaves, "b", "left_semi").limit(1).count()
        edges = new
        if not open_:
            break
    return edges.selectExpr("a AS node", "b AS root").unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
