"""Counts over matches: frequencies and associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame, *columns: str, top: int | None = None) -> DataFrame:
    """The columns and n, most frequent first, ties in their order; the first ``top`` if given."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)
    return counts if top is None else counts.limit(top)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, f12 (rows with both), f1, f2 (rows with each) and n (all rows). Rows with a null are left out.

    Margins are sums over distinct pairs, joined back, so that a very frequent value is a key of a join, which
    adaptive execution splits, and of no window; all share the pairs' shuffle, so df is read once; the total is
    one row, broadcast."""
    counts = pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("f12"))
    total = counts.agg(F.coalesce(F.sum("f12"), F.lit(0)).alias("n"))
    for column, margin in ((a, "f1"), (b, "f2")):
        pairs = pairs.join(counts.groupBy(column).agg(F.sum("f12").alias(margin)), column)
    return pairs.select(a, b, "f12", "f1", "f2").crossJoin(F.broadcast(total))


def log_likelihood(f12: Column, f1: Column, f2: Column, n: Column) -> Column:
    """The G2 statistic of a two-by-two table with these margins."""
    cells = ((f12, f1 * f2), (f1 - f12, f1 * (n - f2)), (f2 - f12, (n - f1) * f2), (n - f1 - f2 + f12, (n - f1) * (n - f2)))
    term = lambda seen, margins: F.when(seen > 0, seen * F.ln(seen * n / margins)).otherwise(0.0)
    return 2 * (term(*cells[0]) + term(*cells[1]) + term(*cells[2]) + term(*cells[3]))


def collocations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of the crosstab, the pairs seen more often than expected, with ll, the strongest first."""
    table = crosstab(df, a, b).where(F.col("f12") > F.col("f1") * F.col("f2") / F.col("n"))
    return table.withColumn("ll", log_likelihood(*(F.col(c).cast("double") for c in ("f12", "f1", "f2", "n")))).orderBy(F.desc("ll"), a, b)
