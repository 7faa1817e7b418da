"""Every query of the library against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from arborquill import queries
from arborquill.functions.stats import collocations, crosstab, frequency

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_as_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    want = oracle.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cut = lambda v: round(v, 4) if isinstance(v, float) else v
    rows = lambda found, columns: sorted(repr([cut(r[columns.index(c)]) for c in sorted(columns)]) for r in found)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


#: Counts of matches that the data are known to have.
COUNTS = {"words": 6000, "sentences": 1473, "node_upos": 1962, "edge_child_label": 69, "except": 1839, "optional_two": 1972, "filter_node": 1081, "anonymous_has_child_label": 160}


@pytest.mark.parametrize("name", COUNTS)
def test_counts(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == COUNTS[name]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["sent_id", "V", "N"] and df.count() == 124
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_statistics(spark):
    df = spark.createDataFrame([("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 2 + [("b", "y")] * 8 + [(None, "x"), ("a", None)], "p string, q string")
    table = {(r["p"], r["q"]): r for r in crosstab(df, "p", "q").collect()}
    assert {k: (r["f12"], r["f1"], r["f2"], r["n"]) for k, r in table.items()} == {("a", "x"): (8, 10, 10, 20), ("a", "y"): (2, 10, 10, 20), ("b", "x"): (2, 10, 10, 20), ("b", "y"): (8, 10, 10, 20)}
    found = collocations(df, "p", "q").collect()
    assert [(r["p"], r["q"]) for r in found] == [("a", "x"), ("b", "y")] and abs(found[0]["ll"] - 7.7096) < 1e-3
    assert [tuple(r) for r in frequency(df, "p", top=2).collect()] == [("a", 11), ("b", 10)]
    assert crosstab(df.limit(0), "p", "q").count() == 0
