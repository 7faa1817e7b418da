"""Plans: what a query works out, it works out once."""

import pytest

from arborquill import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["conllu_text", "conllu_files"])
def test_texts_are_parsed_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("raise_error(") == 1
    assert plan.count("Invalid token ID") == 1  # the tests of all cells
    assert plan.count("array_join(concat(") == (name == "conllu_text")  # the text itself


@pytest.mark.parametrize("name", ["node_any", "path_labels", "collocations", "parents", "exact_list", "chain_joins", "help_joins", "except_two_joins", "optional_two_joins"])
def test_words_are_derived_once(spark, name):
    """No window sorts the rows of orders, and no filter derives the words again for each scan."""
    if name == "exact_list":
        plan = queries.numbered(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    else:
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("collect_list(struct(n,")
    assert scans and "Window" not in plan
    assert plan.count("transform(w#") <= scans and plan.count("transform(by_k#") <= scans


def test_counts_share_the_pairs(spark):
    """The margins of a crosstab come from its pairs: matches are searched once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.QUERIES["collocations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Generate posexplode(") == 1 and "ReusedExchange" in plan
