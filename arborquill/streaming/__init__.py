"""Patterns over streams of sentences: searching is stateless, so any sink and output mode will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.nested import filter_sentences, search_sentences
from ..plans.pattern import Pattern
from ..treebank import pattern_of, stream_sentences


def search_stream(spark: SparkSession, path: str, query: str | Pattern, **options) -> DataFrame:
    """A streaming DataFrame of the matches in CoNLL-U files that fall into a folder; options as those of
    ``search_sentences``."""
    return search_sentences(stream_sentences(spark, path), pattern_of(query), **options)


def filter_stream(spark: SparkSession, path: str, query: str | Pattern, mode: str = "documented") -> DataFrame:
    """The sentences with a match."""
    return filter_sentences(stream_sentences(spark, path), pattern_of(query), mode)
