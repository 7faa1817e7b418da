"""A treebank: where its sentences come from, and what can be asked of it."""

from __future__ import annotations

import glob
import json
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .nav import Tree
from .operators.joins import filter_words, search_words
from .operators.nested import filter_sentences, search_sentences
from .plans.parser import compile_query
from .plans.pattern import Pattern
from .schema import SENTENCES, complete, flatten, nest
from .sources.blocks import parse, read_blocks, strict, text_records
from .sources.files import PERMISSIVE, WITH_ERROR, ConlluSource, rows

Source = str | Path | Iterable[str | Path]


def session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def pattern_of(query: str | Pattern) -> Pattern:
    return query if isinstance(query, Pattern) else compile_query(query)


class Treebank:
    """Sentences, lazily; it can be read and searched again and again.

    ``sentences`` and ``words`` are its two DataFrames; ``permissive`` has the sentences with ``_error``,
    which iteration reads so that a fault is raised where it stands. ``flat``: patterns are searched by joins of words.
    """

    def __init__(self, sentences: DataFrame, words: DataFrame | None = None, permissive: DataFrame | None = None, flat: bool = False):
        self.sentences, self.words, self.flat = sentences, words if words is not None else flatten(sentences), flat
        self._permissive = permissive

    @classmethod
    def from_string(cls, text: str, spark: SparkSession | None = None) -> Treebank:
        """From CoNLL-U text, parsed here."""
        spark = session(spark)
        found = list(rows(text.split("\n"), 0, None))
        with_errors = spark.createDataFrame(found, WITH_ERROR)
        fault = next((r[-1] for r in found if r[-1] is not None), None)
        if fault is None:
            return cls(spark.createDataFrame([r[:-1] for r in found], SENTENCES), permissive=with_errors)
        return cls(strict(with_errors), permissive=with_errors)

    @classmethod
    def from_file(cls, path: str | Path, spark: SparkSession | None = None) -> Treebank:
        return cls.from_files([path], spark)

    @classmethod
    def from_files(cls, paths: Sequence[str | Path], spark: SparkSession | None = None) -> Treebank:
        """From files in this order; nothing is opened yet."""
        spark = session(spark)
        spark.dataSource.register(ConlluSource)
        reader = spark.read.format("conllu").option("paths", json.dumps([str(p) for p in paths]))
        return cls(reader.load(), permissive=reader.option("mode", PERMISSIVE).load())

    @classmethod
    def from_glob(cls, pattern: str, spark: SparkSession | None = None) -> Treebank:
        """From the files that match, sorted; with a scheme Spark lists them, else this machine."""
        if "://" not in pattern:
            return cls.from_files(sorted(glob.glob(pattern, recursive=True)), spark)
        try:
            found = session(spark).read.format("binaryFile").load(pattern).select("path").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = []
        return cls.from_files(sorted(r["path"].replace("file:/", "file:///", 1) if re.match("file:/[^/]", r["path"]) else r["path"] for r in found), spark)

    @classmethod
    def from_blocks(cls, path: str | list[str], spark: SparkSession | None = None) -> Treebank:
        """From any path that Spark reads, large files being split between tasks."""
        return cls(read_blocks(session(spark), path))

    @classmethod
    def from_words(cls, words: DataFrame, sentences: DataFrame | None = None, flat: bool = False) -> Treebank:
        """From a table of words: gathered by sentence once, or, if ``flat``, left as it is."""
        nested = nest(words, sentences)
        return cls(nested if sentences is None or not flat else sentences, words if flat else None, flat=flat)

    @classmethod
    def from_parquet(cls, path: str, spark: SparkSession | None = None) -> Treebank:
        """From sentences that ``save`` wrote: of the words only the fields that a pattern names are read."""
        return cls(session(spark).read.parquet(path))

    @classmethod
    def from_table(cls, words: str, sentences: str, spark: SparkSession | None = None) -> Treebank:
        """From tables that ``save_tables`` wrote: bucketed by sentence, their joins deal nothing out again."""
        spark = session(spark)
        return cls(spark.table(sentences), spark.table(words), flat=True)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """The sentences as Parquet."""
        self.sentences.write.mode(mode).parquet(path)

    def save_tables(self, words: str, sentences: str, buckets: int, mode: str = "errorifexists") -> None:
        """Flat words and the sentences without them, as tables bucketed and sorted by sent_id."""
        for table, rows_ in ((words, self.words), (sentences, self.sentences.drop("words"))):
            dealt = rows_.repartition(buckets, "sent_id")
            dealt.write.mode(mode).bucketBy(buckets, "sent_id").sortBy("sent_id").saveAsTable(table)

    @classmethod
    def from_stream(cls, path: str, spark: SparkSession | None = None) -> Treebank:
        """From a folder into which CoNLL-U files fall: its sentences are a streaming DataFrame."""
        return cls(stream_sentences(session(spark), path))

    def trees(self, ordered: bool = True) -> DataFrame:
        return self.sentences.orderBy("sent_id") if ordered else self.sentences

    def search(
        self,
        query: str | Pattern,
        ordered: bool = True,
        semantics: str = "documented",
        fields: Mapping[str, Sequence[str]] | None = None,
        paths: Mapping[str, tuple[str, str]] | None = None,
        keep: Sequence[str] = ("sent_id",),
    ) -> DataFrame:
        """A row per match: sent_id and each variable's position, null where an OPTIONAL block isn't there.

        ``fields``: of a variable's word, as <variable>_<field>; ``paths``: name -> two variables, the
        positions down from the first to the second; ``keep``: columns of sentences. Not for flat ones."""
        pattern = pattern_of(query)
        if self.flat:
            if fields or paths or tuple(keep) != ("sent_id",):
                raise ValueError("fields, paths and keep need nested sentences")
            found = search_words(self.words, self.sentences, pattern, semantics)
        else:
            found = search_sentences(self.sentences, pattern, semantics, keep, fields, paths)
        return found.orderBy(*found.columns[: len(keep) + len(pattern.names)]) if ordered else found

    def filter(self, query: str | Pattern, ordered: bool = True, semantics: str = "documented") -> DataFrame:
        """The sentences with a match."""
        pattern = pattern_of(query)
        found = filter_words(self.words, self.sentences, pattern, semantics) if self.flat else filter_sentences(self.sentences, pattern, semantics)
        return found.orderBy("sent_id") if ordered else found

    def iter_trees(self, ordered: bool = True) -> Iterator[Tree]:
        """Trees one by one. A fault of the text is a ValueError, of a file an OSError, where it stands."""
        return (Tree(r) for r in self.iterated(self.source(), ordered))

    def iter_filter(self, query: str | Pattern, ordered: bool = True, semantics: str = "documented") -> Iterator[Tree]:
        found = filter_sentences(self.source().where("words IS NOT NULL"), pattern_of(query), semantics)
        return (Tree(r) for r in self.iterated(self.with_faults(found), ordered))

    def iter_matches(self, query: str | Pattern, ordered: bool = True, semantics: str = "documented") -> Iterator[tuple[Tree, dict[str, int]]]:
        """(tree, {variable: position}); a variable of an OPTIONAL block that isn't there is missing."""
        pattern = pattern_of(query)
        names = [f"v{i}" for i in range(len(pattern.names))]
        found = search_sentences(self.source().where("words IS NOT NULL"), pattern, semantics, keep=[c for c in SENTENCE_COLUMNS], names=names)
        for r in self.iterated(self.with_faults(found), ordered, names):
            yield Tree(r), {v: r[n] for v, n in zip(pattern.names, names, strict=True) if r[n] is not None}

    def source(self) -> DataFrame:
        """What iteration reads: sentences with their words, which flat tables are gathered into."""
        if self._permissive is not None:
            return self._permissive
        return self.sentences if "words" in self.sentences.columns else nest(self.words, self.sentences)

    def with_faults(self, found: DataFrame) -> DataFrame:
        if self._permissive is None:
            return found
        return found.unionByName(self._permissive.where("_error IS NOT NULL"), allowMissingColumns=True)

    @staticmethod
    def iterated(found: DataFrame, ordered: bool, more: Sequence[str] = ()) -> Iterator:
        for r in (found.orderBy("sent_id", *more) if ordered else found).toLocalIterator():
            if "_error" in found.columns and r["_error"] is not None:
                raise (ValueError if r["_error"].startswith("Parse error") else OSError)(f"Parse error: {r['_error']}" if r["_error"].startswith("Parse error") else r["_error"])
            yield r


SENTENCE_COLUMNS = [part.split(" ")[0] for part in SENTENCES.split(", ")]


def stream_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Streaming ``sentences`` of the files that fall into a folder; sent_id is a hash of the text."""
    from pyspark.sql import functions as F

    rows_ = text_records(spark.readStream, path).withColumns({"sent_id": F.xxhash64("value"), "file_no": F.lit(None), "sent_no": F.lit(None)})
    return complete(strict(parse(rows_)))


def load(source: Source, spark: SparkSession | None = None) -> Treebank:
    """A string is a glob, without hits an empty treebank; a Path is a file; else paths in their order."""
    if isinstance(source, str):
        return Treebank.from_glob(source, spark)
    if isinstance(source, Path):
        return Treebank.from_file(source, spark)
    if isinstance(source, Iterable):
        return Treebank.from_files([str(p) for p in source], spark)
    raise ValueError("source must be str, Path, or Iterable[str | Path]")


def from_string(text: str, spark: SparkSession | None = None) -> Treebank:
    return Treebank.from_string(text, spark)


def trees(source: Source, ordered: bool = True, spark: SparkSession | None = None) -> Iterator[Tree]:
    return load(source, spark).iter_trees(ordered)


def search(source: Source, query: str | Pattern, ordered: bool = True, spark: SparkSession | None = None) -> Iterator[tuple[Tree, dict[str, int]]]:
    return load(source, spark).iter_matches(query, ordered)


def search_trees(source: Tree | Iterable[Tree], query: str | Pattern, spark: SparkSession | None = None) -> Iterator[tuple[Tree, dict[str, int]]]:
    """Matches in trees at hand, in their order."""
    at_hand = [source] if isinstance(source, Tree) else list(source)
    table = session(spark).createDataFrame([(i, *(t.row[c] for c in SENTENCE_COLUMNS[1:])) for i, t in enumerate(at_hand)], SENTENCES)
    for tree, match in Treebank(table).iter_matches(query):
        yield at_hand[tree.sent_id], match
