"""The ``conllu`` data source: files as rows of sentences, one partition per file.

Options: ``paths``, a JSON list in the order of the corpus (repeats allowed), or a path to load;
``mode``, FAILFAST (default: the first fault ends the job) or PERMISSIVE (a fault is a row whose
``_error`` says what's wrong, its other columns null; other sentences and files go on). Files are gzip
if they begin so, whatever their name. Paths with a scheme are opened through Arrow's file systems.

For corpora of few, very large files see ``sources.blocks``, which splits files.
"""

from __future__ import annotations

import gzip
import io
import itertools
import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import PAIRS, SENTENCES, WORD, WORD_FIELDS
from .lines import Fault, root_of, sentences

FAILFAST, PERMISSIVE = "FAILFAST", "PERMISSIVE"
WITH_ERROR = SENTENCES + ", _error string"
GZIP = b"\x1f\x8b"
#: Sentences that go to Spark at once.
BATCH = 500
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
COLUMNS = [part.split(" ", 1) for part in WITH_ERROR.split(", ")]
WORDS = f"array<{WORD}>"


def open_bytes(path: str):
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return io.BufferedReader(system.open_input_file(inner))
    return open(path, "rb")


def open_lines(path: str) -> io.TextIOBase:
    """A file's lines as text; bytes that aren't UTF-8 are replaced. OSError if it can't be opened."""
    try:
        raw = open_bytes(path)
    except OSError as e:
        raise OSError(f"Failed to open file {path}: {e.strerror or e}") from e
    if raw.peek(2)[:2] == GZIP:
        raw = gzip.GzipFile(fileobj=raw)
    return io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n")


def rows(lines, file_no: int, path: str | None) -> Iterator[tuple]:
    """Rows of ``WITH_ERROR``."""
    for sent_no, found in enumerate(sentences(lines)):
        key = (file_no << 32 | sent_no, file_no, sent_no, path)
        if isinstance(found, Fault):
            yield (*key, None, None, None, None, None, str(found))
        else:
            yield (*key, found.text, found.metadata, len(found.words), root_of(found.words), found.words, None)


def lists(column: Sequence, items: Callable[[list], pa.Array]) -> pa.ListArray:
    """Of lists or nulls, from their items column by column: several times as fast as from nested objects."""
    ends = list(itertools.accumulate((0 if x is None else len(x) for x in column), initial=0))
    missing = [x is None for x in column]
    flat = list(itertools.chain.from_iterable(x for x in column if x))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items(flat), mask=pa.array(missing) if any(missing) else None)


def structs(flat: list[tuple], fields: dict[str, str]) -> pa.StructArray:
    columns = zip(*flat, strict=True) if flat else [()] * len(fields)
    return pa.StructArray.from_arrays([array_of(c, kind) for c, kind in zip(columns, fields.values(), strict=True)], list(fields))


def array_of(column: Sequence, kind: str) -> pa.Array:
    """An Arrow array of values of a type that ``WITH_ERROR`` or a word has."""
    if kind == PAIRS:
        return lists(column, lambda flat: structs(flat, {"k": "string", "v": "string"}))
    if kind == WORDS:
        return lists(column, lambda flat: structs(flat, WORD_FIELDS))
    return pa.array([None if x is None else list(x.items()) for x in column] if kind.startswith("map<") else column, ARROW[kind])


def batches(found: Iterable[tuple], with_error: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ``WITH_ERROR`` in Arrow batches, without the error if not asked for."""
    n = len(COLUMNS) - (not with_error)
    for part in itertools.batched(found, BATCH):
        columns = list(zip(*part, strict=True))[:n]
        arrays = [array_of(c, kind) for c, (_, kind) in zip(columns, COLUMNS, strict=False)]
        yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in COLUMNS[:n]])


class FilePartition(InputPartition):
    def __init__(self, file_no: int, path: str):
        self.file_no, self.path = file_no, path


class ConlluReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.mode = options.get("mode", FAILFAST).upper()
        if self.mode not in (FAILFAST, PERMISSIVE):
            raise ValueError(f"mode must be {FAILFAST} or {PERMISSIVE}")

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(i, p) for i, p in enumerate(self.paths)] or [FilePartition(0, "")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from batches(self.found(partition), self.mode == PERMISSIVE)

    def found(self, partition: FilePartition) -> Iterator[tuple]:
        try:
            with open_lines(partition.path) as lines:
                for row in rows(lines, partition.file_no, partition.path):
                    if row[-1] is not None and self.mode == FAILFAST:
                        raise ValueError(f"Parse error: {row[-1]}")
                    yield row
        except (OSError, EOFError) as e:
            if self.mode == FAILFAST:
                raise
            yield (partition.file_no << 32 | 0xFFFFFFFF, partition.file_no, None, partition.path, *[None] * 5, str(e))


class ConlluSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "conllu"

    def schema(self) -> str:
        return WITH_ERROR if self.options.get("mode", "").upper() == PERMISSIVE else SENTENCES

    def reader(self, schema) -> ConlluReader:
        return ConlluReader(dict(self.options))
