"""CoNLL-U by Spark's own text source, records ending at empty lines, parsed in SQL expressions.

Plain files are split between tasks, any file system that Spark reads will do, and no Python runs; so
this is the way to read a very large corpus, and to stream one. It differs from ``sources.files`` in
what a split can't know: sentences are numbered by an increasing, not a dense, number; comments
that no word follows are dropped; faults name the line within its sentence; gzip goes by the file's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAIRS, WORD_FIELDS, complete

NUMBER = "^[0-9]{0,9}$"


def pairs(cell: str) -> str:
    one = "named_struct('k', substring_index(p, '=', 1), 'v', substring(p, instr(p, '=') + 1))"
    return f"CASE WHEN {cell} = '_' THEN cast(array() AS {PAIRS}) ELSE transform(split({cell}, '\\\\|', -1), p -> {one}) END"


def fault(c: str) -> str:
    """SQL: what's wrong with the cells of a token line, or null; in the order in which cells are read."""
    bad_pair = lambda cell: f"try_element_at(filter(split({cell}, '\\\\|', -1), p -> instr(p, '=') = 0), 1)"
    missing = lambda i: f"WHEN size({c}) <= {i} THEN 'Missing field {i}'"
    return " ".join(
        [
            f"CASE WHEN instr({c}[0], '-') > 0 THEN NULL WHEN instr({c}[0], '.') > 0 THEN concat('Empty nodes are not supported: ', {c}[0])",
            f"WHEN NOT {c}[0] RLIKE '{NUMBER}' THEN concat('Invalid token ID: ', {c}[0])",
            *map(missing, range(1, 6)),
            f"WHEN {c}[5] <> '_' AND exists(split({c}[5], '\\\\|', -1), p -> instr(p, '=') = 0) THEN concat('Invalid FEATS pair (missing \\'=\\'): ', {bad_pair(f'{c}[5]')})",
            missing(6),
            f"WHEN {c}[6] <> '_' AND (NOT {c}[6] RLIKE '{NUMBER}' OR {c}[6] = '' OR {c}[6] RLIKE '^00+$') THEN concat('Invalid HEAD: ', {c}[6])",
            missing(7),
            missing(8),
            f"WHEN {c}[8] <> '_' THEN 'Extended deprels not yet supported'",
            missing(9),
            f"WHEN {c}[9] <> '_' AND exists(split({c}[9], '\\\\|', -1), p -> instr(p, '=') = 0) THEN concat('Invalid FEATS pair (missing \\'=\\'): ', {bad_pair(f'{c}[9]')})",
            f"WHEN size({c}) > 10 THEN 'Expected 10 fields, found more than 10' END",
        ]
    )


def once(rows: DataFrame, name: str, value: str) -> DataFrame:
    """rows with one column more, out of a generator: no filter is pushed through it and no use is replaced by the
    expression, so it's found once a row, however often others name it."""
    return rows.select("*", F.explode(F.array(F.expr(value))).alias(name))


def parse(records: DataFrame, column: str = "value") -> DataFrame:
    """records with text, metadata, words and _error in place of the text of a sentence.

    Whatever is named twice, or by a search, is found ``once``: else each step multiplies the ones before it."""
    out = once(records, "lines", f"filter(split(`{column}`, '\\n', -1), l -> l <> '')").drop(column)
    out = once(out, "cells", "transform(filter(lines, l -> left(l, 1) <> '#'), l -> split(l, '\\t', -1))").where("size(cells) > 0")
    out = out.withColumn("comments", F.expr("filter(lines, l -> left(l, 1) = '#' AND instr(l, '=') > 0)"))
    out = out.withColumn("pairs", F.expr("transform(comments, l -> named_struct('k', btrim(substring_index(substring(l, 2), '=', 1), ' \\t\\r'), 'v', btrim(substring(l, instr(l, '=') + 1), ' \\t\\r')))"))
    out = once(out, "faults", f"filter(transform(cells, (c, i) -> named_struct('i', i, 'm', {fault('c')})), f -> f.m IS NOT NULL)")
    last = "filter(pairs, (p, i) -> p.k <> 'text' AND NOT exists(slice(pairs, i + 2, size(pairs)), q -> q.k = p.k))"
    head = "CASE WHEN t.c[6] IN ('0', '_') THEN NULL ELSE cast(t.c[6] AS int) - 1 END"
    value = {
        "idx": "i", "word_id": "t.i", "token_id": "CASE WHEN t.c[0] = '' THEN 0 ELSE cast(t.c[0] AS int) END", "form": "t.c[1]", "lemma": "t.c[2]", "upos": "t.c[3]", "xpos": "t.c[4]",
        "feats": pairs("t.c[5]"), "head": head, "deprel": "t.c[7]", "misc": pairs("t.c[9]"),
    }
    word = "named_struct(" + ", ".join(f"'{k}', cast({value[k]} AS {kind})" for k, kind in WORD_FIELDS.items()) + ")"
    out = out.withColumns({"text": F.expr("try_element_at(filter(pairs, p -> p.k = 'text'), -1).v"), "metadata": F.expr(f"map_from_entries({last})")})
    out = once(out, "words", f"CASE WHEN size(faults) = 0 THEN transform(filter(transform(cells, (c, i) -> named_struct('i', i, 'c', c)), t -> instr(t.c[0], '-') = 0), (t, i) -> {word}) END")
    first = "concat('Parse error at line ', faults[0].i + 1, ' of its sentence: ', faults[0].m, '\\n  Line: ', array_join(cells[faults[0].i], '\\t'))"
    beyond = "exists(words, w -> w.head >= size(words))"
    out = out.withColumn("_error", F.expr(f"CASE WHEN size(faults) > 0 THEN {first} WHEN {beyond} THEN 'Parse error: Invalid HEAD' END"))
    out = out.withColumn("words", F.expr("CASE WHEN _error IS NULL THEN words END"))
    return out.drop("lines", "comments", "cells", "pairs", "faults")


def strict(parsed: DataFrame) -> DataFrame:
    """Without _error: the first fault ends the job."""
    return parsed.withColumn("words", F.expr("CASE WHEN _error IS NOT NULL THEN raise_error(_error) ELSE words END")).drop("_error")


def text_records(reader, path) -> DataFrame:
    return reader.option("lineSep", "\n\n").text(path)


def read_blocks(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """``sentences`` of the files (and ``_error``, if PERMISSIVE); sent_id grows within a file's split."""
    rows = text_records(spark.read, path).select("value", F.col("_metadata.file_path").alias("path"))
    parsed = parse(rows.withColumns({"sent_id": F.monotonically_increasing_id(), "file_no": F.lit(None), "sent_no": F.lit(None)}))
    return complete(strict(parsed)) if mode.upper() == "FAILFAST" else complete(parsed, "_error")
