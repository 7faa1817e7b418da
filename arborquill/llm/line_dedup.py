"""Line dedup by overlapping three-line windows.

Every three consecutive lines are hashed (128 bits); a window that occurs more than once anywhere has
its first occurrence, by (id, position), and every later one has its three lines covered. Covered
positions are merged per row and removed. A repeated single line that stands in new company stays.

Only (hash, id, position) rows are shuffled for the search, summed before the shuffle; then the
positions return to their texts by a join on id and text. One very common window is one key of a join
that adaptive execution splits.

Edge cases: a null text is empty; an empty text is one empty line; texts of fewer than three lines have
no window and stay whole; null ids come first in the order. Rows with equal id and text are ties:
their windows are the same occurrences, so none removes the other's, and both get the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def occurrences(df: DataFrame) -> DataFrame:
    """From id, mark and text: id, mark, pos and the window's hashes h and g."""
    lines = "split(text, '\\\\n', -1)"
    last = ", ".join(f"element_at(l, i + {k + 1})" for k in range(WINDOW))
    first = ", ".join(f"element_at(l, i + {k + 1})" for k in reversed(range(WINDOW)))
    windows = f"transform(array({lines}), l -> CASE WHEN size(l) < {WINDOW} THEN cast(array() AS array<struct<h:bigint,g:bigint>>) ELSE transform(sequence(0, size(l) - {WINDOW}), i -> named_struct('h', xxhash64({last}), 'g', xxhash64(i * 0, {first}))) END)[0]"
    return df.select("id", "mark", F.posexplode(F.expr(windows)).alias("pos", "w")).select("id", "mark", "pos", "w.h", "w.g")


def covered_starts(df: DataFrame) -> DataFrame:
    """From id, mark and text: id, mark and starts, the positions of later occurrences (rows without any are left out)."""
    found = occurrences(df)
    first = found.groupBy("h", "g").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(first, ["h", "g"]).where(~F.struct("id", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("id", "mark").agg(F.collect_set("pos").alias("starts"))


def marked(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), *more)


def rejoin(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """With n_lines, n_removed and kept for each of rows (id, mark, text, ...)."""
    starts = starts.withColumnsRenamed({"id": "id_", "mark": "mark_"})
    both = rows.join(starts, (rows["mark"] == starts["mark_"]) & rows["id"].eqNullSafe(starts["id_"]), "left").drop("id_", "mark_")
    gone = f"CASE WHEN starts IS NULL THEN cast(array() AS array<int>) ELSE array_distinct(flatten(transform(starts, s -> sequence(s, s + {WINDOW - 1})))) END"
    both = both.withColumn("gone", F.expr(gone))
    kept = "CASE WHEN size(gone) = 0 THEN text ELSE transform(array(split(text, '\\\\n', -1)), l -> array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> element_at(l, i + 1)), '\\n'))[0] END"
    lines = "cast(length(text) - length(replace(text, '\\n', '')) + 1 AS bigint)"
    return both.withColumns({"n_lines": F.expr(lines), "n_removed": F.expr("cast(size(gone) AS bigint)"), "kept": F.expr(kept)}).drop("starts", "gone")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_lines, n_removed and text (the kept lines)."""
    rows = marked(df, id_col, text_col)
    return rejoin(rows, covered_starts(rows)).select(F.col("id").alias(id_col), "n_lines", "n_removed", F.col("kept").alias("text"))


def replace_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, all columns, with the kept lines as its text."""
    rows = marked(df, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    out = rejoin(rows, covered_starts(marked(df, id_col, text_col)))
    return out.select(*((F.col("kept") if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns))


def line_sql(source: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {source}),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS win FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM later) GROUP BY doc_id)
SELECT doc_id, cast(len(l) AS BIGINT) AS n_lines, cast(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  CASE WHEN ps IS NULL THEN array_to_string(l, chr(10)) ELSE coalesce(array_to_string([l[i] for i in range(1, len(l) + 1) if NOT list_contains(ps, i)], chr(10)), '') END AS text
FROM d LEFT JOIN gone USING (doc_id)"""
