"""The two tables of a treebank and conversions between them.

``sentences`` has one row per sentence with its words in one array, so that patterns need no join;
``words`` has one row per word. ``sent_id`` is (file number << 32) | sentence number: its order is the
corpus order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = "array<struct<k:string,v:string>>"
#: Fields of a word, in order. idx: position in the sentence; word_id: also counts multiword lines before it.
WORD_FIELDS = {
    "idx": "int", "word_id": "int", "token_id": "int", "form": "string", "lemma": "string", "upos": "string", "xpos": "string",
    "feats": PAIRS, "head": "int", "deprel": "string", "misc": PAIRS,
}
WORD = "struct<" + ",".join(f"{k}:{v}" for k, v in WORD_FIELDS.items()) + ">"
SENTENCES = f"sent_id bigint, file_no int, sent_no int, path string, text string, metadata map<string,string>, n_words int, root int, words array<{WORD}>"


def flatten(sentences: DataFrame) -> DataFrame:
    """``words`` of ``sentences``: sent_id and the fields of a word."""
    return sentences.select("sent_id", F.inline("words"))


def nest(words: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """``sentences`` of ``words``, by one shuffle on sent_id; sentence columns and sentences without words
    come from ``sentences``. Fields that ``words`` lacks are null (empty, if pairs)."""
    empty = {k: f"cast(array() AS {v})" if v == PAIRS else f"cast(NULL AS {v})" for k, v in WORD_FIELDS.items()}
    field = {k: f"cast({k} AS {v})" if k in words.columns else empty[k] for k, v in WORD_FIELDS.items()}
    for k in ("word_id", "token_id"):
        if k not in words.columns:
            field[k] = "cast(idx AS int)" if k == "word_id" else "cast(idx AS int) + 1"
    one = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in field.items()) + ")"
    grouped = words.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.expr(one))).alias("words"))
    if sentences is not None:
        kept = [c for c in ("sent_id", "file_no", "sent_no", "path", "text", "metadata") if c in sentences.columns]
        grouped = sentences.select(*kept).join(grouped, "sent_id", "left").withColumn("words", F.coalesce("words", F.expr(f"cast(array() AS array<{WORD}>)")))
    return complete(grouped)


def complete(grouped: DataFrame, *more: str) -> DataFrame:
    """All columns of ``sentences`` from sent_id, words and whatever else is there; the last root wins.
    ``more`` columns follow."""
    derived = {
        "file_no": "cast(shiftright(sent_id, 32) AS int)",
        "sent_no": "cast(sent_id & 4294967295 AS int)",
        "n_words": "size(words)",
        "root": "array_max(transform(filter(words, w -> w.head IS NULL), w -> w.idx))",
    }
    columns = []
    for part in SENTENCES.split(", "):
        name, kind = part.split(" ", 1)
        columns.append(f"{name}" if name in grouped.columns else f"cast({derived.get(name, 'NULL')} AS {kind}) AS {name}")
    return grouped.selectExpr(*columns, *more)
