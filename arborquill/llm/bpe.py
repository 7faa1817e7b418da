"""BPE encoding and decoding through distinct-word tables.

A text is split at runs of ASCII white space, where the tokenizer's own splits always fall, too. Each
block of rows (an Arrow batch's slice, bounded in bytes) gets a table of its distinct words; every
distinct word is encoded once, by the public tokenizer, and the ids are joined back to the words'
positions by one gather. Decoding joins ids with the vocabulary's pieces, a table of fixed size.

The word table is per task, not of the whole corpus: see the README for what a global one would move.

Edge cases: a null text is empty, and an empty text has no ids and decodes to an empty text; strings
of special tokens within a text are those tokens, as in the tokenizers library; an id outside the
vocabulary decodes to nothing. Rows are independent, so ties, repeated rows and empty tables need
nothing special; a very long text is a block of its own. Another tokenizer must split at white space, too,
and join its pieces by spaces; one with a decoder is refused.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import keyed, sliced

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text in a block; words in a task's table, which starts anew beyond that; words in a call.
BLOCK, WORDS, ENCODED = 4 << 20, 400_000, 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    if tokenizer.decoder is not None:
        raise ValueError(f"{path}: a tokenizer with a decoder of its own keeps white space in its pieces, which splitting at it would lose")
    return tokenizer


class WordTable:
    """Distinct words and their ids, in two growing arrays."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def look_up(self, words: list[str]) -> np.ndarray:
        """The rows of these words, new ones being encoded."""
        if len(self.rows) > WORDS:
            self.clear()
        new = [w for w in words if w not in self.rows]
        if new:
            first = len(self.rows)
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
            sizes, ids = array("q"), array("I")
            for at in range(0, len(new), ENCODED):
                for e in self.tokenizer.encode_batch_fast(new[at : at + ENCODED], add_special_tokens=False):
                    coded = e.ids
                    sizes.append(len(coded))
                    ids.extend(coded)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.frombuffer(sizes, np.int64))])
            self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.uint32)])
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        rows = self.look_up(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
        begin = self.ends[rows]
        sizes = self.ends[rows + 1] - begin
        after = np.concatenate([[0], np.cumsum(sizes)])
        # one gather: the place of each id is its row's beginning and its rank within the row
        ids = self.ids[np.repeat(begin - after[:-1], sizes) + np.arange(after[-1])]
        bounds = np.asarray(split.offsets) - (split.offsets[0].as_py() if len(split) else 0)
        return pa.ListArray.from_arrays(pa.array(after[bounds].astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode_bpe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col and ids (array<int>)."""
    path = path or default_path()

    def run(batches) -> Iterator[pa.RecordBatch]:
        words = WordTable(path)
        for batch in sliced(batches, BLOCK):
            yield pa.RecordBatch.from_arrays([batch.column(0), words.encode(batch.column(1))], ["id", "ids"])

    rows = keyed(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def pieces_of(path: str, tokenizer=None) -> pa.Array:
    """The piece of each id; null where there's none."""
    tokenizer = tokenizer or load(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    pieces: list[str | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = piece
    return pa.array(pieces, pa.string())


def decode_lists(lists: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The pieces of each list, joined as the tokenizer's decoder does (this one has none: by spaces)."""
    flat = lists.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
    found = pieces.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
    if found.null_count:
        parents = pc.list_parent_indices(lists).filter(found.is_valid())
        counts = np.bincount(np.asarray(parents), minlength=len(lists))
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), found.drop_null()), " ")
    bounds = np.asarray(lists.offsets) - (lists.offsets[0].as_py() if len(lists) else 0)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), found), " ")


def digests_of(lists: pa.ListArray, pieces: pa.Array) -> list[pa.Array]:
    """n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and decoded_sha256."""
    text = decode_lists(lists, pieces)
    flat, bounds = np.asarray(lists.flatten()).astype("<u4"), np.asarray(lists.offsets)
    bounds = bounds - bounds[0]
    coded = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    plain = [hashlib.sha256(x.as_buffer()).hexdigest() for x in text.cast(pa.binary())]
    return [pa.array(np.diff(bounds).astype(np.int64)), pa.array(coded, pa.string()), pa.array(plain, pa.string())]


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col and the digests of encoding and then decoding, in one pass: the ids don't leave the task."""
    path = path or default_path()

    def run(batches) -> Iterator[pa.RecordBatch]:
        words = WordTable(path)
        pieces = pieces_of(path, words.tokenizer)
        for batch in sliced(batches, BLOCK // 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), *digests_of(words.encode(batch.column(1)), pieces)], ["id", *(x.split()[0] for x in DIGESTS.split(", "))])
        pa.default_memory_pool().release_unused()

    rows = keyed(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {DIGESTS}").withColumnRenamed("id", id_col)


def decode_bpe(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id_col and text, through a join of the ids with the vocabulary's pieces. A null list has none."""
    path = path or default_path()

    def run(batches) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column(1)
                lists = pc.if_else(lists.is_valid(), lists, pa.scalar([], lists.type)) if lists.null_count else lists
                yield pa.RecordBatch.from_arrays([batch.column(0), decode_lists(lists, pieces)], ["id", "text"])

    rows = df.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
