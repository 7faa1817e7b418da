"""Benchmark decontamination by canonical templates.

A text becomes a template: its words in lower case without punctuation around them, with typed
placeholders for numbers, for units after numbers, and for names (title-case words within a sentence).
Windows of ``WINDOW`` template words of the items (all words of a shorter item, ``SHORTEST`` at least)
are hash-joined with the windows of the documents. Matched windows at one offset between item and
document form an alignment. Its slots are checked for consistency: a one-to-one renaming of each type's
values is chosen, the most frequent pairs of values first, and slots that it doesn't explain don't count.
Words that are equal, and plain words that match, count whatever the slots hold. So a re-parameterised
question is caught, with one number edited or all drawn anew, and a chance meeting of sentence frames in
which most of what matches are slots is not. An item leaks into a document if what counts covers at least
``COVER`` of its words. Windows with fewer than ``LITERALS`` words that aren't placeholders match too much
and aren't searched as templates.

Plain windows, of the same words without placeholders, are searched besides: all of them, and the whole
text of an item shorter than a window. So copies that are verbatim but for letter case are found however
many numbers and names an item has, and whatever stands before it. Their places join the alignment of the
template windows.

The items are the stated query set: blocks of at most ``BLOCK`` windows, each joined by one pass over
all documents, whose rows aren't shuffled. A block's size is fixed, so what each task holds is bounded.

Edge cases: null and empty texts have no words and match nothing; items shorter than ``SHORTEST`` words
are found by their plain words only; repeated items and rows are each reported; null ids are kept. Empty tables give no
rows. Item ids may be of any atomic type. If both ids have one name, the item's is ``item_<name>``.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType

from .common import keyed, sliced

WINDOW, SHORTEST, LITERALS, COVER = 8, 5, 4, 0.6
BLOCK = 1_000_000
CACHE = 400_000
UNITS = frozenset("mm cm m km in ft yd mi g kg mg lb lbs oz ml l cl gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent % dollar dollars euro euros cent cents pound pounds mph kmh km/h meter meters metre metres mile miles gram grams kilogram kilograms liter liters litre litres inch inches foot feet degree degrees".split())
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*[%]?$")
GLUED = re.compile(r"([+-]?[0-9][0-9.,]*)([a-zA-Z/]{1,4})$")
EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
PLAIN, NUM, UNIT, NAME = 0, 1, 2, 3
MARK = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
BASE = 0x5851F42D4C957F2D


def word_class(raw: str) -> tuple[int, int, bool, str]:
    """(hash of the plain form, class when it may be one, ends a sentence, plain form)."""
    if raw.isalpha() and raw.islower() and raw not in UNITS:
        return xxhash.xxh64_intdigest(raw), PLAIN, False, raw
    ends = raw.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
    bare = EDGES.sub("", raw)
    plain = bare.lower()
    kind = PLAIN
    if NUMBER.match(bare):
        kind = NUM
    elif (m := GLUED.match(bare)) and m[2].lower() in UNITS:
        kind = NUM
    elif plain in UNITS:
        kind = UNIT
    elif len(bare) > 1 and bare[0].isupper() and not bare.isupper():
        kind = NAME
    return xxhash.xxh64_intdigest(plain), kind, ends, plain


class Words(dict):
    """word -> its row in the arrays h, k (class, -1: all punctuation) and e (ends a sentence)."""

    def __init__(self):
        self.start()

    def start(self) -> None:
        self.clear()
        self.h, self.k, self.e = array("Q"), array("b"), array("b")

    def __missing__(self, raw: str) -> int:
        value, kind, ends, plain = word_class(raw)
        self.h.append(value)
        self.k.append(kind if plain else -1)
        self.e.append(ends)
        self[raw] = row = len(self.h) - 1
        return row


def template(text: str, cache: Words) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(hash of each template word, its class, the words); words that are all punctuation go."""
    return views(text, cache)[:3]


def views(text: str, cache: Words) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """As :func:`template`, and the hash of each word's plain form."""
    if len(cache) > CACHE:
        cache.start()
    words = text.split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int8), [], np.empty(0, np.uint64)
    rows = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    k = np.frombuffer(cache.k, np.int8)[rows]
    if k.min() < 0:
        rows = rows[k >= 0]
        words = [w for w, x in zip(words, k.tolist(), strict=True) if x >= 0]
        k = k[k >= 0]
    if not len(k):
        return np.empty(0, np.uint64), k, [], np.empty(0, np.uint64)
    h, e = np.frombuffer(cache.h, np.uint64)[rows], np.frombuffer(cache.e, np.int8)[rows]
    k[1:][(k[1:] == UNIT) & (k[:-1] != NUM)] = PLAIN
    k[1:][(k[1:] == NAME) & (e[:-1] > 0)] = PLAIN
    if k[0] in (UNIT, NAME):
        k[0] = PLAIN
    return np.where(k == PLAIN, h, MARK[k]), k, words, h


def windows(hashes: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window, whether it has literals enough)."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out = np.zeros(n, np.uint64)
    base = np.uint64(BASE)
    for i in range(size):
        out = out * base + hashes[i : i + n]
    literal = np.concatenate([[0], np.cumsum(kinds == PLAIN)])
    return out ^ (out >> np.uint64(29)), literal[size:] - literal[:-size] >= min(LITERALS, size)


class Items:
    """A block of items with indexes of their template and plain windows by size and hash."""

    def __init__(self, rows: list[tuple[object, str]]):
        cache = Words()
        self.items = [(i, *views(t or "", cache)) for i, t in rows]
        found: dict[tuple[bool, int], list] = defaultdict(list)
        for at, (_, h, k, _, plain) in enumerate(self.items):
            size = min(WINDOW, len(h))
            if size >= SHORTEST:
                hashes, enough = windows(h, k, size)
                found[False, size] += [(int(x), at, q) for q, x in enumerate(hashes) if enough[q]]
            if size:
                found[True, size] += [(int(x), at, q) for q, x in enumerate(windows(plain, k, size)[0])]
        self.index = {}
        for kind, rows_ in found.items():
            rows_.sort()
            self.index[kind] = (np.array([r[0] for r in rows_], np.uint64), [r[1:] for r in rows_])

    def leaks(self, text: str, cache: Words) -> list[tuple[object, int, int, int, int, bool]]:
        """(item, its words, covered words, changed slots, slots left out, verbatim) for each item that leaks into a text."""
        hashes, kinds, words, bare = views(text, cache)
        aligned: dict[tuple[int, int], set[int]] = defaultdict(set)
        for (plain, size), (keys, where) in self.index.items():
            seen, _ = windows(bare if plain else hashes, kinds, size)
            if not len(keys):
                continue
            lo = np.minimum(np.searchsorted(keys, seen, "left"), len(keys) - 1)
            for p in np.flatnonzero(keys[lo] == seen).tolist():
                for r in range(int(lo[p]), int(np.searchsorted(keys, seen[p], "right"))):
                    at, q = where[r]
                    aligned[at, p - q].update(range(q, q + size))
        covered: dict[int, set[int]] = defaultdict(set)
        slots: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for (at, shift), places in aligned.items():
            _, own, classes, plain, own_bare = self.items[at]
            equal = {q for q in places if own_bare[q] == bare[q + shift]}
            typed = {q for q in places if own[q] == hashes[q + shift]}  # against chance collisions
            good, changed, left = self.consistent(sorted(equal | typed), shift, classes, plain, words)
            covered[at] |= good
            slots[at] = [max(slots[at][0], changed), max(slots[at][1], left)]
        out = []
        for at, places in covered.items():
            item, own, _, _, _ = self.items[at]
            if len(places) >= COVER * len(own):
                changed, left = slots[at]
                out.append((item, len(own), len(places), changed, left, not changed and not left and len(places) == len(own)))
        return out

    @staticmethod
    def consistent(places: list[int], shift: int, kinds: np.ndarray, plain: list[str], words: list[str]) -> tuple[set[int], int, int]:
        """The places but for slots that a one-to-one renaming of each type doesn't explain, how many of
        them hold another value, and how many slots were left out."""
        pairs: dict[tuple[int, str, str], list[int]] = defaultdict(list)
        good = set(places)
        for q in places:
            if k := int(kinds[q]):
                pairs[k, word_class(plain[q])[3], word_class(words[q + shift])[3]].append(q)
        there, back = set(), set()
        changed = left = 0
        for (k, a, b), at in sorted(pairs.items(), key=lambda x: (-len(x[1]), x[0][1] != x[0][2], x[1])):
            if (k, a) in there or (k, b) in back:
                if a != b:
                    good.difference_update(at)
                    left += len(at)
                continue
            there.add((k, a))
            back.add((k, b))
            changed += len(at) * (a != b)
        return good, changed, left


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """The items, their ids as strings, in the ids' order, at most ``BLOCK`` words (or one item) a block."""
    rows, total = [], 0
    ordered = keyed(benchmark, item_col, text_col).orderBy("id", "text")
    for r in ordered.select(as_string(F.col("id"), benchmark.schema[item_col].dataType).alias("id"), "text").toLocalIterator():
        n = len(r["text"].split())
        if rows and total + n > BLOCK:
            yield Items(rows)
            rows, total = [], 0
        rows.append((r["id"], r["text"]))
        total += n
    if rows:
        yield Items(rows)


def as_string(c: Column, kind: DataType) -> Column:
    return F.hex(c) if isinstance(kind, BinaryType) else c.cast("string")


def from_string(c: Column, kind: DataType) -> Column:
    return F.unhex(c) if isinstance(kind, BinaryType) else c.cast(kind)


FOUND = {"item": pa.string(), "n_words": pa.int64(), "n_covered": pa.int64(), "n_changed": pa.int64(), "n_inconsistent": pa.int64(), "verbatim": pa.bool_()}


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, item_col, n_words (of the item), n_covered, n_changed (slots with another value),
    n_inconsistent (slots that don't count) and verbatim (every word and slot)."""
    rows = keyed(docs, id_col, text_col)
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType
    sc = docs.sparkSession.sparkContext

    def scan(items: Items) -> DataFrame:
        held = sc.broadcast(items)

        def run(batches) -> Iterator[pa.RecordBatch]:
            cache = Words()
            for batch in sliced(batches):
                ids, found = [], []
                for at, text in enumerate(batch.column(1).to_pylist()):
                    leaks = held.value.leaks(text, cache)
                    ids += [at] * len(leaks)
                    found += leaks
                columns = list(zip(*found, strict=True)) or [()] * len(FOUND)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, FOUND.values(), strict=True))], ["id", *FOUND])

        return rows.mapInArrow(run, f"id {kind}, item string, n_words bigint, n_covered bigint, n_changed bigint, n_inconsistent bigint, verbatim boolean")

    out = None
    for items in blocks(benchmark, item_col, item_text_col):
        out = scan(items) if out is None else out.unionAll(scan(items))
    if out is None:
        out = scan(Items([])).limit(0)
    name = item_col if item_col.lower() != id_col.lower() else f"item_{item_col}"
    return out.select(F.col("id").alias(id_col), from_string(F.col("item"), item_kind).alias(name), *list(FOUND)[1:])


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, into which no item leaks."""
    at = docs.columns.index(text_col)
    sc = docs.sparkSession.sparkContext
    for items in blocks(benchmark, item_col, item_text_col):

        def run(batches, held=sc.broadcast(items)) -> Iterator[pa.RecordBatch]:
            cache = Words()
            for batch in batches:
                yield batch.filter(pa.array([not held.value.leaks(t or "", cache) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
