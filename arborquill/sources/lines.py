"""Sentences from lines of CoNLL-U, in Python: the exact reader of files and strings.

A sentence ends at an empty line; comments that no word follows belong to the next sentence. A faulty
line gives an error in place of its sentence, and reading goes on after the next empty line.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

LARGEST = 2**31 - 1


class LineError(ValueError):
    """What's wrong with a line."""


@dataclass
class Sentence:
    text: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    #: In the order of schema.WORD_FIELDS.
    words: list[tuple] = field(default_factory=list)
    tokens: int = 0


@dataclass
class Fault:
    line: int
    content: str
    message: str

    def __str__(self) -> str:
        return f"Parse error at line {self.line}: {self.message}\n  Line: {self.content}"


def number(text: str) -> int | None:
    """Digits only; nothing is zero; null if it's no number or too large."""
    if not text:
        return 0
    if not (text.isascii() and text.isdigit()):
        return None
    n = int(text)
    return n if n <= LARGEST else None


@lru_cache(1 << 16)
def pairs(text: str) -> tuple[tuple[str, str], ...]:
    """Of a cell; most are seen again and again."""
    if text == "_":
        return ()
    out = []
    for part in text.split("|"):
        key, sign, value = part.partition("=")
        if not sign:
            raise LineError(f"Invalid FEATS pair (missing '='): {part}")
        out.append((key, value))
    return tuple(out)


def add_word(sentence: Sentence, line: str) -> None:
    """A token line; one of a multiword token only counts."""
    cells = line.split("\t")
    rank = sentence.tokens
    if "-" in cells[0]:
        sentence.tokens += 1
        return
    if "." in cells[0]:
        raise LineError(f"Empty nodes are not supported: {cells[0]}")
    token = number(cells[0])
    if token is None:
        raise LineError(f"Invalid token ID: {cells[0]}")
    n = len(cells)
    if n < 6:
        raise LineError(f"Missing field {n}")
    feats = pairs(cells[5])
    if n < 7:
        raise LineError("Missing field 6")
    head = None if cells[6] in ("0", "_") else number(cells[6])
    if head is None and cells[6] not in ("0", "_") or head == 0:
        raise LineError(f"Invalid HEAD: {cells[6]}")
    if n < 9:
        raise LineError(f"Missing field {n}")
    if cells[8] != "_":
        raise LineError("Extended deprels not yet supported")
    if n < 10:
        raise LineError("Missing field 9")
    misc = pairs(cells[9])
    if n > 10:
        raise LineError("Expected 10 fields, found more than 10")
    sentence.words.append((len(sentence.words), rank, token, cells[1], cells[2], cells[3], cells[4], feats, None if head is None else head - 1, cells[7], misc))
    sentence.tokens += 1


def add_comment(sentence: Sentence, line: str) -> None:
    key, sign, value = line[1:].partition("=")
    if not sign:
        return
    if key.strip() == "text":
        sentence.text = value.strip()
    else:
        sentence.metadata[key.strip()] = value.strip()


def sentences(lines: Iterable[str]) -> Iterator[Sentence | Fault]:
    """From lines with or without their ends (only a newline ends one)."""
    now, skipping = Sentence(), False
    for at, line in enumerate(lines, 1):
        line = line.removesuffix("\n")
        if not line:
            if now.tokens:
                yield finished(now, at)
                now = Sentence()
            skipping = False
        elif skipping:
            continue
        elif line[0] == "#":
            add_comment(now, line)
        else:
            try:
                add_word(now, line)
            except LineError as e:
                yield Fault(at, line, str(e))
                now, skipping = Sentence(), True
    if now.tokens:
        yield finished(now, at + 1)


def finished(sentence: Sentence, at: int) -> Sentence | Fault:
    """A head beyond the words is a fault."""
    for word in sentence.words:
        if word[8] is not None and word[8] >= len(sentence.words):
            return Fault(at - 1, word[3], f"Invalid HEAD: {word[8] + 1}")
    return sentence


def root_of(words: list[tuple]) -> int | None:
    """The last word without a head."""
    return next((w[0] for w in reversed(words) if w[8] is None), None)
