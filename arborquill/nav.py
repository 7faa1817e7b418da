"""Sentences and words as local objects, over rows of ``sentences``; drawings of trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Word:
    """A word of a tree. ``id`` counts multiword lines, ``idx`` is the position that heads and matches use."""

    def __init__(self, tree: Tree, row):
        self.tree, self._row = tree, row

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self._row[name]
        except (ValueError, KeyError):
            raise AttributeError(name) from None

    @property
    def id(self) -> int:
        return self._row["word_id"]

    @property
    def xpos(self) -> str | None:
        return None if self._row["xpos"] == "_" else self._row["xpos"]

    @property
    def feats(self) -> dict[str, str]:
        return {p["k"]: p["v"] for p in self._row["feats"] or ()}

    @property
    def misc(self) -> dict[str, str]:
        return {p["k"]: p["v"] for p in self._row["misc"] or ()}

    @property
    def children_ids(self) -> list[int]:
        return self.tree.children_of[self.idx]

    def parent(self) -> Word | None:
        return None if self.head is None else self.tree[self.head]

    def children(self) -> list[Word]:
        return [self.tree[i] for i in self.children_ids]

    def children_by_deprel(self, deprel: str) -> list[Word]:
        return [w for w in self.children() if w.deprel == deprel]

    def __eq__(self, other) -> bool:
        return isinstance(other, Word) and self._row == other._row and self.tree.sent_id == other.tree.sent_id

    def __hash__(self) -> int:
        return hash((self.tree.sent_id, self.idx))

    def __repr__(self) -> str:
        return f"<Word id={self.id} form='{self.form}' lemma='{self.lemma}' upos='{self.upos}' deprel='{self.deprel}'>"


class Tree:
    def __init__(self, row: Row):
        self.row = row

    @property
    def sent_id(self) -> int:
        return self.row["sent_id"]

    @property
    def sentence_text(self) -> str | None:
        return self.row["text"]

    @property
    def metadata(self) -> dict[str, str]:
        return dict(self.row["metadata"] or {})

    @property
    def root_id(self) -> int | None:
        return self.row["root"]

    @cached_property
    def children_of(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.row["words"]]
        for w in self.row["words"]:
            if w["head"] is not None:
                out[w["head"]].append(w["idx"])
        return out

    def word(self, idx: int) -> Word:
        if idx < 0:
            raise OverflowError("can't convert negative int to unsigned")
        if idx >= len(self):
            raise IndexError(f"word index out of range: {idx}")
        return Word(self, self.row["words"][idx])

    __getitem__ = word

    def __len__(self) -> int:
        return len(self.row["words"])

    def __iter__(self) -> Iterator[Word]:
        return (self.word(i) for i in range(len(self)))

    def is_empty(self) -> bool:
        return not len(self)

    def check_rel(self, parent: int, child: int) -> bool:
        """Whether the one is the other's head."""
        return self.word(child).head == parent

    def find_path(self, top: int, low: int) -> list[int] | None:
        """Positions from top down to low, or None if it isn't below."""
        path = [low]
        while path[-1] != top and len(path) <= len(self):
            head = self.word(path[-1]).head
            if head is None:
                return None
            path.append(head)
        return path[::-1] if len(path) > 1 and path[-1] == top else None

    def to_displacy(self) -> dict:
        return to_displacy(self)

    def render(self, **options) -> str:
        return render(self, **options)

    def __eq__(self, other) -> bool:
        return isinstance(other, Tree) and self.row == other.row

    __hash__ = None

    def __repr__(self) -> str:
        if self.is_empty():
            return "<Tree (empty)>"
        shown = " ".join(w["form"] for w in self.row["words"][:3])
        return f"<Tree len={len(self)} words='{shown}{' ...' if len(self) > 3 else ''}'>"


def to_displacy(tree: Tree) -> dict:
    """A tree as displaCy's manual format; arcs in the order of their dependents."""
    arcs = []
    for w in tree:
        if w.head is not None:
            start, end = sorted((w.head, w.idx))
            arcs.append({"start": start, "end": end, "label": w.deprel, "dir": "right" if w.head < w.idx else "left"})
    return {"words": [{"text": w.form, "tag": w.upos} for w in tree], "arcs": arcs}


def render(tree: Tree, **options) -> str:
    """An SVG of the tree; needs spaCy."""
    try:
        from spacy import displacy
    except ImportError:
        raise ImportError("spaCy is required for rendering. Install it with: pip install spacy") from None
    return displacy.render(to_displacy(tree), style="dep", manual=True, **options)


def displacy_table(sentences: DataFrame) -> DataFrame:
    """sent_id, tokens (array of text, tag) and arcs (array of start, end, label, dir), for all sentences."""
    arc = "named_struct('start', least(w.head, w.idx), 'end', greatest(w.head, w.idx), 'label', w.deprel, 'dir', CASE WHEN w.head < w.idx THEN 'right' ELSE 'left' END)"
    return sentences.select("sent_id", F.expr("transform(words, w -> named_struct('text', w.form, 'tag', w.upos))").alias("tokens"), F.expr(f"transform(filter(words, w -> w.head IS NOT NULL), w -> {arc})").alias("arcs"))


def parents(words: DataFrame) -> DataFrame:
    """words, each with parent_<field> of the word that it hangs on: a join whose only key is sent_id."""
    above = words.select(F.col("sent_id").alias("other_id"), *(F.col(c).alias(f"parent_{c}") for c in ("idx", "form", "lemma", "upos", "deprel")))
    return words.join(above, (F.col("sent_id") == F.col("other_id")) & (F.col("head") - F.col("parent_idx") == 0), "left").drop("other_id")


def children(sentences: DataFrame, deprel: str | None = None) -> DataFrame:
    """sent_id, idx and child_ids (ascending) of every word, optionally of one relation only."""
    label = "" if deprel is None else " AND c.deprel = :label"
    text = f"transform(words, w -> named_struct('idx', w.idx, 'child_ids', transform(filter(words, c -> c.head = w.idx{label}), c -> c.idx)))"
    return sentences.select("sent_id", F.inline(F.expr(text.replace(":label", "'" + (deprel or "").replace("'", "''") + "'"))))
