"""Pattern search over flat words: self-joins within sentences, for words that are stored in rows.

Every join's only key is sent_id and all else is its condition: relations are written so that Catalyst
takes no second key from them. So each variable's filtered, pruned words are dealt out by sent_id once
(not at all, if the table is bucketed by it) and no join's result is dealt out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import MODES, Word, checked_edges, conjunction, field_test, head_test, ordered, relation, unequal_pairs
from ..plans.pattern import Block, ChildTest, Edge, FieldTest, HeadTest, Pattern
from .nested import column_names

ID = "sent_id"


class Joins:
    def __init__(self, words: DataFrame, sentences: DataFrame, mode: str):
        if mode not in MODES:
            raise ValueError(f"semantics must be one of {MODES}")
        self.words, self.sentences, self.mode, self.n = words, sentences, mode, 0

    def scan(self, block: Block, v: str, edges: list[Edge]) -> tuple[DataFrame, Word]:
        """The words that pass v's tests, with the fields that edges need."""
        self.n += 1
        mine = f"v{self.n}"
        needed = {"idx"}
        for e in edges:
            if v in e.ends and e.kind == "child":
                needed |= {"head", "deprel"} if e.negated and e.label is not None else {"head"}
        word: Word = lambda name: F.col(name)
        rows, children = self.words, []
        for test in block.tests.get(v, ()):
            if isinstance(test, FieldTest):
                rows = rows.where(field_test(test, word, self.mode))
            elif isinstance(test, HeadTest):
                rows = rows.where(head_test(test, word))
            else:
                children.append(test)
        for test in children:
            rows = self.with_children(rows, test)
        rows = rows.select(ID, *(F.col(f).alias(f"{mine}_{f}") for f in sorted(needed)))
        return rows, lambda name: F.col(f"{mine}_{name}")

    def with_children(self, rows: DataFrame, test: ChildTest) -> DataFrame:
        below = self.words.where(F.col("head").isNotNull())
        if test.label is not None:
            below = below.where(F.col("deprel") == F.lit(test.label))
        below = below.select(F.col(ID).alias("below_id"), F.col("head").alias("below_head"))
        on = (F.col(ID) == F.col("below_id")) & (F.col("below_head") - F.col("idx") == 0)
        return rows.join(below, on, "left_anti" if test.negated else "left_semi")

    def relation(self, e: Edge, at: dict[str, Word]) -> Column:
        """As a condition that gives no second join key."""
        source, target = at[e.source], at[e.target]
        if not e.negated and e.kind == "child":
            return target("head") - source("idx") == 0
        if e.kind == "next":
            return target("idx") - source("idx") == 1
        return relation(e, source, target)

    def block(self, block: Block, bound: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Word]]:
        """The block's solutions on their own; an empty block has one in each sentence."""
        edges = checked_edges(block, bound, self.mode)
        apart = unequal_pairs(block) if self.mode == "documented" else set()
        out, at = None, {}
        for v in ordered(Block(block.variables, block.tests, tuple(edges)), (), self.mode):
            rows, at[v] = self.scan(block, v, edges)
            conditions = [self.relation(e, at) for e in edges if v in e.ends and e.ends <= at.keys()]
            conditions += [at[v]("idx") != at[u]("idx") for u in at if u != v and frozenset((u, v)) not in apart]
            if out is None:
                out = rows.where(conjunction(conditions)) if conditions else rows
            else:
                rows = rows.withColumnRenamed(ID, "other_id")
                out = out.join(rows, conjunction([F.col(ID) == F.col("other_id"), *conditions])).drop("other_id")
        if out is None:
            out = self.sentences.select(ID)
        return out, at

    def extend(self, base: DataFrame, bound: dict[str, Word], block: Block, how: str) -> tuple[DataFrame, dict[str, Word]]:
        """base joined with the block's solutions on the variables that it shares."""
        found, at = self.block(block, tuple(bound))
        found = found.withColumnRenamed(ID, "other_id")
        same = [F.col(ID) == F.col("other_id"), *(bound[v]("idx") - at[v]("idx") == 0 for v in at if v in bound)]
        return base.join(found, conjunction(same), how), at


def search_words(words: DataFrame, sentences: DataFrame, pattern: Pattern, mode: str = "documented") -> DataFrame:
    """A row per match: sent_id and each variable's position, null if an OPTIONAL block isn't there."""
    joins = Joins(words, sentences, mode)
    rows, bound = joins.block(pattern.match)
    for block in pattern.excepts:
        rows, _ = joins.extend(rows, bound, block, "left_anti")
    every = dict(bound)
    for block in pattern.optionals:
        new = block.new(tuple(bound))
        if new:
            rows, at = joins.extend(rows, bound, block, "left")
            rows = rows.drop("other_id")
            every |= {v: at[v] for v in new}
    return rows.select(ID, *(every[v]("idx").alias(n) for v, n in zip(pattern.names, column_names(pattern.names), strict=True)))


def filter_words(words: DataFrame, sentences: DataFrame, pattern: Pattern, mode: str = "documented") -> DataFrame:
    """The sentences with a match."""
    hits = search_words(words, sentences, Pattern(pattern.match, pattern.excepts), mode).select(ID)
    return sentences.join(hits, ID, "left_semi")
