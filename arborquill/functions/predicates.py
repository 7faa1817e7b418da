"""Tests and relations as Columns, over any way to reach a word's fields.

A word is a callable from field name to Column. Two modes of semantics: "documented", the default,
and "reference", in which an expression's anchors bind to its outer alternatives only, and edges of a
variable to itself, or in a further block between two variables of MATCH, aren't checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.pattern import Block, ChildTest, Edge, FieldTest, HeadTest, Test, Value
from .regex import literals, to_java

Word = Callable[[str], Column]
MODES = ("documented", "reference")


def equals(c: Column, value: Value, mode: str) -> Column:
    if not value.regex:
        return c == F.lit(value.text)
    options = literals(value.text)
    if options and (mode == "documented" or len(options) == 1):
        return c.isin(options) if len(options) > 1 else c == F.lit(options[0])
    return c.rlike(to_java(value.text, grouped=mode == "documented"))


def never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def field_test(test: FieldTest, word: Word, mode: str) -> Column:
    c = word(test.field)
    if test.key is None:
        found = equals(c, test.value, mode)
    elif test.value.regex:
        found = F.exists(c, lambda p: (p["k"] == F.lit(test.key)) & equals(p["v"], test.value, mode))
    else:
        found = F.array_contains(c, F.struct(F.lit(test.key).alias("k"), F.lit(test.value.text).alias("v")))
    return ~never_null(found) if test.negated else found


def head_test(test: HeadTest, word: Word) -> Column:
    found = word("head").isNotNull()
    if test.label is not None:
        found = found & never_null(word("deprel") == F.lit(test.label))
    return ~found if test.negated else found


def relation(edge: Edge, source: Word, target: Word) -> Column:
    """Whether the edge holds (its label on a positive edge is a test of the target already)."""
    if edge.kind == "before":
        return source("idx") < target("idx")
    if edge.kind == "next":
        return target("idx") == source("idx") + 1
    if not edge.negated:
        return target("head") == source("idx")
    found = target("head").eqNullSafe(source("idx"))
    if edge.label is not None:
        found = found & target("deprel").eqNullSafe(F.lit(edge.label))
    return ~found


def checked_edges(block: Block, bound: tuple[str, ...], mode: str) -> list[Edge]:
    """The edges that count, in a block some of whose variables are bound already."""
    if mode == "documented":
        return list(block.edges)
    return [e for e in block.edges if e.source != e.target and not e.ends <= set(bound)]


def fields_of(test: Test) -> set[str]:
    if isinstance(test, FieldTest):
        return {test.field}
    if isinstance(test, HeadTest):
        return {"head", "deprel"} if test.label is not None else {"head"}
    return {"idx", "head", "deprel"} if test.label is not None else {"idx", "head"}


def fields_needed(blocks: list[Block]) -> set[str]:
    out = {"idx"}
    for block in blocks:
        for tests in block.tests.values():
            for test in tests:
                out |= fields_of(test)
        for edge in block.edges:
            if edge.kind == "child":
                out |= {"head", "deprel"} if edge.negated and edge.label is not None else {"head"}
    return out


def conjunction(parts: list[Column]) -> Column:
    out = F.lit(True)
    for i, part in enumerate(parts):
        out = part if i == 0 else out & part
    return out


def ordered(block: Block, bound: tuple[str, ...], mode: str) -> list[str]:
    """The block's new variables in the order of search: most selective first, then what hangs together.

    Next comes the variable that a bound one determines, then one with a head among them, then one
    with any relation to them; ties go by the number of equality tests and the order in the text."""
    edges = checked_edges(block, bound, mode)
    weight = {v: sum(2 if isinstance(t, FieldTest) and not t.negated and not t.value.regex else 1 for t in block.tests.get(v, ())) for v in block.variables}
    known, left, out = set(bound) & set(block.variables), list(block.new(bound)), []
    while left:

        def rank(v: str) -> tuple:
            near = [e for e in edges if v in e.ends and len(e.ends) == 2 and (e.ends - {v}) <= known]
            fixed = any(fixes(e, v) for e in near)
            hangs = any(e.kind == "child" and not e.negated for e in near)
            return (not fixed, not hangs, not near, -weight[v], block.variables.index(v))

        best = min(left, key=rank)
        left.remove(best)
        known.add(best)
        out.append(best)
    return out


def fixes(edge: Edge, v: str) -> bool:
    """Whether the edge's other end determines v: the head of a bound word, or a word's neighbour."""
    if edge.negated or edge.source == edge.target:
        return False
    return edge.kind == "next" or edge.kind == "child" and edge.source == v


def unequal_pairs(block: Block) -> set[frozenset[str]]:
    """Pairs of variables whose order already says that they're different words."""
    return {frozenset(e.ends) for e in block.edges if e.kind in ("before", "next") and len(e.ends) == 2}


__all__ = ["Block", "ChildTest", "MODES", "Word"]
