"""Pattern search within nested sentences: no join and no shuffle, whatever the pattern.

MATCH: each variable is one generator over the sentence's words with a filter behind it, or, where a
bound word determines it, one array lookup. Spark compiles such a chain into nested loops of one stage.
EXCEPT: nested ``exists`` over the words, ending at the first hit. OPTIONAL: the array of a block's
solutions for a base match, exploded. Only the words' fields that the pattern names are read.

Sentences are independent, so a pattern runs on streams as well.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import MODES, Word, checked_edges, conjunction, field_test, fields_needed, fixes, head_test, never_null, ordered, relation, unequal_pairs
from ..plans.pattern import Block, ChildTest, Edge, FieldTest, HeadTest, Pattern

W = "w_"


def field_of(c: Column) -> Word:
    return lambda name: c.getField(name)


class Search:
    """A pattern's parts over the array column ``W``."""

    def __init__(self, pattern: Pattern, mode: str = "documented"):
        if mode not in MODES:
            raise ValueError(f"semantics must be one of {MODES}")
        self.pattern, self.mode, self.words = pattern, mode, F.col(W)

    def test(self, test, word: Word) -> Column:
        if isinstance(test, FieldTest):
            return field_test(test, word, self.mode)
        if isinstance(test, HeadTest):
            return head_test(test, word)
        assert isinstance(test, ChildTest)
        if test.label is None:
            found = F.array_contains(self.words.getField("head"), word("idx"))
        else:
            found = F.exists(self.words, lambda c: (c["head"] == word("idx")) & (c["deprel"] == F.lit(test.label)))
        return ~never_null(found) if test.negated else found

    def tests(self, block: Block, v: str, word: Word) -> list[Column]:
        return [self.test(t, word) for t in block.tests.get(v, ())]

    def place(self, block: Block, v: str, bound: Mapping[str, Word], edges: list[Edge]) -> Column | None:
        """The position of v if a bound word determines it."""
        for e in edges:
            if v in e.ends and fixes(e, v) and (other := next(iter(e.ends - {v}))) in bound:
                if e.kind == "child":
                    return bound[other]("head")
                return bound[other]("idx") + (1 if e.target == v else -1)
        return None

    def conditions(self, block: Block, v: str, bound: Mapping[str, Word], edges: list[Edge]) -> list[Column]:
        """Tests of v, its edges to bound words and itself, and that it's none of the block's bound words."""
        at = {**bound, v: bound[v]}
        out = self.tests(block, v, at[v])
        out += [relation(e, at[e.source], at[e.target]) for e in edges if v in e.ends and e.ends <= at.keys()]
        apart = unequal_pairs(block) if self.mode == "documented" else set()
        out += [at[v]("idx") != at[u]("idx") for u in block.variables if u != v and u in at and frozenset((u, v)) not in apart]
        return out

    def entry_conditions(self, block: Block, bound: Mapping[str, Word]) -> list[Column]:
        """What a block asks of words that are bound before it."""
        known = tuple(bound)
        edges = checked_edges(block, known, self.mode)
        out = [c for v in block.variables if v in bound for c in self.tests(block, v, bound[v])]
        return out + [relation(e, bound[e.source], bound[e.target]) for e in edges if e.ends <= bound.keys()]

    def some(self, block: Block, bound: Mapping[str, Word], then: Callable[[Mapping[str, Word]], Column | None] = lambda _: None) -> Column:
        """Whether the block has a solution (for which ``then`` holds)."""
        edges = checked_edges(block, tuple(bound), self.mode)

        def search(left: list[str], at: Mapping[str, Word]) -> Column:
            if not left:
                last = then(at)
                return F.lit(True) if last is None else last
            v, rest = left[0], left[1:]

            def holds(word: Word) -> Column:
                here = {**at, v: word}
                parts = self.conditions(block, v, here, edges)
                if rest or then(here) is not None:
                    parts.append(search(rest, here))
                return conjunction(parts)

            place = self.place(block, v, at, edges)
            if place is not None:
                found = F.get(self.words, place)
                return found.isNotNull() & holds(field_of(found))
            return F.exists(self.words, lambda x: never_null(holds(field_of(x))))

        return conjunction([*self.entry_conditions(block, bound), search(ordered(block, tuple(bound), self.mode), dict(bound))])

    def solutions(self, block: Block, bound: Mapping[str, Word], make: Callable[[Mapping[str, Word]], Column]) -> Column:
        """Array of ``make`` of each solution of the block; empty if there's none."""
        edges = checked_edges(block, tuple(bound), self.mode)

        def search(left: list[str], at: Mapping[str, Word]) -> Column:
            v, rest = left[0], left[1:]
            found = F.filter(self.words, lambda x: never_null(conjunction(self.conditions(block, v, {**at, v: field_of(x)}, edges))))
            if not rest:
                return F.transform(found, lambda x: make({**at, v: field_of(x)}))
            return F.flatten(F.transform(found, lambda x: search(rest, {**at, v: field_of(x)})))

        every = search(ordered(block, tuple(bound), self.mode), dict(bound))
        entry = self.entry_conditions(block, bound)
        return F.when(conjunction(entry), every) if entry else every

    def rejected(self, bound: Mapping[str, Word]) -> Column | None:
        """Whether any EXCEPT block has a solution."""
        if not self.pattern.excepts:
            return None
        out = F.lit(False)
        for block in self.pattern.excepts:
            out = out | never_null(self.some(block, bound))
        return out

    def holds(self) -> Column:
        """Whether a sentence has a match."""

        def accepted(bound: Mapping[str, Word]) -> Column | None:
            rejected = self.rejected(bound)
            return None if rejected is None else ~rejected

        return never_null(self.some(self.pattern.match, {}, accepted))


def zipped(needed: set[str]) -> Column:
    """The words with these fields only, so that no other is read."""
    return F.arrays_zip(*(F.col(f"words.{name}") for name in sorted(needed)))


def filter_sentences(sentences: DataFrame, pattern: Pattern, mode: str = "documented") -> DataFrame:
    """The sentences with a match."""
    search = Search(pattern, mode)

    def holds(words: Column) -> Column:
        search.words = words
        return search.holds()

    # bound to a lambda's variable, the zipped words are made once a sentence
    return sentences.where(F.exists(F.array(zipped(fields_needed([pattern.match, *pattern.excepts]))), holds))


def search_sentences(
    sentences: DataFrame,
    pattern: Pattern,
    mode: str = "documented",
    keep: Sequence[str] = ("sent_id",),
    fields: Mapping[str, Sequence[str]] | None = None,
    paths: Mapping[str, tuple[str, str]] | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """A row per match: ``keep``, columns of sentences; each variable's position, null if an OPTIONAL
    block isn't there; ``fields``, of a variable's word, as <variable>_<field>; ``paths``, positions from
    the first variable down to the second, null if it isn't below. ``names`` of the variables' columns."""
    search = Search(pattern, mode)
    fields, paths = fields or {}, paths or {}
    if unknown := {*fields, *(v for p in paths.values() for v in p)} - {*pattern.names}:
        raise ValueError(f"no such variables: {', '.join(sorted(unknown))}")
    needed = fields_needed([pattern.match, *pattern.excepts, *pattern.optionals]).union(*fields.values())
    if paths:
        needed.add("head")
    words = F.explode(F.array(zipped(needed)))  # a generator, which no filter is pushed through: they're made once a sentence
    rows = sentences.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), words.alias(W))
    bound: dict[str, Word] = {}
    block = pattern.match
    edges = checked_edges(block, (), mode)
    for i, v in enumerate(ordered(block, (), mode)):
        place = search.place(block, v, bound, edges)
        name = f"word_{i}"
        one = F.explode(search.words) if place is None else F.get(search.words, place)
        rows = rows.select("*", one.alias(name))
        conditions = search.conditions(block, v, {**bound, v: field_of(F.col(name))}, edges)
        if place is not None:
            conditions.insert(0, F.col(name).isNotNull())
        bound[v] = field_of(F.col(name))
        rows = rows.where(conjunction(conditions)) if conditions else rows
    rejected = search.rejected(bound)
    if rejected is not None:
        rows = rows.where(~rejected)
    base = dict(bound)
    for k, block in enumerate(pattern.optionals):
        new = block.new(tuple(base))
        if not new:
            continue

        def record(at: Mapping[str, Word], new: tuple[str, ...] = new) -> Column:
            return F.struct(*(F.struct(*(at[v](f).alias(f) for f in dict.fromkeys(("idx", *fields.get(v, ()))))).alias(f"n{j}") for j, v in enumerate(new)))

        rows = rows.select("*", F.explode_outer(search.solutions(block, base, record)).alias(f"found_{k}"))
        for j, v in enumerate(new):
            bound[v] = field_of(F.col(f"found_{k}").getField(f"n{j}"))
    out = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    out += [bound[v]("idx").alias(n) for v, n in zip(pattern.names, names or column_names(pattern.names, keep), strict=True)]
    out += [bound[v](f).alias(f"{v}_{f}") for v, fs in fields.items() for f in fs]
    out += [path_between(search.words.getField("head"), bound[a]("idx"), bound[b]("idx")).alias(p) for p, (a, b) in paths.items()]
    return rows.select(*out)


def path_between(heads: Column, top: Column, low: Column) -> Column:
    """Positions from ``top`` down to ``low``, both included; null if they're equal or it isn't below.

    Goes up from ``low`` at most as many steps as there are words, so a cycle does no harm."""
    start = F.array(low)
    up = lambda path, _: F.when((F.element_at(path, -1) == top) | F.get(heads, F.element_at(path, -1)).isNull(), path).otherwise(F.array_append(path, F.get(heads, F.element_at(path, -1))))
    return F.aggregate(heads, start, up, lambda path: F.when((F.element_at(path, -1) == top) & (top != low), F.reverse(path)))


def column_names(variables: Sequence[str], taken: Sequence[str] = ("sent_id",)) -> list[str]:
    """Variables are case-sensitive and columns aren't: a name that clashes gets a number."""
    seen, out = {t.lower() for t in taken}, []
    for v in variables:
        name, k = v, 2
        while name.lower() in seen:
            name, k = f"{v}__{k}", k + 1
        seen.add(name.lower())
        out.append(name)
    return out
