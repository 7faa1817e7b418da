"""Patterns: what the pattern language says, lowered to predicates on words and relations between them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Value:
    """A literal, or the source of a regular expression."""

    text: str
    regex: bool = False


@dataclass(frozen=True)
class FieldTest:
    """``field="v"``; for feats and misc with a key."""

    field: str
    value: Value
    key: str | None = None
    negated: bool = False


@dataclass(frozen=True)
class HeadTest:
    """``_ -[label]-> X``: X hangs on some word."""

    label: str | None = None
    negated: bool = False


@dataclass(frozen=True)
class ChildTest:
    """``X -[label]-> _``: some word hangs on X."""

    label: str | None = None
    negated: bool = False


Test = FieldTest | HeadTest | ChildTest


@dataclass(frozen=True)
class Edge:
    """kind: child (source is the head of target), next or before (in the order of words)."""

    kind: str
    source: str
    target: str
    label: str | None = None
    negated: bool = False

    @property
    def ends(self) -> set[str]:
        return {self.source, self.target}


@dataclass(frozen=True)
class Block:
    """variables, in the order of their first mention, with the tests that each must pass; edges."""

    variables: tuple[str, ...] = ()
    tests: dict[str, tuple[Test, ...]] = field(default_factory=dict)
    edges: tuple[Edge, ...] = ()

    def new(self, known: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(v for v in self.variables if v not in known)


@dataclass(frozen=True)
class Pattern:
    match: Block
    excepts: tuple[Block, ...] = ()
    optionals: tuple[Block, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        """Variables that a match can bind."""
        out = list(self.match.variables)
        for block in self.optionals:
            out += block.new(tuple(out))
        return tuple(out)

    def __repr__(self) -> str:
        return f"Pattern({len(self.match.variables)} vars)"


class BlockBuilder:
    """Gathers statements; anonymous ends become tests, and a positive label is also a test of its target."""

    ANY = "_"

    def __init__(self):
        self.tests: dict[str, list[Test]] = {}
        self.declared: set[str] = set()
        self.edges: list[Edge] = []

    def declare(self, name: str, tests: list[Test]) -> bool:
        """False if the name is declared already."""
        if name in self.declared:
            return False
        self.declared.add(name)
        self.tests.setdefault(name, []).extend(tests)
        return True

    def relate(self, edge: Edge) -> None:
        free = [end == self.ANY for end in (edge.source, edge.target)]
        if all(free):
            return
        if free[0]:
            self.tests.setdefault(edge.target, []).append(HeadTest(edge.label, edge.negated))
            return
        if free[1]:
            self.tests.setdefault(edge.source, []).append(ChildTest(edge.label, edge.negated))
            return
        for end in (edge.source, edge.target):
            self.tests.setdefault(end, [])
        if edge.label is not None and not edge.negated:
            self.tests[edge.target].append(FieldTest("deprel", Value(edge.label)))
        self.edges.append(edge)

    def build(self) -> Block:
        return Block(tuple(self.tests), {k: tuple(dict.fromkeys(v)) for k, v in self.tests.items()}, tuple(dict.fromkeys(self.edges)))
