"""Matches by trying every assignment of words, for comparison."""

from __future__ import annotations

import itertools
import re

from arborquill.plans.pattern import Block, ChildTest, FieldTest, Pattern


def value_fits(value, text: str) -> bool:
    return re.fullmatch(value.text, text) is not None if value.regex else value.text == text


def passes(test, word: dict, words: list[dict]) -> bool:
    if isinstance(test, FieldTest):
        texts = [word[test.field]] if test.key is None else [v for k, v in word[test.field] if k == test.key]
        return any(value_fits(test.value, t) for t in texts) != test.negated
    if isinstance(test, ChildTest):
        found = any(w["head"] == word["idx"] and test.label in (None, w["deprel"]) for w in words)
    else:
        found = word["head"] is not None and test.label in (None, word["deprel"])
    return found != test.negated


def holds(edge, a: dict, b: dict) -> bool:
    if edge.kind == "before":
        return a["idx"] < b["idx"]
    if edge.kind == "next":
        return a["idx"] + 1 == b["idx"]
    return (b["head"] == a["idx"] and edge.label in (None, b["deprel"])) != edge.negated


def solve(block: Block, words: list[dict], bound: dict[str, int], mode: str):
    new = block.new(tuple(bound))
    for places in itertools.product(range(len(words)), repeat=len(new)):
        at = bound | dict(zip(new, places, strict=True))
        used = [at[v] for v in block.variables]
        if len(set(used)) < len(used):
            continue
        if not all(passes(t, words[at[v]], words) for v in block.variables for t in block.tests.get(v, ())):
            continue
        unchecked = lambda e: mode == "reference" and (e.source == e.target or e.ends <= bound.keys())
        if all(unchecked(e) or holds(e, words[at[e.source]], words[at[e.target]]) for e in block.edges):
            yield {v: at[v] for v in new}


def matches(pattern: Pattern, words: list[dict], mode: str = "documented") -> list[tuple]:
    """A tuple of positions, by ``pattern.names``, per match; sorted."""
    out = []
    for base in solve(pattern.match, words, {}, mode):
        if any(next(solve(b, words, base, mode), None) is not None for b in pattern.excepts):
            continue
        found = [base]
        for block in pattern.optionals:
            if block.new(tuple(base)):
                more = list(solve(block, words, base, mode)) or [{}]
                found = [f | m for f in found for m in more]
        out += [tuple(f.get(v) for v in pattern.names) for f in found]
    return sorted(out, key=lambda t: tuple(-1 if x is None else x for x in t))
