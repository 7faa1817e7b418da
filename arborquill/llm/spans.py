"""Regular-expression matches with their places, in SQL expressions alone.

``split`` gives the gaps between the matches that ``regexp_extract_all`` gives, in the same order, so
running sums of their lengths are the matches' places. All in one row: no shuffle, and a text of any
length stays whole. Possessive quantifiers and starts at a run's beginning only keep the time linear.

What runs along an array in order (sums, furthest ends) is a :func:`scan`, which combines elements at
distances 1, 2, 4 and so on. An ``aggregate`` that gathers an array would copy it at each of its steps; a
text may hold hundreds of thousands of matches.
"""

from __future__ import annotations

SPAN = "struct<lo:int,hi:int,text:string,before:string,after:string>"
#: Code points of context kept before a match.
CONTEXT = 24


def literal(text: str) -> str:
    """A raw SQL string literal; a rule with both quotes writes them as \\x22 and \\x27."""
    for quote in ('"', "'"):
        if quote not in text:
            return f"r{quote}{text}{quote}"
    raise ValueError(text)


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to a value that is computed once, whatever the optimizer merges."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(values: str, combine: str) -> str:
    """SQL: of an array of int, each element combined with all before it; ``combine`` is of ``x`` and ``y``,
    associative and commutative. Time n log n."""
    far = "a[i - shiftleft(1, k)]"
    step = f"transform(a, (x, i) -> CASE WHEN i >= shiftleft(1, k) THEN {combine.replace('y', far)} ELSE x END)"
    return let("v", values, f"CASE WHEN size(v) > 1 THEN aggregate(sequence(0, cast(ceil(log2(size(v))) AS int) - 1), v, (a, k) -> {step}) ELSE v END")


def furthest(values: str) -> str:
    return scan(values, "greatest(x, y)")


def nearest(values: str) -> str:
    """SQL: the least of each element and all behind it."""
    return f"reverse({scan(f'reverse({values})', 'least(x, y)')})"


def matches(text: str, regex: str, guard: str = "true") -> str:
    """SQL: array of matched strings."""
    return f"CASE WHEN {guard} THEN regexp_extract_all({text}, {literal(regex)}, 0) ELSE cast(array() AS array<string>) END"


def places(text: str, regex: str, found: str) -> str:
    """SQL: array of ``SPAN`` for the matches in column ``found``; ends are exclusive, code points."""
    ends = scan(f"transform({found}, (m, i) -> length(g[i]) + length(m))", "x + y")
    span = f"named_struct('lo', e - length({found}[i]), 'hi', e, 'text', {found}[i], 'before', right(g[i], {CONTEXT}), 'after', left(g[i + 1], 1))"
    return f"CASE WHEN size({found}) > 0 THEN {let('g', f'split({text}, {literal(regex)}, -1)', f'transform({ends}, (e, i) -> {span})')} ELSE cast(array() AS array<{SPAN}>) END"


def listed(spans: str, kind: str) -> str:
    """SQL: array of ``kind:start:end``."""
    return f"transform({spans}, s -> concat({kind}, ':', s.lo, ':', s.hi))"


def apart(own: str, other: str) -> str:
    """SQL: the intervals in ``own`` that overlap none in ``other``, by their places."""
    events = f"array_sort(concat(transform({other}, o -> named_struct('lo', o.lo, 'hi', o.hi, 'i', -1)), transform({own}, (o, i) -> named_struct('lo', o.lo, 'hi', o.hi, 'i', i))))"
    past, next_ = furthest("transform(ev, e -> CASE WHEN e.i < 0 THEN e.hi ELSE -1 END)"), nearest("transform(ev, e -> CASE WHEN e.i < 0 THEN e.lo ELSE 2147483647 END)")
    clear = let("past", past, let("next", next_, "filter(transform(ev, (e, i) -> CASE WHEN past[i] <= e.lo AND next[i] >= e.hi THEN e.i ELSE -1 END), i -> i >= 0)"))
    return f"CASE WHEN size({own}) > 0 AND size({other}) > 0 THEN transform({let('ev', events, clear)}, i -> {own}[i]) ELSE {own} END"


def disjoint(spans: str, kind: str) -> str:
    """SQL: of ``spans`` (an array of ``kind`` in the order of preference by start) those that begin after the
    last one taken ends. Choices are made within each run of spans that overlap, so they gather little."""
    chosen = "named_struct('at', x.hi, 'out', concat(s.out, array(x)))"
    run = f"aggregate(slice(sp, b, coalesce(get(starts, k + 1), size(sp) + 1) - b), named_struct('at', 0, 'out', cast(array() AS array<{kind}>)), (s, x) -> CASE WHEN x.lo >= s.at THEN {chosen} ELSE s END, s -> s.out)"
    starts = f"{let('past', furthest('transform(sp, x -> x.hi)'), 'filter(sequence(1, size(sp)), i -> i = 1 OR sp[i - 1].lo >= past[i - 2])')}"
    return let("sp", spans, f"CASE WHEN size(sp) > 0 THEN {let('starts', starts, f'flatten(transform(starts, (b, k) -> {run}))')} ELSE cast(array() AS array<{kind}>) END")
