"""Personal data: generators propose, boosted trees decide.

Base rules (see ``BASE``) always count. Beside them, several wide generators of each kind propose
overlapping candidate spans: addresses with a written-out at or dot, local phone numbers, numbers with
other separators. Each candidate gets a vector of small discrete features of its format and context. What
only tells a base match from another form of the same thing (a plus and country code, the sign between an
address's parts, separators) is taken out of the text first, so the trees can't learn the base rules.

Gradient-boosted trees, a model per kind, are taught by
- positive examples: the base spans;
- hard negatives: candidates that overlap no base span and fail their kind's check (Luhn, octets, a domain
  of letters, the number of digits) or stand within a longer word; and of each base span counterparts of
  the same features that fail the check, stand within a word, or lack its shape, so that no kind lacks
  negatives and formats that the corpus never shows aren't taken for known ones.
All other candidates are unlabelled: nothing is learnt from them, and they're what may be added. Per kind
the threshold is the lowest score above which at least ``PRECISION`` of the labelled examples in a
held-back tenth of the documents are positive, but no lower than the score that ``RECALL`` of the positive
ones reach. Candidates that touch a base span or an earlier selected one are left out.

Everything on the data runs in SQL expressions within a row, in one pass over the texts: places and
features are written out, without the texts, and both training and selection read these. Training needs
only the counts of distinct vectors, a table of at most ``BOUND`` rows whatever the corpus, summed over all
documents.

Edge cases: a null or empty text has no spans; a kind without base spans in both parts of the documents
learns nothing and only base spans count. Rows are independent, repeated rows get the same spans, and
empty tables work. A text with very many matches takes time in proportion to them.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, keyed
from .spans import SPAN, apart, disjoint, furthest, let, literal, matches, places

KINDS = ("email", "ip", "card", "phone")
#: The rules' expressions in a linear-time form; what they match is the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
AT, DOT = r"(?:\s?[\[({]\s?[aA][tT]\s?[\])}]\s?|\s[aA][tT]\s)", r"(?:\s?[\[({]\s?(?:[dD][oO][tT]|\.)\s?[\])}]\s?|\s[dD][oO][tT]\s)"
WIDE = {
    "email": (
        r"(?<![^\s<>()\[\],;:\x22])[^\s<>()\[\],;:\x22@]++@[^\s<>()\[\],;:\x22@]++",
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]++(?:(?:{DOT}|\.)[A-Za-z0-9-]++)++",
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+\s?@\s?[A-Za-z0-9-]++(?:(?:{DOT}|\.)[A-Za-z0-9-]++)++",
    ),
    "ip": (
        r"(?<![0-9])[0-9]{1,3}+(?:[.,:-][0-9]{1,3}+){3}(?![0-9])",
        r"(?<![0-9])[0-9]{1,3}+(?:\s?[\[({]?(?:\.|[dD][oO][tT])[\])}]?\s?[0-9]{1,3}+){3}(?![0-9])",
    ),
    "card": (
        r"(?<![0-9])[0-9]{4,6}+(?:[ ./-]?[0-9]{2,6}+){2,5}+",
        r"(?<![0-9])[0-9]{3,6}+(?:[ ._/-]{1,3}[0-9]{2,6}+){2,5}+(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9])\(?[0-9]{2,4}\)?[ ./-]{0,2}[0-9]{3,4}[ ./-][0-9]{3,4}(?![./-]?[0-9])",
        r"(?<![0-9+])00[1-9][ ().0-9/-]{7,20}[0-9](?![0-9])",
        r"(?<![0-9+.,])\(?0[0-9][ ().0-9/-]{6,20}[0-9](?![0-9])",
    ),
}
NEAR = {"email": "mail|contact|write|@", "ip": "ip|host|server|addr", "card": "card|visa|pay|credit", "phone": "tel|phone|call|fax|mobile"}
GUARD = {
    "email": "instr(text, '@') > 0",
    "wide_email_0": "instr(text, '@') > 0",
    "wide_email_1": f"text RLIKE {literal('[aA][tT]' + chr(92) + 's?[' + chr(92) + '])}]')} OR instr(text, ' dot ') > 0 OR instr(text, ' DOT ') > 0",
    "wide_email_2": "instr(text, '@') > 0",
}
#: Of a span's text, what remains without the marks of one way of writing it.
MASKED = {
    "email": f"regexp_replace(regexp_replace(s.text, {literal(AT + '|' + chr(92) + 's?@' + chr(92) + 's?')}, '@'), {literal(DOT)}, '.')",
    "ip": f"regexp_replace(s.text, {literal(r'\s?[\[({]?(?:[.,:-]|[dD][oO][tT])[\])}]?\s?')}, '.')",
    "card": "s.text",
    "phone": f"regexp_replace(s.text, {literal(r'^(?:\+|00)(?:[0-9]{1,3}[ .(/-]+|[0-9]{1,2}(?=[0-9]{9}))')}, '')",
}

#: Feature -> number of values; the product bounds the table of counts.
FEATURES = {"digits": 8, "groups": 5, "check": 2, "before": 3, "after": 3, "near": 2, "shape": 4}
NEGATIVE, POSITIVE, UNLABELLED = 0, 1, 2
BOUND = len(KINDS) * 2 * 2 * math.prod(FEATURES.values())
ROUNDS, RATE, DEPTH, PRECISION, RECALL = 20, 0.3, 2, 0.95, 0.95
SEEN = f"struct<kind:int,lo:int,hi:int,{','.join(f'{f}:int' for f in FEATURES)},label:int>"
ADDED = "struct<lo:int,hi:int,kind:int>"


def digits_of(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes; long ones aren't computed and fail."""
    digit = "cast(substring(r, i, 1) AS int)"
    summed = f"aggregate(sequence(1, length(r)), 0, (acc, i) -> acc + CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)"
    return f"(CASE WHEN length({digits}) BETWEEN 2 AND 24 THEN transform(array(reverse({digits})), r -> {summed} % 10 = 0)[0] ELSE false END)"


def octets(text: str) -> str:
    return f"{text} RLIKE '^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:[.](?!$)|$)){{4}}$'"


VALID = {
    "email": "true",
    "ip": octets("s.text"),
    "card": f"length({digits_of('s.text')}) BETWEEN 13 AND 19 AND {luhn(digits_of('s.text'))}",
    "phone": f"length({digits_of('s.text')}) BETWEEN 9 AND 15",
}
#: Whether a masked text ``m`` with digits ``d`` may be of the kind at all.
CHECK = {
    "email": f"m RLIKE {literal(r'^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$')}",
    "ip": octets("m"),
    "card": f"length(d) BETWEEN 13 AND 19 AND {luhn('d')}",
    "phone": f"length(d) BETWEEN 9 AND 12 AND NOT m RLIKE {literal(r'^(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-]')} AND NOT m RLIKE {literal(r'[.][0-9]{1,3}[.]')}",
}


def base_spans(df: DataFrame) -> DataFrame:
    """From id and text: with base_<kind>."""
    df = df.withColumns({f"m_{k}": F.expr(matches("text", r, GUARD.get(k, "true"))) for k, r in BASE.items()})
    df = df.withColumns({f"base_{k}": F.expr(f"filter({places('text', r, f'm_{k}')}, s -> {VALID[k]})") for k, r in BASE.items()})
    return df.drop(*(f"m_{k}" for k in BASE))


def seen(kind: str, spans: str, positive: bool) -> str:
    """SQL: array of ``SEEN`` for an array of spans: base ones, or candidates that touch none of these."""
    side = lambda c: f"CASE WHEN {c} = '' OR {c} RLIKE '^\\\\s$' THEN 0 WHEN {c} RLIKE '^[A-Za-z0-9]$' THEN 1 ELSE 2 END"
    parts = {
        "digits": "CASE WHEN length(d) < 7 THEN 0 WHEN length(d) < 9 THEN 1 WHEN length(d) = 9 THEN 2 WHEN length(d) = 10 THEN 3 WHEN length(d) < 13 THEN 4 WHEN length(d) < 16 THEN 5 WHEN length(d) <= 19 THEN 6 ELSE 7 END",
        "groups": "least(size(split(m, '[^A-Za-z0-9]+')) - 1, 4)",
        "check": f"cast({CHECK[kind]} AS int)",
        "before": side("right(s.before, 1)"),
        "after": side("s.after"),
        "near": f"cast(lower(s.before) RLIKE '{NEAR[kind]}' AS int)",
        "shape": r"CASE WHEN m RLIKE '^[(]?[0-9]{3}[)]?[^0-9]{0,2}[0-9]{3}[^0-9]{1,2}[0-9]{4}$' THEN 1 WHEN m RLIKE '^[0-9]{4}(?:[^0-9]{0,3}[0-9]{4}){3}$' THEN 2 WHEN m RLIKE '[.][A-Za-z]{2,}[.]?$' THEN 3 ELSE 0 END",
    }
    vector = f"named_struct('kind', {KINDS.index(kind)}, 'lo', s.lo, 'hi', s.hi, {', '.join(f"'{f}', {parts[f]}" for f in FEATURES)})"
    label = str(POSITIVE) if positive else f"CASE WHEN v.check = 0 OR v.before = 1 OR v.after = 1 THEN {NEGATIVE} ELSE {UNLABELLED} END"
    labelled = let("v", vector, f"named_struct('kind', v.kind, 'lo', v.lo, 'hi', v.hi, {', '.join(f"'{f}', v.{f}" for f in FEATURES)}, 'label', {label})")
    return f"transform({spans}, s -> {let('m', MASKED[kind], let('d', digits_of('m'), labelled))})"


def propose(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """id, base_<kind> (arrays of lo, hi), seen (array of ``SEEN``: the base spans as examples, and the
    candidates that touch none), back (whether held back) and ``more`` of the text."""
    rows = base_spans(keyed(df, id_col, text_col))
    names = {f"{k}_{i}": r for k, rules in WIDE.items() for i, r in enumerate(rules)}
    rows = rows.withColumns({f"w_{n}": F.expr(matches("text", r, GUARD.get(f"wide_{n}", "true"))) for n, r in names.items()})
    found = {k: [places("text", r, f"w_{k}_{i}") for i, r in enumerate(rules)] for k, rules in WIDE.items()}
    some = {k: " OR ".join(f"size(w_{k}_{i}) > 0" for i in range(len(rules))) for k, rules in WIDE.items()}
    none, once = f"cast(array() AS array<{SPAN}>)", "filter(c, (x, i) -> i = 0 OR x.lo <> c[i - 1].lo OR x.hi <> c[i - 1].hi)"
    rows = rows.withColumns({f"c_{k}": F.expr(f"CASE WHEN {some[k]} THEN {let('c', f'array_sort(concat({chr(44).join(found[k])}))', once)} ELSE {none} END") for k in KINDS})
    rows = rows.withColumn("base", F.expr(f"concat({', '.join(f'transform(base_{k}, s -> named_struct(\'lo\', s.lo, \'hi\', s.hi))' for k in KINDS)})"))
    rows = rows.withColumns({f"c_{k}": F.expr(apart(f"c_{k}", "base")) for k in KINDS})
    examples = [seen(k, f"base_{k}", True) for k in KINDS] + [seen(k, f"c_{k}", False) for k in KINDS]
    back = "cast(pmod(xxhash64(text), 10) = 0 AS int)"
    return rows.selectExpr("id", *(f"transform(base_{k}, s -> named_struct('lo', s.lo, 'hi', s.hi)) AS base_{k}" for k in KINDS), f"cast(concat({', '.join(examples)}) AS array<{SEEN}>) AS seen", f"{back} AS back", *more)


class Trees:
    """Of each kind, boosted trees over the features and a threshold."""

    def __init__(self, counts: list[tuple[tuple[int, ...], int, int, int]]):
        """counts: (kind and features, label, held back, number)."""
        self.priors, self.trees, self.thresholds = {}, {}, {}
        for kind in range(len(KINDS)):
            cells: tuple[dict, dict] = (defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0]))
            for (k, *x), label, back, n in counts:
                if k == kind and label != UNLABELLED:
                    cells[back][tuple(x)][label] += n
                    for y in self.counterparts(x) if label == POSITIVE else ():
                        cells[back][y][NEGATIVE] += n / 3
            if all(any(n[POSITIVE] for n in part.values()) for part in cells):
                self.boost(kind, cells[0])
                self.calibrate(kind, cells[1])

    @staticmethod
    def counterparts(x: list[int]) -> list[tuple[int, ...]]:
        """The same span without its check, within a word, and without the shape that it has."""
        changed = [{"check": 0}, {"before": 1, "after": 1}, {"shape": 0}]
        made = {tuple(c.get(f, v) for f, v in zip(FEATURES, x, strict=True)) for c in changed}
        return sorted(made - {tuple(x)})

    def boost(self, kind: int, cells: dict[tuple[int, ...], list[float]]) -> None:
        vectors, numbers = np.array(list(cells), np.int64), np.array(list(cells.values()))
        total, yes = numbers.sum(axis=1), numbers[:, POSITIVE]
        prior = float(np.log((yes.sum() + 1) / ((total - yes).sum() + 1)))
        score = np.full(len(vectors), prior)
        trees = []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree, values = self.split(vectors, yes - total * p, total * p * (1 - p), DEPTH)
            trees.append(tree)
            score += values
        self.priors[kind], self.trees[kind] = prior, trees

    @staticmethod
    def leaf(tree: tuple, x: tuple[int, ...]) -> float:
        while len(tree) == 4:
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree[0]

    def split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple[tuple, np.ndarray]:
        """(leaf,) or (feature, largest value to the left, left, right), by the gain of second order;
        the values that it gives to the rows."""
        whole, weight = g.sum(), h.sum()
        best, at = 1e-6, None
        for f in range(x.shape[1]) if depth and len(x) else ():
            values = np.unique(x[:, f])
            a, b = np.cumsum(np.bincount(x[:, f], g))[values[:-1]], np.cumsum(np.bincount(x[:, f], h))[values[:-1]]
            gain = a * a / (b + 1) + (whole - a) ** 2 / (weight - b + 1) - whole * whole / (weight + 1)
            if len(gain) and gain.max() > best:
                best, at = gain.max(), (f, int(values[gain.argmax()]))
        if at is None:
            leaf = float(RATE * whole / (weight + 1))
            return (leaf,), np.full(len(x), leaf)
        left = x[:, at[0]] <= at[1]
        out = np.empty(len(x))
        one, out[left] = self.split(x[left], g[left], h[left], depth - 1)
        two, out[~left] = self.split(x[~left], g[~left], h[~left], depth - 1)
        return (*at, one, two), out

    def score(self, kind: int, x: tuple[int, ...]) -> float:
        return round(self.priors[kind] + sum(self.leaf(t, x) for t in self.trees[kind]), 9)

    def calibrate(self, kind: int, cells: dict[tuple[int, ...], list[float]]) -> None:
        """The lowest threshold with the precision, but none that more than ``RECALL`` of the positive reach."""
        ranked: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for x, n in cells.items():
            at = ranked[self.score(kind, x)]
            at[NEGATIVE], at[POSITIVE] = at[NEGATIVE] + n[NEGATIVE], at[POSITIVE] + n[POSITIVE]
        every = sum(n[POSITIVE] for n in ranked.values())
        no = yes = 0.0
        for s in sorted(ranked, reverse=True):
            reached = yes >= RECALL * every
            no, yes = no + ranked[s][NEGATIVE], yes + ranked[s][POSITIVE]
            if not reached and yes >= PRECISION * (no + yes):
                self.thresholds[kind] = s

    def sql(self, c: str) -> str:
        """Whether candidate ``c`` reaches its threshold: its score, else null."""
        names = list(FEATURES)

        def of(tree: tuple) -> str:
            if len(tree) == 1:
                return f"{tree[0]!r}D"
            return f"CASE WHEN {c}.{names[tree[0]]} <= {tree[1]} THEN {of(tree[2])} ELSE {of(tree[3])} END"

        whens = ""
        for kind, least in self.thresholds.items():
            score = "round(" + " + ".join([f"{self.priors[kind]!r}D", *map(of, self.trees[kind])]) + ", 9)"
            whens += f" WHEN {kind} THEN {let('z', score, f'CASE WHEN z >= {least!r}D THEN z END')}"
        return f"CASE {c}.kind{whens} END" if whens else "cast(NULL AS double)"


def train_on(proposed: DataFrame) -> Trees:
    """Boost on the counts of distinct vectors, at most ``BOUND`` rows, over all documents."""
    names = ["kind", *FEATURES]
    labelled = F.expr(f"filter(seen, c -> c.label <> {UNLABELLED})")
    counts = proposed.select("back", F.explode(labelled).alias("c")).groupBy("back", "c.label", *(F.col(f"c.{n}").alias(n) for n in names)).count()
    rows = sorted((tuple(r[n] for n in names), r["label"], r["back"], r["count"]) for r in counts.collect())
    return Trees(rows)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    return train_on(propose(df, id_col, text_col))


def select(proposed: DataFrame, trees: Trees, id_col: str = "doc_id", *more: str) -> DataFrame:
    """id_col, base_<kind> and added (array of ``ADDED``); of candidates of one start the longest, then the best, counts."""
    if not trees.thresholds:
        added = f"cast(array() AS array<{ADDED}>)"
    else:
        scored = f"transform(filter(seen, c -> c.label <> {POSITIVE}), c -> named_struct('lo', c.lo, 'hi', -c.hi, 'z', -{trees.sql('c')}, 'kind', c.kind))"
        ranked = f"transform(array_sort(filter({scored}, x -> x.z IS NOT NULL)), x -> named_struct('lo', x.lo, 'hi', -x.hi, 'kind', x.kind))"
        added = f"CASE WHEN exists(seen, c -> c.label <> {POSITIVE}) THEN {disjoint(ranked, ADDED)} ELSE cast(array() AS array<{ADDED}>) END"
    return proposed.select(F.col("id").alias(id_col), *(f"base_{k}" for k in KINDS), F.expr(added).alias("added"), *map(F.expr, more))


def find_pii(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base_<kind> (arrays of lo, hi) and added (with kind, too)."""
    return select(propose(df, id_col, text_col), trees, id_col)


def redact(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text with every span replaced by its kind in brackets; of overlapping ones the first gives the kind."""
    spans = select(propose(df, id_col, text_col, "text AS whole"), trees, id_col, "whole")
    every = "array_sort(concat(" + ", ".join(f"transform(base_{k}, s -> named_struct('lo', s.lo, 'hi', s.hi, 'kind', {i}))" for i, k in enumerate(KINDS)) + ", added))"
    name = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind + 1)"
    # text between is cut from blocks of it, as a substring is found by counting from its beginning
    size = 4096
    part = lambda lo, hi: f"substring(array_join(slice(blocks, cast(({lo}) DIV {size} AS int) + 1, cast(({hi}) DIV {size} - ({lo}) DIV {size} AS int) + 1), ''), ({lo}) % {size} + 1, ({hi}) - ({lo}))"
    piece = f"CASE WHEN i = 0 OR x.lo >= past[i - 1] THEN concat({part('CASE WHEN i = 0 THEN 0 ELSE past[i - 1] END', 'x.lo')}, '[', {name}, ']') ELSE '' END"
    pieces = f"transform(spans, (x, i) -> {piece})"
    out = let("past", furthest("transform(spans, x -> x.hi)"), f"array_join(concat({pieces}, array({part('past[size(spans) - 1]', 'length(whole)')})), '')")
    spans = spans.selectExpr(f"`{id_col}`", "whole", f"{every} AS spans", f"regexp_extract_all(whole, '(?s).{{1,{size}}}', 0) AS blocks")
    return spans.selectExpr(f"`{id_col}`", f"CASE WHEN size(spans) = 0 THEN whole ELSE {out} END AS text")


def pii_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    proposed = durable(propose(df, id_col, text_col))
    found = select(proposed, train_on(proposed), id_col)
    base = ", ".join(f"transform(base_{k}, s -> concat('{k}:', s.lo, ':', s.hi))" for k in KINDS)
    both = ", ".join(f"transform(array_sort(concat(base_{k}, transform(filter(added, s -> s.kind = {i}), s -> named_struct('lo', s.lo, 'hi', s.hi)))), s -> concat('{k}:', s.lo, ':', s.hi))" for i, k in enumerate(KINDS))
    count = " + ".join(f"size(base_{k})" for k in KINDS)
    return found.selectExpr(
        f"`{id_col}`",
        *(f"cast(size(base_{k}) AS bigint) AS n_{k}" for k in KINDS),
        f"sha2(cast(array_join(concat({base}), ',') AS binary), 256) AS base_sha256",
        f"array_join(concat({both}), ',') AS spans",
        "cast(size(added) AS bigint) AS n_added",
        f"cast({count} + size(added) AS bigint) AS n_spans",
    )


__all__ = ["BASE", "KINDS", "Trees", "find_pii", "pii_digests", "propose", "redact", "select", "train", "train_on"]
