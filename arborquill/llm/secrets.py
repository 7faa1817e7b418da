"""Secret scans: parts of credentials, linked within scopes.

Base rules (``BASE``) always report. Beside them, weaker candidates of three parts - access
identifiers, secrets and endpoints - are found by wider rules and reported only where complementary
parts co-occur: an interval join of the parts, in which two meet if at most ``SCOPE`` code points lie
between them. A weak identifier needs a secret, a weak secret an identifier, and an endpoint both;
base matches serve as parts, too. A scope never leaves its text, so the join is a merge: one sweep
forward over the sorted intervals with the furthest end of each part, one backward with the nearest
start. It makes no pairs and needs no shuffle, and its time is nearly linear in a text's matches.

Edge cases: a null or empty text has no spans; of weak candidates that overlap each other or a base
match, the base and then the earlier, longer one stays. Rows are independent, repeated rows get the
same spans, and empty tables work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed
from .spans import apart, disjoint, furthest, let, literal, matches, nearest, places

KINDS = ("assign", "access", "hex")
ASSIGN = r"(?:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
#: Access and hex runs that are too short can't be matched from a later start, so the bound is in the rule.
BASE = {"assign": "(?i)" + ASSIGN + r"[A-Za-z0-9+/_.=-]+", "access": r"AKIA[A-Z0-9]{14,}", "hex": r"(?<![0-9a-f])[0-9a-f]{16,}"}
GUARD = {"access": "instr(text, 'AKIA') > 0"}
#: Of a match of assign, its value.
VALUE = "(?i)^" + ASSIGN
PARTS = ("id", "secret", "endpoint")
#: Of the base matches, the part they are.
PART_OF = {"assign": "secret", "access": "id", "hex": "secret"}
WEAK = {
    "id": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{4,}|(?:client|access|account|user)_?id[\x22\x27]?[ ]{0,8}[:=][ ]{0,8}[\x22\x27]?[A-Za-z0-9_.@-]{4,})",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:(?:pwd|pass|passphrase|private_?key|auth|credential)[\x22\x27]?[ ]{0,8}[:=][ ]{0,8}[\x22\x27]?[A-Za-z0-9+/_.=!@#$%^&*-]{6,}|(?:password|passwd|secret|token|api_?key)[\x22\x27]?[ ]{0,8}[:=][ ]{0,8}[\x22\x27]?[A-Za-z0-9+/_.=-]{6,11}(?![A-Za-z0-9+/_.=-]))",
    "endpoint": r"(?i)(?<![A-Za-z0-9+.-])(?:[a-z][a-z0-9+.-]{1,12}://[^\s<>\x22\x27]+|(?:host|endpoint|server)[ ]{0,8}[:=][ ]{0,8}[A-Za-z0-9.-]{4,})",
}
SCOPE = 200
LINKED = "struct<lo:int,hi:int,part:int>"


def base_spans(df: DataFrame) -> DataFrame:
    """From id and text: with base_<kind>."""
    valid = {"assign": "length(regexp_replace(s.text, {}, '')) >= 12".format(literal(VALUE)), "access": "true", "hex": "true"}
    df = df.withColumns({f"m_{k}": F.expr(matches("text", r, GUARD.get(k, "true"))) for k, r in BASE.items()})
    return df.withColumns({f"base_{k}": F.expr(f"filter({places('text', r, f'm_{k}')}, s -> {valid[k]})") for k, r in BASE.items()}).drop(*(f"m_{k}" for k in BASE))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base_<kind> and linked (array of lo, hi, part), the weak candidates reported."""
    rows = base_spans(keyed(df, id_col, text_col))
    rows = rows.withColumns({f"m_{p}": F.expr(matches("text", r)) for p, r in WEAK.items()})
    rows = rows.withColumns({f"weak_{p}": F.expr(places("text", r, f"m_{p}")) for p, r in WEAK.items()}).drop(*(f"m_{p}" for p in WEAK))
    as_parts = lambda column, part, weak: f"transform({column}, s -> named_struct('lo', s.lo, 'hi', s.hi, 'part', {PARTS.index(part)}, 'weak', {weak}))"
    base = f"concat({', '.join(f'base_{k}' for k in KINDS)})"
    every = [as_parts(f"base_{k}", PART_OF[k], "false") for k in KINDS] + [as_parts(apart(f"weak_{p}", base), p, "true") for p in PARTS]
    rows = rows.withColumn("parts", F.expr(f"array_sort(concat({', '.join(every)}))"))
    return rows.select(F.col("id").alias(id_col), *(f"base_{k}" for k in KINDS), F.expr(linked("parts")).alias("linked"))


def linked(parts: str) -> str:
    """SQL: of a sorted array of parts (lo, hi, part, weak), the weak ones whose complement is in their scope."""
    far = 1 << 30
    past = {p: furthest(f"transform({parts}, x -> CASE WHEN x.part = {i} THEN x.hi ELSE -{far} END)") for i, p in enumerate(PARTS[:2])}
    coming = {p: nearest(f"transform({parts}, x -> CASE WHEN x.part = {i} THEN x.lo ELSE {far} END)") for i, p in enumerate(PARTS[:2])}
    near = lambda p: f"(x.lo - past_{p}[i] <= {SCOPE} OR next_{p}[i] - x.hi <= {SCOPE})"
    complete = f"CASE x.part WHEN 0 THEN {near('secret')} WHEN 1 THEN {near('id')} ELSE {near('id')} AND {near('secret')} END"
    found = f"transform(filter({parts}, (x, i) -> x.weak AND {complete}), x -> named_struct('lo', x.lo, 'hi', x.hi, 'part', x.part))"
    for p in PARTS[:2]:
        found = let(f"past_{p}", past[p], let(f"next_{p}", coming[p], found))
    return f"CASE WHEN size({parts}) > 1 AND exists({parts}, x -> x.weak) THEN {disjoint(found, LINKED)} ELSE cast(array() AS array<{LINKED}>) END"


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find_secrets(df, id_col, text_col)
    names = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, *(f"weak_{p}" for p in PARTS))) + ")"
    spans = lambda column, k: f"transform({column}, s -> named_struct('lo', s.lo, 'kind', {k}, 'hi', s.hi))"
    base = ", ".join(spans(f"base_{k}", i) for i, k in enumerate(KINDS))
    listed = lambda arrays: f"array_join(transform(array_sort(concat({arrays})), s -> concat(element_at({names}, s.kind + 1), ':', s.lo, ':', s.hi)), ',')"
    return found.selectExpr(
        f"`{id_col}`",
        *(f"cast(size(base_{k}) AS bigint) AS n_{k}" for k in KINDS),
        f"sha2(cast({listed(base)} AS binary), 256) AS base_sha256",
        f"{listed(base + ', ' + spans('linked', 's.part + 3'))} AS spans",
        "cast(size(linked) AS bigint) AS n_linked",
    )
