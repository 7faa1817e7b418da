"""URL filters: glob rules as one bit-parallel wildcard automaton.

Every glob is a run of bits in a multiword state: bit i of a rule is set when its first i tokens have
matched. One step per byte moves all rules at once, ``D = (D << 1) & B[c] | D & S[c]`` (``B``: the
token of a bit matches byte c; ``S``: a star loops on it), with the carry between words done by hand,
and the states of a whole batch of URLs advance together as one numpy matrix.

Globs are matched against the *canonical URL*, host (A-Z lower-cased) followed by path, from its first
byte to its last. ``*`` stands for any bytes but ``/``, ``**`` for any bytes, ``?`` for one character: its
first byte moves on, and the bytes that continue it stay.

Edge cases: a null URL or one without ``://`` has empty host and path; such a URL fits no list rule
and is judged by the globs, which an empty canonical URL doesn't match, so it's allowed. Rows are
independent, so ties, repeated rows and empty tables need nothing special. Very long URLs only make
their own rows slow: a batch is stepped in the order of length, finished rows leaving it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Blocked where no list rule fits.
GLOBS = ("**casino**", "**free-bets**", "**freebets**", "**jackpot**", "**viagra**", "**xxx-**", "*porn*/**", "**cheap-pills**", "**spam-farm**", "adult-*/**", "*.adult-*/**", "**/wp-login.ph?")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLASH = 47
#: Bytes of UTF-8 that don't begin a character.
CONTINUING = slice(0x80, 0xC0)


def tokens(glob: str) -> list[tuple[int | None, str]]:
    """(byte or None for any, loop before it: '', '*' or '**'), closed by (-1, loop)."""
    out, loop, data, i = [], "", glob.encode(), 0
    while i < len(data):
        if data[i] == 42:
            wide = data[i + 1 : i + 2] == b"*"
            loop = "**" if wide or loop == "**" else "*"
            i += 1 + wide
            continue
        out.append((None if data[i] == 63 else data[i], loop))
        loop, i = "", i + 1
    return [*out, (-1, loop)]


class Automaton:
    """All globs packed into words of 64 bits."""

    def __init__(self, globs: Sequence[str]):
        parsed = [tokens(g) for g in globs]
        self.words = max(1, -(-sum(map(len, parsed)) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        bit = 0
        for parts in parsed:
            self.begin[bit // 64] |= np.uint64(1 << bit % 64)
            for k, (byte, loop) in enumerate(parts):
                w, one = (bit + k) // 64, np.uint64(1 << (bit + k) % 64)
                if loop:
                    self.loop[:, w] |= one
                    if loop == "*":
                        self.loop[SLASH, w] &= ~one
                if byte != -1:
                    w, one = (bit + k + 1) // 64, np.uint64(1 << (bit + k + 1) % 64)
                    if byte is None:
                        self.enter[:, w] |= one
                        self.enter[CONTINUING, w] &= ~one
                        self.loop[CONTINUING, w] |= one
                    else:
                        self.enter[byte, w] |= one
            bit += len(parts)
            self.accept.append(((bit - 1) // 64, np.uint64(1 << (bit - 1) % 64)))

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: a row for each URL, a column for each glob."""
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-sizes, kind="stable")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(urls), np.uint8)
        state = np.tile(self.begin, (len(urls), 1))
        start, length = ends[:-1][order], sizes[order]
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(length[0]) if len(urls) else 0):
            live = int(np.searchsorted(-length, -i, side="left"))  # those longer than i
            c, d = data[start[:live] + i], state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = moved & self.enter[c] | d & self.loop[c]
        out = np.empty((len(urls), len(self.accept)), bool)
        for k, (w, mask) in enumerate(self.accept):
            out[order, k] = (state[:, w] & mask) != 0
        return out


def rule_globs(host: str, path: str) -> tuple[str, str]:
    """A list rule as globs over canonical URLs; the host holds no ``/``, so ``*.`` stays in it."""
    return f"{host}{path}**", f"*.{host}{path}**"


def canonical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """With url_host and url_path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url_, instr(url_, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("rest_", r"^[^/?#]*", 0)
    path = F.regexp_extract("rest_", r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("url_", url).withColumn("rest_", rest).withColumn("url_host", F.translate(host, UPPER, LOWER)).withColumn("url_path", path).drop("url_", "rest_")


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, globs: Sequence[str] = GLOBS) -> DataFrame:
    """id_col, host, path, rule (``host/path`` of the longest list rule that fits, else null), verdict and
    glob (the first glob that matches, else null). Verdict: the rule's, else block if a glob matches."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    automaton = Automaton([g for _, host, path in ranked for g in rule_globs(host, path)] + list(globs))
    names, verdicts = np.array([h + p for _, h, p in ranked], object), np.array([v for v, _, _ in ranked], object)
    patterns = np.array(globs, object)

    def run(batches):
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = automaton.match([(h + p).encode() for h, p in zip(hosts, paths, strict=True)])
            listed = hit[:, 0 : 2 * len(ranked) : 2] | hit[:, 1 : 2 * len(ranked) : 2]
            other = hit[:, 2 * len(ranked) :]
            ruled, caught = listed.any(axis=1), other.any(axis=1)
            rule = np.where(ruled, names[listed.argmax(axis=1)], None) if len(ranked) else np.full(len(hosts), None)
            verdict = np.where(caught, "block", "allow").astype(object)
            if len(ranked):
                verdict = np.where(ruled, verdicts[listed.argmax(axis=1)], verdict)
            glob = np.where(caught, patterns[other.argmax(axis=1)], None) if len(globs) else np.full(len(hosts), None)
            text = [pa.array(x.tolist(), pa.string()) for x in (rule, verdict, glob)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *text], ["id", "host", "path", "rule", "verdict", "glob"])

    rows = canonical(df.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url")).select("id", F.col("url_host").alias("host"), F.col("url_path").alias("path"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, glob string").withColumnRenamed("id", id_col)


def as_like(glob: str) -> str:
    """A regular expression (RE2 and Java) for a glob over a canonical URL; for the SQL form."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(.|\\n)*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            c = glob[i]
            out, i = out + ("(.|\\n)" if c == "?" else c if c.isalnum() else f"[{c}]"), i + 1
    return out


def url_sql(rules=RULES, globs: Sequence[str] = GLOBS) -> str:
    """The verdicts in SQL."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ranked]
    caught = " OR ".join(f"regexp_full_match(host || path, '{as_like(g)}')" for g in globs)
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ranked, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ranked, strict=True)) + f" WHEN {caught} THEN 'block' ELSE 'allow' END"
    glob = "CASE " + " ".join(f"WHEN regexp_full_match(host || path, '{as_like(g)}') THEN '{g}'" for g in globs) + " END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, {glob} AS glob FROM u"""
