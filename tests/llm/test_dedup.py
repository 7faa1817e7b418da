"""Substring, line and near-duplicate removal against brute force."""

import hashlib
import random
import re

import pytest
import xxhash

from arborquill.llm import line_dedup, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passages(seed):
    """Texts that share passages of all lengths, in words; some copies, some repeated rows."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(rnd.choice([30, 49, 50, 51, 60, 79, 80, 81, 120, 300])) for _ in range(12)]
    texts = [None, "", "   ", "one two", " ".join(fresh(49)), " ".join(["same"] * 200), " ".join(["same"] * 120)]
    for _ in range(60):
        words = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(shared)
            a = rnd.randint(0, max(0, len(p) - 45))
            words += fresh(rnd.randint(0, 40)) + (p[a:] if rnd.random() < 0.8 else p[: a + 50])
        texts.append(rnd.choice([" ", "\n", "\t", " \x0b"]).join(words))
    texts += texts[7:15]
    return [(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (None, texts[21]), (None, "x")]


def without_passages(rows):
    n = substring_dedup.WINDOW
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = passages(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS pos", "3 AS id").repartition(4)
    got = [tuple(r) for r in substring_dedup.dedup_substrings(frame).collect()]
    assert sorted(got, key=key) == sorted(without_passages(rows), key=key)


def test_cover_puts_both_alignments_on_an_anchor():
    p, cover = substring_dedup.PERIOD, set(substring_dedup.COVER)
    assert all(any((a + d) % p in cover and (b + d) % p in cover for d in range(p)) for a in range(p) for b in range(p))


def test_lines(spark):
    rnd = random.Random(6)
    make = lambda: "\n".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14)))
    rows = [(i, make()) for i in range(150)] + [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "a\nb\nc"), (204, "a\nb\nc")]
    seen, want = set(), {}
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone.update((k, k + 1, k + 2))
            seen.add(w)
        want[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS pos", "8 AS mark").repartition(4)
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(frame).collect()} == want
    replaced = line_dedup.replace_lines(frame)
    assert replaced.columns == frame.columns and {r["doc_id"]: r["text"] for r in replaced.collect()} == {i: w[2] for i, w in want.items()}


def test_equal_rows_keep_the_same_lines(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(frame).collect()), key=key)
    assert got == [(None, "a\nb\nc\nd"), (1, ""), (1, "")]


def fingerprint(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_texts(seed):
    rnd = random.Random(seed)
    base = [[f"t{rnd.randrange(3000)}" for _ in range(rnd.choice([1, 2, 3, 40, 200]))] for _ in range(40)]
    texts = [None, "", "\n", "É é", "A b", "a B"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rnd.randint(0, 4)):
            c = list(b)
            if rnd.random() < 0.7:
                c[rnd.randrange(len(c))] = "edit"
            texts.append(" ".join(c))
    return texts


@pytest.mark.parametrize("radius", [1, 2])
def test_simhash_components(spark, radius):
    rows = list(enumerate(near_texts(radius)))
    rnd = random.Random(9)
    rnd.shuffle(rows)
    prints = {i: fingerprint(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS fp", "6 AS key", "7 AS node").repartition(4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame, radius=radius).collect()}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == {i: root(i) for i in prints}
    if radius == 2:
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_digests(frame).collect()} == {i: (f"{f:016x}", root(i)) for i, f in prints.items()}
        kept = simhash.keep_one(frame)
        assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in prints})


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.masks()
    assert all(any(not (1 << i | 1 << j) & m for m in masks) for i in range(64) for j in range(64))


def test_links_of_planted_fingerprints(spark):
    """Chains and stars at distance two, in one bucket and over several."""
    rnd = random.Random(8)
    prints = {rnd.getrandbits(64) for _ in range(50)}
    for f in list(prints)[:20]:
        for _ in range(5):
            prints.add(f := f ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash.signed(f),) for f in prints], "fp long")
    from arborquill.llm.graph import components

    got = {r["node"] % (1 << 64): r["root"] for r in components(simhash.links(frame)).collect()}
    for a in prints:
        for b in prints:
            if a != b and (a ^ b).bit_count() <= 2:
                assert got[a] == got[b]
    whole = {a: {b for b in prints if b != a and (a ^ b).bit_count() <= 2} for a in prints}
    for a in prints:
        reach, todo = {a}, [a]
        while todo:
            todo += (new := whole[todo.pop()] - reach)
            reach |= new
        if a in got:
            assert reach == {b for b in got if got[b] == got[a]}
        else:
            assert reach == {a}


def test_keep_one_of_ties(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (None, "quite another text here"), (None, "quite another text here"), (3, None), (4, ""), (5, "x"), (5, "y")]
    kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=key) == sorted([(1, "a b c d"), (None, "quite another text here"), (3, None), (5, "x"), (5, "y")], key=key)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup_substrings(frame).count() == line_dedup.dedup_lines(frame).count() == line_dedup.replace_lines(frame).count() == 0
    assert simhash.simhash_digests(frame).count() == simhash.keep_one(frame).count() == 0
