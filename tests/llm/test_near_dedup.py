"""Groups of near copies against brute-force Jaccard similarity."""

import random
from fractions import Fraction

import pytest

import corpus_pipeline
from arborquill.llm import graph, near_dedup, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return Fraction(len(a & b), len(a | b)) if a or b else Fraction(1)


def firsts(rows):
    """Ids of the least of each group, by comparing all pairs."""
    of = {i: grams(t) for i, t in rows}
    parent = {i: i for i in of}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in of:
        for b in of:
            if a < b and jaccard(of[a], of[b]) >= Fraction(4, 5):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted({root(i) for i in of})


def copies(seed):
    """Texts and copies with edits on both sides of the limit, chains of copies among them."""
    rnd = random.Random(seed)
    texts = [None, "", " \n", "one two", "One  two", "one two three four five"]
    for _ in range(30):
        words = [f"w{rnd.randrange(10**5)}" for _ in range(rnd.choice([6, 25, 60, 300]))]
        for _ in range(rnd.randint(1, 8)):
            texts.append(" ".join(words))
            words = list(words) if rnd.random() < 0.5 else words
            for _ in range(rnd.randint(0, max(1, len(words) // 40))):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**5)}"
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = copies(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS id", "3 AS n").repartition(4)
    kept = near_dedup.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == firsts(rows)


def test_stage_drops_near_copies_that_simhash_misses(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join("x" if i in (30, 70, 110, 150) else w for i, w in enumerate(words))), (3, " ".join([*words[:100], *(f"z{i}" for i in range(100))]))]
    a, b = (simhash.fingerprint(t.encode()) for _, t in rows[:2])
    assert jaccard(grams(rows[0][1]), grams(rows[1][1])) >= 0.8 and (a ^ b).bit_count() > 2
    kept = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_limit_is_exact():
    cache = near_dedup.Hashes()
    words = [f"w{i}" for i in range(40)]  # 36 shingles
    a = near_dedup.shingles(" ".join(words).encode(), cache)
    at, below = (near_dedup.shingles(" ".join(words[k:] + [f"n{i}" for i in range(k)]).encode(), cache) for k in (4, 5))
    assert near_dedup.near(a, at) and not near_dedup.near(a, below)  # 32 of 40, 31 of 41


def test_ties(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (None, "quite another text here"), (None, "quite another text here"), (3, None), (4, ""), (5, "x"), (5, "y")]
    kept = [tuple(r) for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d"), (None, "quite another text here"), (3, None), (5, "x"), (5, "y")], key=str)


def test_large_groups_in_blocks(spark, monkeypatch):
    """Groups in which pairs are on both sides of the limit, so that pivots don't suffice; small blocks and slices."""
    monkeypatch.setattr(near_dedup, "QUERIES", 4)
    monkeypatch.setattr(near_dedup, "SLICE", 7)
    monkeypatch.setattr(near_dedup, "ROUNDS", (1, 20))
    rnd = random.Random(8)
    texts = []
    for _ in range(3):
        words = [f"w{rnd.randrange(10**5)}" for _ in range(120)]
        for _ in range(60):
            edited = list(words)
            for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 7, 9, 12])):
                edited[rnd.randrange(len(edited))] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(edited))
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r["doc_id"] for r in kept.collect()) == firsts(rows)


def test_jobs_are_few(spark):
    """The driver keeps something of each job: in the check it grew beyond its memory over those of the rounds."""
    rows = spark.createDataFrame(copies(3), "doc_id long, text string").repartition(4)
    at = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = at()
    near_dedup.keep_one(rows).count()
    assert (jobs := at() - before) < 110, jobs


def test_groups_in_one_task_are_those_of_rounds(spark):
    rnd = random.Random(4)
    ends = [(rnd.randbytes(2), rnd.randbytes(2)) for _ in range(30_000)] + [(bytes([0, i]), bytes([0, i + 1])) for i in range(255)] + [(b"zzz", b"zzz"), (b"a", b"b"), (b"b", b"a")]
    for edges in (ends[20_000:], ends[29_990:], ends[:0]):
        frame = spark.createDataFrame(edges, "a binary, b binary")
        few, many = (sorted((bytes(r["node"]), bytes(r["root"])) for r in graph.components(frame, n).collect()) for n in (10**6, len(edges) // 2))
        assert few == many and len(few) == len({x for e in edges if e[0] != e[1] for x in e})


def test_simhash_proposes(spark):
    """Without any MinHash band: just those within two bits are found, and of them just those that are similar."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), "q w e r t y u i o p"]
    rnd = random.Random(5)
    for _ in range(60):
        edited = list(words)
        for _ in range(rnd.choice([1, 1, 2, 6])):
            edited[rnd.randrange(len(edited))] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(edited))
    texts += ["a " * 200 + x for x in ("", "v1 v2 v3 v4", "v5 v6 v7 v8 v9")]  # one fingerprint, sets that differ
    source = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = near_dedup.durable(near_dedup.sets(source))
    of = {r["id"]: (bytes(r["node"]), r["fp"]) for r in rows.collect()}
    assert [fp % (1 << 64) for _, fp in (of[i] for i in range(len(texts)))] == [simhash.fingerprint(t.encode()) for t in texts]
    nodes = rows.selectExpr("node", "n", "cast(array() AS array<bigint>) AS bands")
    found = near_dedup.links(nodes, rows.select("node", "n", "fp").distinct(), lambda some: rows.join(source, "id").join(some, "node", "left_semi").selectExpr("node", "cast(text AS binary) AS text"))
    got = {bytes(r["node"]): bytes(r["root"]) for r in graph.components(found).collect()}
    sets = [grams(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    far = 0
    for a in range(len(texts)):
        for b in range(a):
            if ((of[a][1] ^ of[b][1]) % (1 << 64)).bit_count() <= 2:
                if jaccard(sets[a], sets[b]) >= Fraction(4, 5):
                    parent[root(a)] = root(b)
                else:
                    far += 1
    want = {}
    for i in range(len(texts)):
        want.setdefault(root(i), set()).add(of[i][0])
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1) and groups and far
