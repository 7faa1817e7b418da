"""Leaks of benchmark items: verbatim, re-parameterised and not at all."""

import random
import re
from collections import Counter

import duckdb
import pytest

from arborquill.llm import decontaminate as d

SF = "/root/testdata/sf0.01"
ITEM = "A train leaves Boston at 60 mph and travels 120 miles to reach Denver before the train from Boston stops after 60 minutes in total there."
DENSE = ["Compute 12 + 35 * 4 - 18 / 6 + 27 * 3 - 41 and 15 % of 80.", "Yesterday Anna Keller met Boris Novak in Geneva and Clara Rossi joined Anna Keller in Milan."]
CASES = [
    (0, "Prefix words here. " + ITEM + " And more follows.", True, True),
    (1, ITEM.replace("60", "75").replace("120", "340").replace("Boston", "Lisbon").replace("Denver", "Madrid"), True, False),
    (2, ITEM.replace("60 mph", "75 mph"), True, False),  # the same number stands for two: only that slot goes
    (3, ITEM.replace("Boston", "Lisbon", 1), True, False),
    (4, ITEM.replace("Boston", "Rome").replace("Denver", "Rome"), True, False),
    (5, "A train leaves the station and nobody travels anywhere near the coast today at all.", False, None),
    (6, None, False, None),
    (7, "", False, None),
    (8, "... !!! ???", False, None),
    (9, " ".join(ITEM.split()[:12]), False, None),
    (10, ITEM.upper().lower(), True, True),
]


def test_cases(spark):
    docs = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS item_id", "3 AS id")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (7, ITEM)], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    found = {}
    for r in d.find_leaks(docs, items).collect():
        assert r["item_id"] == 7
        found.setdefault(r["doc_id"], []).append(r)
    for i, _, leaks, verbatim in CASES:
        assert (i in found) == leaks, i
        if leaks:
            assert len(found[i]) == 2 and all(r["verbatim"] == verbatim and (r["n_changed"] + r["n_inconsistent"] > 0) != verbatim for r in found[i]), found[i]
    kept = d.drop_leaking(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c[0] for c in CASES} - found.keys()


def parsed(text):
    """(class, plain form) of each word, by the rules restated; only the list of units is shared."""
    out, ends = [], True
    for raw in (text or "").split():
        low = 0
        while low < len(raw) and not (re.match(r"\w", raw[low]) or raw[low] in "$€£%+-"):
            low += 1
        high = len(raw)
        while high > low and not (re.match(r"\w", raw[high - 1]) or raw[high - 1] == "%"):
            high -= 1
        bare = raw[low:high]
        if not bare:
            continue
        glued = re.fullmatch(r"[+-]?[0-9][0-9.,]*([a-zA-Z/]{1,4})", bare)
        if re.fullmatch(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?", bare) or glued and glued[1].lower() in d.UNITS:
            kind = "number"
        elif bare.lower() in d.UNITS:
            kind = "unit" if out and out[-1][0] == "number" else "plain"
        elif len(bare) > 1 and bare[0].isupper() and not bare.isupper():
            kind = "plain" if ends else "name"
        else:
            kind = "plain"
        out.append((kind, bare.lower()))
        ends = raw.rstrip("\"')]»”")[-1:] in tuple(".!?:")
    return out


def brute(docs, items):
    """Every window of every item held against every text, word by word."""
    found = set()
    texts = [(i, parsed(t)) for i, t in docs]
    for item, t in items:
        own = parsed(t)
        size = min(d.WINDOW, len(own))
        for doc, words in texts:
            covered = set()
            for shift in range(-len(own), len(words)):
                met = set()
                for q in range(len(own) - size + 1):
                    if q + shift < 0 or q + shift + size > len(words):
                        continue
                    mine, there = own[q : q + size], words[q + shift : q + shift + size]
                    literals = sum(k == "plain" for k, _ in mine)
                    typed = size >= d.SHORTEST and literals >= min(d.LITERALS, size) and all(a[0] == b[0] and (a[0] != "plain" or a[1] == b[1]) for a, b in zip(mine, there, strict=True))
                    if size and (typed or all(a[1] == b[1] for a, b in zip(mine, there, strict=True))):
                        met.update(range(q, q + size))
                pairs = Counter((own[q][0], own[q][1], words[q + shift][1]) for q in met if own[q][0] != "plain")
                first = {}
                for q in sorted(met, reverse=True):
                    first[own[q][0], own[q][1], words[q + shift][1]] = q
                chosen = []
                for p in sorted(pairs, key=lambda p: (-pairs[p], p[1] != p[2], first[p])):
                    if all(p[0] != c[0] or p[1] != c[1] and p[2] != c[2] for c in chosen):
                        chosen.append(p)
                covered |= {q for q in met if own[q][0] == "plain" or own[q][1] == words[q + shift][1] or (own[q][0], own[q][1], words[q + shift][1]) in chosen}
            if covered and len(covered) >= d.COVER * len(own):
                found.add((doc, item))
    return found


@pytest.fixture(scope="module")
def real():
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 12").fetchall()
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 600 ORDER BY doc_id LIMIT 60").fetchall()
    rnd = random.Random(2)
    planted = [(10_000 + i, " ".join([*text.split()[: rnd.randint(3, 60)], "end", *items[i][1].split()])) for i, (_, text) in enumerate(docs[:12])]
    planted += [(20_000 + i, f"so {text} then") for i, (_, text) in enumerate(c[:2] for c in CASES)]
    return docs + planted, [*items, (900, ITEM), (901, "too short"), (902, DENSE[0]), (903, DENSE[1])]


def test_as_brute_force(spark, real, monkeypatch):
    docs, items = real
    want = brute(docs, items)
    assert {(10_000 + i, items[i][0]) for i in range(12)} <= want
    monkeypatch.setattr(d, "BLOCK", 100)  # several blocks
    found = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert d.find_leaks(docs.limit(0), items).count() == d.find_leaks(docs, items.limit(0)).count() == 0
    assert d.find_leaks(docs, items.limit(0)).schema == d.find_leaks(docs, items).schema
    assert d.drop_leaking(docs, items.limit(0)).count() == 1


def leaking(text, *items):
    return {r[0] for r in d.Items(list(enumerate(items))).leaks(text, d.Words())}


@pytest.mark.parametrize("item", [*DENSE, "too short", "Berlin"])
def test_verbatim_copies_of_dense_and_short_items(spark, item):
    docs = spark.createDataFrame([(1, f"Before it. {item} And after."), (2, "Before it. And after.")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["verbatim"]) for r in d.find_leaks(docs, items).collect()] == [(1, True)]
    assert [r["doc_id"] for r in d.drop_leaking(docs, items).collect()] == [2]


def test_renamed_templates_count_beside_unchanged_dense_parts():
    """What plain windows add never takes a leak away: here Boston stays in the dense end only."""
    item = "the slow morning train leaves the old station of Boston every day and 1 2 3 4 5 6 Boston 7 8 9"
    assert leaking(item.replace("Boston", "Lisbon", 1), item) == {0}


def test_letter_case_and_what_stands_before_do_not_hide_copies(spark):
    short = "What is the capital of France?"
    names = "Yesterday morning Anna Keller and Boris Novak took the fast train to Geneva, where Clara Rossi met Anna Keller again."
    rows = [(1, "a quiz for all of you\n" + short), (2, "a quiz. " + short), (3, "so we ask " + short.upper()), (4, ITEM.lower()), (5, names.lower()), (6, "What is the price of bread?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, short), (2, ITEM), (3, names)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["verbatim"]) for r in d.find_leaks(docs, items).collect()} == {(1, 1, True), (2, 1, True), (3, 1, True), (4, 2, True), (5, 3, True)}


FRAMES = [
    "A {u0} tank in {n0} is filled by two pipes that pour {v0} {u1} and {v1} {u1} a minute, so how long does {n1} wait until {v2} {u1} are in it?",
    "{n0} buys {v0} boxes with {v1} pencils each and gives {v2} pencils to {n1}, then how many pencils does {n0} keep for the school year?",
    "The road from {n0} to {n1} is {v0} {u1} long, and a cyclist who rides {v1} {u1} before noon still has to ride how far to reach {n1}?",
    "In the year {v0} the town of {n0} had {v1} people, and since then {v2} people moved there from {n1}, so how large is the town today?",
]
NAMES = "Boston Denver Lisbon Madrid Anna Boris Clara Geneva Milan Oslo Peter Riga Sofia Turin Vienna Zagreb".split()


def question(rnd, frame):
    names = rnd.sample(NAMES, 2)
    values = [str(rnd.randrange(2, 999)) for _ in range(3)]
    fields = {f"n{i}": n for i, n in enumerate(names)} | {f"v{i}": v for i, v in enumerate(values)} | {"u0": "water", "u1": rnd.choice(["miles", "liters"])}
    return frame.format(**fields)


def redrawn(rnd, text, what):
    numbers = re.compile(r"[0-9]+")
    spots = list(numbers.finditer(text))
    if what == "one number":
        m = rnd.choice(spots)
        return text[: m.start()] + str(int(m[0]) + rnd.randint(1, 90)) + text[m.end() :]
    if what == "all numbers":
        return numbers.sub(lambda m: str(rnd.randrange(1000, 9999)), text)
    if what == "equal numbers":
        return numbers.sub("77", text)
    if what == "units":
        return text.replace("miles", "km").replace("liters", "gallons" if "gallons" in d.UNITS else "gal")
    if what == "names":
        return re.sub("|".join(NAMES), lambda m: NAMES[(NAMES.index(m[0]) + 5) % len(NAMES)], text)
    return text


@pytest.mark.parametrize("what", ["nothing", "one number", "all numbers", "equal numbers", "units", "names"])
def test_recall_of_changed_items(what):
    rnd = random.Random(what)
    items = [question(rnd, FRAMES[i % len(FRAMES)]) for i in range(40)]
    block = d.Items(list(enumerate(items)))
    hit = sum(i in {r[0] for r in block.leaks("We read this today. " + redrawn(rnd, text, what) + " And so on.", d.Words())} for i, text in enumerate(items))
    assert hit >= 36, (what, hit)
    prose = "A train leaves the station of a town in the north and nobody travels anywhere near the coast today, so how long does it take to reach the sea before the year ends?"
    assert not block.leaks(prose, d.Words())


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,2)", "date", "timestamp", "string", "binary", "double", "boolean"])
def test_item_ids_of_any_type(spark, kind):
    value = {"date": "date'2024-02-29'", "timestamp": "timestamp'2024-02-29 01:02:03.000004'", "binary": "X'00FF10'", "boolean": "true"}.get(kind, f"cast(7 AS {kind})")
    items = spark.createDataFrame([(ITEM,)], "text string").selectExpr(f"{value} AS id", "text")
    docs = spark.createDataFrame([(3, ITEM), (4, "x")], "id long, text string")
    found = d.find_leaks(docs, items, id_col="id", item_col="id")
    assert found.columns[:2] == ["id", "item_id"] and found.schema["item_id"].dataType == items.schema["id"].dataType
    got = found.collect()
    assert [r["id"] for r in got] == [3] and got[0]["item_id"] == items.collect()[0]["id"]
