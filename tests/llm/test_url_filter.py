"""URL verdicts against a matcher that tries each glob on its own."""

import random
import re

from arborquill.llm import url_filter


def glob_matches(glob, text):
    out = ""
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out += {"**": r"[\s\S]*", "*": r"[^/]*", "?": r"[\s\S]"}.get(part) or re.escape(part)
    return re.fullmatch(out, text) is not None


def judged(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2], host + path
    return host, path, None, None, host + path


def texts():
    rnd = random.Random(3)
    parts = ["http://", "https://", "://", "www.", "example.com", "EXAMPLE.com", "net", "casino", "porn", "/", "/en/", "/es/", "?", "#", "x", ".", "adult-a", "é", "\n", "wp-login.php", "wp-login.ph", "wp-login.phé", "jackpot", "free-bets", "xxx-", "com", ":80", "//"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))) for _ in range(3000)]
    return [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/x?y#z", "http://a.net/es/", "http://net/fr/x", "http://xnet/fr/x", "http://example.com/EN/", "http://h/" + "a/" * 3000 + "casino", *made]


def test_as_tried_one_by_one(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule").repartition(3)
    got = {r["page_id"]: r for r in url_filter.judge_urls(frame).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        host, path, rule, verdict, whole = judged(url)
        caught = [g for g in url_filter.GLOBS if glob_matches(g, whole)]
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["glob"]) == (host, path, rule, caught[0] if caught else None), url
        assert r["verdict"] == (verdict or ("block" if caught else "allow")), url


def test_many_rules_fill_several_words():
    rnd = random.Random(4)
    globs = ["".join(rnd.choice(["a", "b", "*", "**", "?", "/"]) for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    urls = ["".join(rnd.choice("ab/é😀") for _ in range(rnd.randint(0, 10))) for _ in range(300)]
    automaton = url_filter.Automaton(globs)
    assert automaton.words > 3
    hit = automaton.match([u.encode() for u in urls])
    normal = lambda g: re.sub(r"\*{2,}", "**", g)
    for i, u in enumerate(urls):
        for k, g in enumerate(globs):
            if "***" not in g:
                assert hit[i, k] == glob_matches(normal(g), u), (g, u)


def test_empty_table(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
