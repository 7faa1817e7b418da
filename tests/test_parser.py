"""The pattern language and the dialect of its regular expressions."""

import re

import pytest

from arborquill import QueryError, compile_query
from arborquill.functions.regex import check_regex, literals, to_java
from arborquill.plans.pattern import ChildTest, Edge, FieldTest, HeadTest, Value


def test_whole_pattern():
    p = compile_query("""
      # a comment
      MATCH{ V [upos="VERB" & lemma!=/be.*/ & feats.Tense="Past"]; // another
        V-[ nsubj:pass ]->N N << V
        _ -[conj]-> V; V !-> _; _ -> _; V !-[aux]-> W }
      OPTIONAL { O [misc.SpaceAfter=/N\\/o/]; V -> O; }
      EXCEPT { V [form="x"]; }
      OPTIONAL { }
    """)
    assert p.names == ("V", "N", "W", "O") and repr(p) == "Pattern(3 vars)"
    assert p.match.tests["V"] == (FieldTest("upos", Value("VERB")), FieldTest("lemma", Value("be.*", True), None, True), FieldTest("feats", Value("Past"), "Tense"), HeadTest("conj"), ChildTest(None, True))
    assert p.match.tests["N"] == (FieldTest("deprel", Value("nsubj:pass")),) and p.match.tests["W"] == ()
    assert p.match.edges == (Edge("child", "V", "N", "nsubj:pass"), Edge("before", "N", "V"), Edge("child", "V", "W", "aux", True))
    assert p.optionals[0].tests["O"] == (FieldTest("misc", Value("N\\/o", True), "SpaceAfter"),)
    assert len(p.excepts) == 1 and p.optionals[1].variables == ()


@pytest.mark.parametrize(
    "text",
    [
        "", "V [];", "match { }", "MATCH { } MATCH { }", "EXCEPT { } MATCH { }", "MATCH { V [] ;; }", "MATCH { V [pos=\"X\"]; }", "MATCH { V [upos='X']; }", "MATCH { V [upos=\"a\\\"\"]; }",
        "MATCH { V [upos=\"X\" &]; }", "MATCH { V [upos=\"X\", lemma=\"y\"]; }", "MATCH { _ []; }", "MATCH { V < _; }", "MATCH { V -[/a/]-> W; }", "MATCH { V !< W; }", "MATCH { V -> ; }",
        "MATCH { V [upos=//]; }", "MATCH { V [feats.Number[psor]=\"X\"]; }", "MATCH { V [];", "MATCH { 1V []; }", "MATCH { _x -> V; }", "MATCH { V - [a]-> W; }",
    ],
)
def test_syntax_errors(text):
    with pytest.raises(ValueError, match="Query parse error") as e:
        compile_query(text)
    assert e.value.kind == "syntax"


@pytest.mark.parametrize(
    ("text", "kind", "said"),
    [
        ("MATCH { V []; V []; }", "duplicate", "Duplicate variable: V"),
        ("MATCH { V []; } EXCEPT { N []; N []; }", "duplicate", "Duplicate variable: N"),
        ("MATCH { V []; } EXCEPT { V -> N; } OPTIONAL { V -> N; }", "clash", "Variable 'N' already defined in another EXCEPT/OPTIONAL block"),
        ("MATCH { V [form=/[unclosed/]; }", "regex", "Invalid regex pattern"),
        ("MATCH { V [form=/VERB(/]; }", "regex", "Invalid regex pattern"),
    ],
)
def test_other_errors(text, kind, said):
    with pytest.raises(QueryError, match=re.escape(said)) as e:
        compile_query(text)
    assert e.value.kind == kind


def test_variables_again_in_a_further_block():
    assert compile_query('MATCH { V []; } EXCEPT { V [upos="X"]; } OPTIONAL { V [lemma="y"]; V -> N; }').names == ("V", "N")


@pytest.mark.parametrize("bad", ["(?=a)", "(?<!a)b", r"(a)\1", r"\k<a>", "a**", "a*+", "(?>a)", "*a", "|*", "a{", "a{2,1}", "[a--b]", r"\<a", r"\b{start}", "(?x)a", "[b-", "(", ")", "a)", r"\Z", r"\Q", "[[:nope:]]", "\\"])
def test_refused(bad):
    assert check_regex(bad)


@pytest.mark.parametrize(
    ("source", "text", "hit"),
    [
        ("run", "run", True), ("run", "runs", False), ("run", "run\n", False), ("a|b", "ab", False), ("a|b", "b", True), (r"\w+", "café", True), (r"\d", "٣", True), (".", "\r", True), (".", "\n", False),
        ("(?P<x>a)b", "ab", True), ("(?<x_1>a)b", "ab", True), ("[[:alpha:]]+", "abc", True), ("[[:alpha:]]+", "é", False), ("[[:^digit:]]", "a", True), ("[]a]+", "]a", True), ("[^]a]", "b", True), ("[a^]", "^", True),
        (r"\x{41}", "A", True), (r"é", "é", True), (r"\U{1F600}", "😀", True), (r"\pL", "é", True), (r"\p{Letter}+", "aé", True), (r"\p{Greek}", "α", True), (r"\P{Lu}", "a", True), (r"\p{^Lu}", "A", False), (r"\p{Script=Cyrillic}", "я", True),
        ("(?i)STRASSE", "strasse", True), ("(?i:É)", "é", True), ("(?s).", "\n", True), ("a$", "a", True), ("x{2,3}", "xxx", True), ("x{2}", "xxx", False), ("a+?", "aaa", True), (r"\/", "/", True), ("}", "}", True), (r"a\vb", "a\x0bb", True), ("[a-c&&[^b]]", "b", False), ("", "", True),
    ],
)
def test_translated(spark, source, text, hit):
    assert check_regex(source) is None
    assert spark._jvm.java.util.regex.Pattern.compile(to_java(source)).matcher(text).find() is hit


def test_literals():
    assert literals("VERB|AUX") == ["VERB", "AUX"] and literals("(can|may)") == ["can", "may"] and literals("run") == ["run"]
    assert literals("a.b") is None and literals("a|") is None and literals("(a)|(b)") is None
