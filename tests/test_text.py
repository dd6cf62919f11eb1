import pytest

from logloom.functions import text as T
from logloom.functions import similarity as S

#: Hand-worked outputs per rule.
CASES = {
    T.correct_message: {
        "": "", "   ": "", "...": "", "a\t b": "a b",
        "Failed ... invalid user from 1.2.3.4 ... .": "Failed invalid_user from 1.2.3.4",
        "logname uid=0 ruser rhost=1.2.3.4": "logname null uid=0 ruser null rhost=1.2.3.4",
    },
    T.mask_message: {"": "", "ok ok ok done done": "ok done", "a 12 b": "a Varb", "Monitor Marvel": "Varitor Varvel"},
    T.rule_label: {
        "at 12:30": "at {time}", "from 10.0.0.1": "from {ip_address}", "value = 17": "value = {unknown}",
        "uid=0 x": "uid{unknown} x", "child 6725 in": "child {number} in", "open /tmp/x": "open {file_path}",
        "mail a@b.c": "mail {email}",
    },
    T.canonical_template: {"a {x} {y} b": "a <*> b", "{a} - {b}": "<*>", "end <*>.": "end <*>", "": ""},
    T.remove_punctuation: {"a.b,c!": "abc", "!!!": ""},
    T.tokens: {
        "a=b": ["a"], "a=b=c": ["a=b=c"], "x=1,y=2": ["x", "y"], "a/b=c": ["a/b"], "/a/b c/d": ["/a/b c/d"],
        "took 3.5 s": ["took", "*", "s"],
    },
}


@pytest.mark.parametrize("rule", CASES, ids=lambda f: f.__name__)
def test_rule(spark, rule):
    df = spark.createDataFrame([(k,) for k in CASES[rule]], "s string")
    assert {r.s: r.v for r in df.select("s", rule("s").alias("v")).collect()} == CASES[rule]


def test_similarities(spark):
    rows = [("abc", "abd", 0.5), ("", "", 0.0), ("", "a", 0.0), ("aaaa", "a", 1.0), ("xyz", "zyx", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    got = df.select("want", S.char_jaccard("a", "b").alias("j"), S.edit_similarity("a", "b").alias("e")).collect()
    for r in got:
        assert r.j == pytest.approx(r.want)
    assert got[1].e == 1.0


def test_templates_equal_folded(spark):
    df = spark.createDataFrame([("a <*>x b", "a <*> b"), ("a b", "a c")], "t string, p string")
    assert [r.v for r in df.select(T.templates_equal_folded("t", "p").alias("v")).collect()] == [True, False]
