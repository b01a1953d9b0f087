"""Regular expressions through the trigram index, and names against author fields, against plain definitions."""

import re

import pytest
from pyspark.sql import functions as F

from docspark.functions import entities
from docspark.operators import patterns

PATTERNS = [
    "inflation", "policy|monetary", "col(ou?)r", "gr[ae]y (cat|dog)", "ab+c", "a{3}", "x.*y", "foo(bar)+baz", "(one|two|three) hundred", r"\bnew york\b", "cafés", "straße", r"\d{4}-\d{2}",
    "^begin", "end$", "s[a-z]lk", "kelvin", "ISTANBUL", "(?:quick|slow) brown", "no(?=thing)", "[xyz]tra", "a|b", "", "p(r(i)c)e", "abc?def", "(abc|x.z)def", "(ab|cd){2}", "[^a]bcd", r"dot\.com", "a++b", "tr(?:y|ies) it",
    "\\Qa.b\\E", "[a&&b]c", r"\p{L}+x", "(?x) a b", "mass(?!ive)", "(.)\\1ok",
]
TEXTS = [
    "Inflation POLICY", "monetary", "the colour and color", "gray dog, grey cat", "abbbbc abc ac", "aaa", "x and y", "foobarbarbaz foobaz", "two hundred", "in New York now", "CAFÉS", "Straße", "on 2024-05", "begin end", "ſILK and silk",
    "Kelvin", "İstanbul ıSTANBUL istanbul", "slow brown", "nothing", "ytra", "", None, "price", "abdef abcdef", "axzdef xqzdef", "abab cdab", "xbcd", "dot.com dotxcom", "aaab", "tries it", "a.b", "bc", "üx", "ab", "mass", "bbok", "massive",
]


def test_every_pattern_equals_a_scan(spark):
    df = spark.createDataFrame([(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)], "id long, title string, text string")
    index = patterns.build(df, "id", "title", "text").cache()
    skipped = []
    for p in PATTERNS:
        want = sorted(r.id for r in df.where(patterns.matches(p, "title", "text")).collect())
        assert sorted(r.id for r in patterns.search(df, index, p, "id", "title", "text").collect()) == want, p
        some = patterns.candidates(index, p)
        skipped.append(some is not None and some.count() < len(TEXTS))
    assert sum(skipped) > len(PATTERNS) // 2
    index.unpersist()


@pytest.mark.parametrize("pattern", ["a|b", "", "..", "\\Qabc\\E", "[abc&&b]def", r"\p{L}abc", "(?x) a b c", "abc\\", "[[abc]def]", r"a\x41bcd", "x*"])
def test_patterns_that_say_nothing(pattern):
    assert patterns.condition(pattern) is True


def test_conditions():
    g = patterns.code
    assert patterns.condition("Abc") == g("abc")
    assert patterns.condition("abc|xyz") == ("or", [g("abc"), g("xyz")])
    assert patterns.condition("ab+cd") == ("and", [g("bcd")]) or patterns.condition("ab+cd") == g("bcd")
    assert patterns.needed(patterns.condition("ab[cd]e")) == {g("abc"), g("bce"), g("abd"), g("bde")}
    assert patterns.needed(patterns.condition("abc.*def")) == {g("abc"), g("def")}


def test_names_of_a_table_against_authors(spark):
    names = ["Dr. Ann Lee-Park", "ann  lee-park", "Bo Li", "R. Menon", "Prof Menon", "", None, "Cher", "X. Y. Zimmer", "Mr."]
    authors = ["Ann Lee-Park", "K. Menon & R. Das", "Menon, Latha; Bo Li", "bo li", "Li Bo", None, "", "Cher", "Cheryl", "Zimmer,Hans"]
    left = spark.createDataFrame(list(enumerate(names)), "n long, name string")
    right = spark.createDataFrame(list(enumerate(authors)), "a long, author string")
    got = {(r.n, r.a) for r in entities.name_pairs(left, right, "n", "name", "a", "author").collect()}
    want = set()
    for n, name in enumerate(names):
        if name:
            want |= {(n, r.a) for r in right.where(entities.author_matches(F.col("author"), [name])).collect()}
    assert got == want and len(got) > 5
    lists = spark.createDataFrame([(0, ["Ann Lee-Park", None, "Hans Zimmer"]), (1, []), (2, None)], "a long, author array<string>")
    assert {(r.n, r.a, r.exact) for r in entities.name_pairs(left, lists, "n", "name", "a", "author").collect()} == {(0, 0, True), (1, 0, True), (8, 0, False)}
    plan = entities.name_pairs(left, right, "n", "name", "a", "author")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)
