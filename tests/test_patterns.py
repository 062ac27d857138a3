"""Users' patterns: what they match and replace, what is refused, and that none can hang or break a task."""

import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import text as T

#: pattern, replacement, text, result
REPLACED = [
    (r"\p{Lu}", "_", "aBÉc", "a__c"), (r"\pL+", "x", "ab12é", "x12x"), (r"\p{Greek}+", "g", "aβγb", "agb"), (r"\p{Uppercase_Letter}", "u", "aB", "au"), (r"\P{L}", "", "a1b2", "ab"), (r"\p{^L}", "", "a1b2", "ab"),
    (r"(?P<x>b)", "$x$x", "abc", "abbc"), (r"(?<y>b)", "[${y}]", "abc", "a[b]c"), (r"(b)", "$2", "abc", "ac"), (r"b", "${nm}", "abc", "ac"), (r"(a)(b)?", "$2-$1", "ac", "-ac"),
    (r"^(\d+)-(\d+)$", "$2a$1", "12-34", "34a12"), (r"b", "$", "abc", "a$c"), (r"b", "$$", "abc", "a$c"), (r"b", "a$b c", "abc", "aa cc"), (r"b", r"\1", "abc", r"a\1c"), (r"(b)", "$10", "abc", "ac"), (r"b", "${", "abc", "a${c"), (r"b", "$01", "abc", "ac"), (r"(b)", "$01", "abc", "abc"), (r"b", "$0!", "abc", "ab!c"),
    (r"a*", "x", "baac", "xbxcx"), (r"(?:)", "-", "ab", "-a-b-"), (r"b*?", "x", "bb", "xbxbx"), (r"(?i)É", "e", "éÉ", "ee"), (r"(?i:a)b", "x", "Ab AB", "x AB"), (r"a(?i)b|c", "x", "aB C c", "x x x"),
    (r"a.c", "x", "a\nc a\rc", "a\nc x"), (r"(?s)a.c", "x", "a\nc", "x"), (r"(?m)^", ">", "a\nb\n", ">a\n>b\n>"), (r"(?m)$", "<", "a\nb", "a<\nb<"), (r"$", "<", "a\n", "a\n<"), (r"(?x) a # one" + "\n b", "y", "ab", "y"), (r"(?U)a+", "x", "aa", "xx"), (r"(?U)a+?", "x", "aa", "x"),
    (r"[[:alpha:]]+", "w", "ab1é", "w1é"), (r"[a-z&&[^aeiou]]", "", "hello", "eo"), (r"[a-z--[aeiou]]", "", "hello", "eo"), (r"[a-c~~b-d]", "x", "abcd", "xbcx"), (r"[]a]", "x", "]ab", "xxb"), (r"[^]a]", "x", "]ab", "]ax"), (r"[a\-z]", "x", "a-bz", "xxbx"), (r"[-a]", "x", "-a", "xx"), (r"[^\d\s]", "", "a1 b", "1 "), (r"[&#]", "+", "a&#b", "a++b"),
    (r"\x41\x{42}\u0043\U00000044", "x", "ABCD", "x"), (r"a\.b\/c\#", "x", "a.b/c#", "x"), (r"a**b", "x", "aab", "x"), (r"a*+", "x", "b", "xbx"), (r"a{2}{2}", "x", "aaaaa", "xa"), (r"\bfoo\b", "x", "foo foobar", "x foobar"), (r"(?-u:\w)", "x", "aé", "xé"), (r"\w", "x", "aé_1-", "xxxx-"), (r"(\w+ )*z", "x", "a b z", "x"), (r"(?:a|b)*c", "x", "abac", "x"), (r"\d", "x", "٣4", "xx"), (r"(|a)b", "x", "ab", "x"), (r"(?:a+)+b", "x", "aab", "x"),
    (r"[\[\]]", "", "[a]", "a"), (r"\{x\}", "y", "{x}", "y"), (r"(?P<a_b>x)", "${a_b}y", "x", "xy"), (r"é{1,2}", "e", "éé", "e"), (r"\z", "!", "a", "a!"), (r"[\w--\d]+", "w", "ab1", "w1"),
]
REFUSED = ["(", ")", "a(", "[a", r"(a)\1", "(?=a)", "(?<!a)b", "(?>a)", "*a", "a{3,1}", "a{x", r"\q", r"\p{Nothing}", "(?z)a", "(?P<1>a)", "(?P<a>x)(?P<a>y)", "(a+)+", "(a*)*b", r"(\s*,\s*)*$", "(a|a)*", "(a|ab|b)*c", "(?:a?b?)*c", "[b-a]", "a{1000}{1000}", "\\", r"[a-\d]", r"[\d-a]"]


@pytest.mark.parametrize("pattern, replacement, text, result", REPLACED)
def test_replaced(spark, pattern, replacement, text, result):
    got = spark.createDataFrame([(text,)], "x string").select(T.transform(F.col("x"), search=pattern, replacement=replacement)).first()[0]
    assert got == result


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(spark, pattern):
    with pytest.raises(ValueError):
        T.check_pattern(pattern)


FORMATS = [
    (r"tt[0-9]+", {"tt12": True, "tt": False, "att1": False, "tt1\n": False}), (r"[a-z]+|\d+", {"ab": True, "12": True, "a1": False}), (r"(?=.*\d)[a-z\d]+", {"a1": True, "ab": False}), (r"(?P<a>x)(?P=a)", {"xx": True, "x": False}), (r"(a)\1", {"aa": True, "ab": False}),
    (r"(?!0)\d+", {"10": True, "01": False}), (r"(?>a+)b", {"aab": True, "aa": False}), (r"a++b", {"aab": True}), (r"^\d+$", {"1": True, "x": False}), (r"([A-Z]+\d*)+", {"AB1C2": True, "ab": False, "A" * 60 + "!": False}), (r"(\s*,\s*)*", {" , ,": True, " , x": False}), (r"(a+)+(b|c)\d{2,3}", {"aab12": True, "a" * 60: False}),
    (r"\p{Lu}\p{Ll}+(-\p{Lu}\p{Ll}+)*", {"Anna-Lena": True, "anna": False}), (r"\h{2}", {"aF": True, "g0": False}), (r"x{", {"x{": True}), (r"(?i)q\d+", {"Q1": True}), ("", {"": True, "a": False}),
]


@pytest.mark.parametrize("pattern, cases", FORMATS)
def test_formats(spark, pattern, cases):
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, x string")
    got = [r[0] for r in rows.select(P.whole_match(F.col("x"), pattern), "i").orderBy("i").collect()]
    assert got == list(cases.values())
    assert time.time() - began < 20


@pytest.mark.parametrize("pattern", ["(", r"\2", "(?(1)a)", r"(?=(a+)+$)b", r"\k<n>", "[", r"\Kx"])
def test_formats_that_are_not_understood(spark, pattern):
    assert P.whole_match(F.col("x"), pattern) is None


def test_mentions_any_sign(spark):
    rows = [("a C:\\Elephant(, b", "C:\\Elephant(", True), ("x\\Ey", "\\E", False), ("x\\E y", "\\E", True), ("\\Q1", "\\Q1", True), ("(a", "(a", True), ("aa", "b", False), ("a\\E\\E;", "\\E\\E", True)]
    got = spark.createDataFrame(rows, "t string, n string, want boolean").where(~T.mentions(F.col("t"), F.col("n")).eqNullSafe(F.col("want"))).collect()
    assert got == []


_ATOM = st.sampled_from(["a", "b", "[ab]", "[^a]", ".", r"\d", "c"])
_PATTERN = st.recursive(_ATOM, lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda p: f"(?:{p[0]}|{p[1]})"), x.map(lambda p: f"(?:{p})*"), x.map(lambda p: f"({p})+"), x.map(lambda p: f"(?:{p}){{1,2}}"), x.map(lambda p: f"(?:{p})?")), max_leaves=6)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(_PATTERN, st.lists(st.text("abc1 ", max_size=9), min_size=3, max_size=3))
def test_against_another_engine(spark, pattern, texts):
    """Whole matches by either way, and whether the automaton of a pattern that isn't refused agrees."""
    tree, _, _ = P.parsed(pattern)
    want = [re.fullmatch(pattern, t) is not None for t in texts]
    places = P.Places(tree, whole=True)
    assert [P.accepts(places, t) for t in texts] == want
    java = spark._jvm.java.util.regex.Pattern.compile(rf"(?dU)\A(?:{P.java(tree)})\z")
    assert [java.matcher(t).find() for t in texts] == want


def test_what_is_not_refused_runs_in_bounded_time(spark):
    """Long texts that almost match, for patterns with nested repeats that pass."""
    for pattern in (r"(\w+ )*z", r"(?:[^,]+,)*x", r"(a[0-9]*)+!", r"(?:(?:ab)*c)*d"):
        began = time.time()
        spark.createDataFrame([("ab " * 300 + "," * 30 + "a1" * 300 + "ababc" * 200,)], "x string").select(T.transform(F.col("x"), search=pattern, replacement="")).collect()
        assert time.time() - began < 20, pattern
