"""Items meet rules through an index; the hits equal testing every item with every rule."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import settings as hyp_settings
from hypothesis import strategies as st

from cartloom.operators import rule_index

PATTERNS = {
    "1 Each red": "1 Each red", "a|b": "", "abc+d": "abc", "abcd*e": "abc", "abcd?ef": "abc", "ab{2,3}cde": "cde", "(abc)def": "def",
    "(abc|x)": "", "^abc$": "abc", "a.cde": "cde", "[abc]def": "def", "[]a]bcd": "", "[^]a]bcd": "", "[a[b]]cde": "", "a\\.bc": "a.bc",
    "\\d+abc": "abc", "(?i)abc": "", "\\Qabc\\E": "", "\\x41bc": "", "\\p{L}abc": "", "abc\\": "", "abc)": "", "(abc": "", "[a\\]b]cde": "cde",
    "a*+bcd": "bcd", "ab+?cd": "ab", "": "", "(a(b)c)?def": "def",
}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_literals(pattern):
    assert rule_index.required_literal(pattern) == PATTERNS[pattern]


@hyp_settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab(|)[]^.*+?\\d$", max_size=10), st.lists(st.text(alphabet="ab1.[", max_size=8), max_size=6))
def test_every_match_holds_the_literal(pattern, items):
    try:
        compiled = re.compile(pattern)
    except re.error:
        return
    literal = rule_index.required_literal(pattern)
    assert all(literal in i for i in items if compiled.search(i))


def hit(item, kind, text):
    if kind == "equal":
        return item == text
    if kind == "starts with":
        return item.startswith(text)
    if kind == "ends with":
        return item.endswith(text)
    return kind == "contains" and re.search(text, item) is not None


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_hits_equal_every_item_with_every_rule(spark, broadcast):
    rng = random.Random(2)
    words = ["red", "blue", "gear", "bolt", "égg", "a.b", "x"]
    items = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(400)} | {"", "r", "re"})
    texts = ["", "r", "red", "red b", " bolt", "gear", "égg", "gé", "a.b", "red gear red", "nothing like it"]
    patterns = [*texts, "r.d", "(red|blue) g", "^red", "bolt$", "b+o?lt", "g[ae]{2}r", "\\bx\\b", "é", "d g|e r", "a\\.b"]
    rules = [(k, t, n) for n, (k, t) in enumerate([
        *((k, t) for k in ("equal", "starts with", "ends with", "other") for t in texts), *(("contains", p) for p in patterns),
        ("equal", "red"), ("equal", "red"), ("contains", None), ("equal", None), (None, "red"),
    ])]
    want = Counter((i, n) for i in items for k, t, n in rules if t is not None and hit(i, k, t))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = rule_index.rule_hits(
            spark.createDataFrame([(i,) for i in items], "item string"),
            spark.createDataFrame(rules, "match_name string, text_name string, n int"), ["n"],
        )
        assert Counter((r.item, r.n) for r in df.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_rules_and_no_items(spark):
    items = spark.createDataFrame([("a",)], "item string")
    rules = spark.createDataFrame([("equal", "a", 1)], "match_name string, text_name string, n int")
    for i, r in ((items.limit(0), rules), (items, rules.limit(0))):
        got = rule_index.rule_hits(i, r, ["n"])
        assert got.columns == ["item", "n"] and got.count() == 0


def test_only_candidates_are_tested(spark):
    """Rows that reach the tests of patterns grow with the hits, not with items times rules."""
    items = spark.range(20_000).selectExpr("concat('item ', id, ' of many') AS item")
    rules = spark.range(2_000).selectExpr("'contains' AS match_name", "concat('m ', id * 7, ' o.') AS text_name", "id AS n")
    got = rule_index.rule_hits(items, rules, ["n"])
    assert got.count() == 2_000
