"""Standard shares: matching, collapsing, flags, checks."""

import pytest
from pyspark.sql import functions as F

from cartloom.operators import lines as N
from cartloom.operators import members as M
from cartloom.operators import settings_edit as E
from cartloom.operators import standards as S

MEMBERS = "group_name string, firstname string, lastname string, `order` string, id long"
SHARES = "group_name string, group_name_short string, food_list_group_name string"
STD_MEMBERS = "food_list_group_name string, name_long string, keep_remove boolean"
STD_ITEMS = "food_list_group_name string, item_original string"
NONE = []

ORDERS = [
    "1 Full, 1x1 Egg, 2x1 Oat",  # 1 the standard itself
    "1 Full, 2x1 Oat, 1x1 Egg, 1x1 Egg",  # 2 order and repeats do not matter
    "1 Full, 1x1 Tea, 1x1 Egg, 2x1 Oat",  # 3 an extra before the last standard line
    "1 Full, 1x1 Egg, 2x1 Oat, 1x1 Tea",  # 4 an extra after it
    "1 Full, 1x1 Egg, 1x1 Oat",  # 5 another quantity
    "1 Full, 1x1 Egg",  # 6 a part
    "1 Full, 1x1 Tea, 1x1 Tea, 1x1 Egg, 2x1 Oat, 1x2 @4 X Pickup Time",  # 7 repeated extra
    None,  # 8
]


def carts(spark, orders=ORDERS):
    rows = [("Shop", "F", f"L{i}", order, i) for i, order in enumerate(orders, 1)]
    rows.append(("Else", "F", "L99", "1x1 Egg, 2x1 Oat", 99))
    return M.member_carts(spark.createDataFrame(rows, MEMBERS))


def shares(spark):
    return spark.createDataFrame([("Long Shop", "Shop", "A"), ("Else", None, "H")], SHARES)


def group_std(spark, df, named=NONE, items=(("A", "1x1 Egg"), ("A", "2x1 Oat"), ("A", "2x1 Oat"))):
    std_members = spark.createDataFrame(list(named), STD_MEMBERS)
    std_items = spark.createDataFrame(list(items), STD_ITEMS)
    lines = S.standard_lines(df, std_members, std_items)
    return std_members, lines, S.group_standards(lines, shares(spark))


def test_full_and_extras(spark):
    df = carts(spark)
    named, _, std = group_std(spark, df)
    full = sorted((r.id, r.keep_remove) for r in S.standard_full_match(df, named, std).collect())
    assert full == [(1, True), (2, True)]
    extra = sorted((r.id, r.item_original) for r in S.standard_with_extras(df, std).collect())
    assert extra == [(3, "1x1 Tea"), (7, "1x1 Tea")]
    held = sorted(r.id for r in S.standard_with_extras(df, std, extras="containment").collect())
    assert held == [3, 4, 7]
    with pytest.raises(ValueError):
        S.matched_carts(df, std, extras="any")


def test_collapse_keeps_shares_pickups_and_extras(spark):
    df = carts(spark)
    named, _, std = group_std(spark, df)
    short = S.apply_standards(df, named, std).select(*df.columns)
    rows = N.in_print_order(N.member_rows(short)).collect()

    def items(member):
        return [r.item for r in rows if r.id == member]

    assert items(1) == ["L1, F", "1 Full", "STANDARD SHARE ITEMS", None]
    assert items(7) == ["L7, F", "1 Full", "2 @4 X Pickup Time", "STANDARD SHARE ITEMS", "1 Tea", "1 Tea", None]
    assert items(4) == ["L4, F", "1 Full", "1 Egg", "1 Oat", "1 Tea", None]
    assert items(99) == ["L99, F", "1 Egg", "1 Oat", None]
    # outside the matched members every line stays
    before = N.member_rows(df.filter(~F.col("id").isin(1, 2, 3, 7))).count()
    assert len([r for r in rows if r.id not in (1, 2, 3, 7)]) == before


def test_member_as_standard_and_removal(spark):
    df = carts(spark)
    named, lines, std = group_std(spark, df, [("A", "L1, F [1]", False), ("H", None, None)], NONE)
    assert {r.item_original for r in lines.collect()} == {"1x1 Egg", "2x1 Oat"}
    full = sorted((r.id, r.keep_remove) for r in S.standard_full_match(df, named, std).collect())
    assert full == [(1, False), (2, True)]
    short = S.apply_standards(df, named, std)
    ranks = {r.id: len(r.cart) for r in short.collect()}
    assert ranks[1] == 3 and ranks[2] == 2  # marked for removal: printed in full
    dropped = S.apply_standards(df, named, std, drop_removed=True)
    assert 1 not in {r.id for r in dropped.collect()}
    summary = sorted(tuple(r) for r in S.standard_summary(df, named, std).collect())
    assert summary[0] == ("Shop", "L1, F [1]", False, False) and len(summary) == 4


def test_member_of_two_food_groups_stays_one_row(spark):
    df = carts(spark)
    named, _, std = group_std(spark, df, [("A", "L1, F [1]", True), ("H", "L1, F [1]", False)], NONE)
    assert S.apply_standards(df, named, std).count() == df.count()
    assert (1, True) in {tuple(r) for r in S.standard_full_match(df, named, std).collect()}


def test_standard_member_without_order_matches_missing_orders(spark):
    df = carts(spark)
    named, _, std = group_std(spark, df, [("A", "L8, F [8]", True)], NONE)
    assert [r.id for r in S.standard_full_match(df, named, std).collect()] == [8]


def test_flags_use_items_without_quantity(spark):
    df = carts(spark)
    _, lines, _ = group_std(spark, df, items=(("A", "1x1 Egg"), ("A", "1 No Share")))
    flags = S.standard_items(lines, shares(spark))
    got = {(r.group_name, r.item) for r in flags.collect()}
    assert got == {("Shop", "1 Egg"), ("Shop", None)}
    flagged = S.flag_standard_items(N.member_rows(df), flags)
    bold = {r.item for r in flagged.filter("standard_item = 1").collect()}
    assert bold == {"1 Egg", None}  # an item typed without quantity flags rows without an item


def test_conflict_and_coverage(spark):
    named = spark.createDataFrame([("A", "x", True), ("H", None, None)], STD_MEMBERS)
    items = spark.createDataFrame([("A", "1x1 Egg"), ("C", "1x1 Egg"), ("C", "1x1 Oat")], STD_ITEMS)
    assert [tuple(r) for r in S.standards_conflict(named, items).collect()] == [("A", 1, 1)]
    with pytest.raises(ValueError, match="both a member and items"):
        S.require_no_conflict(named, items)
    assert tuple(S.standards_coverage(named, items).first()) == (2, True)
    assert tuple(S.standards_coverage(named, items, expected=2).first()) == (2, False)


def test_upsert_and_clear(spark):
    std = spark.createDataFrame([("A", None, None), ("H", "y", True)], STD_MEMBERS)
    changed = E.upsert_standard_member(std, "A", "x", False)
    assert sorted(tuple(r) for r in changed.collect()) == [("A", "x", False), ("H", "y", True)]
    cleared = E.clear_standard_member(changed, "H")
    assert sorted(tuple(r) for r in cleared.collect()) == [("A", "x", False), ("H", None, None)]
    assert E.upsert_standard_member(std, "Z", "x", True).count() == 2


def test_rules_are_added_removed_and_renumbered(spark):
    schema = "match_name string, text_name string, row_num int"
    rules = spark.createDataFrame([("equal", "a", 1), ("contains", "b", 2), ("equal", "c", 3)], schema)

    def shown(df):
        return sorted((r.row_num, r.match_name, r.text_name) for r in df.collect())

    new = spark.createDataFrame([("equal", "d")], "match_name string, text_name string")
    assert shown(E.add_rule(rules, new))[-1] == (4, "equal", "d")
    again = spark.createDataFrame([("equal", "a")], "match_name string, text_name string")
    assert shown(E.add_rule(rules, again)) == shown(rules)
    assert shown(E.remove_rule(rules, 2)) == [(1, "equal", "a"), (2, "equal", "c")]


def test_sites_with_one_short_name_do_not_multiply_members(spark):
    two = spark.createDataFrame([("Long Shop", "Shop", "A"), ("Other Shop", "Shop", "A"), ("Else", None, "H")], SHARES)
    df = carts(spark)
    std_members = spark.createDataFrame(NONE, STD_MEMBERS)
    items = spark.createDataFrame([("A", "1x1 Egg"), ("A", "2x1 Oat")], STD_ITEMS)
    sets = S.group_standards(S.standard_lines(df, std_members, items), two)
    matched = S.matched_carts(df, sets)
    assert matched.count() == df.count() == matched.select("id").distinct().count()
