"""Order text to lines: tokens, split, class, slots, names."""

import pytest
from pyspark.sql import functions as F

from cartloom.functions.cart import parse_cart, order_tokens
from cartloom.functions.text import na_text, piece, remove_first, rgb_part, trim_blanks, zero_pad_week
from cartloom.operators import lines as N
from cartloom.operators import members as M
from cartloom.operators import pickup as U

MEMBERS = "group_name string, firstname string, lastname string, `order` string, id long"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, want",
    [
        ("a,b", ["a", "b"]),
        ("a,", ["a"]),
        ("a,,", ["a", ""]),
        (",a", ["", "a"]),
        (",", [""]),
        ("", []),
        (None, [None]),
    ],
)
def test_order_tokens(spark, text, want):
    assert one(spark, order_tokens("t"), t=text) == want


@pytest.mark.parametrize(
    "token, quantity, item, rank",
    [
        ("1x1 Each Extra", "1", "1 Each Extra", 3),
        ("0.5x1 Box of x", "0.5", "1 Box of x", 3),
        ("1 Half", None, "1 Half", 1),
        ("1 No Share - Order Only (even wk)", None, "1 No Share - Order Only (even wk)", 3),
        ("1x2 @4-4:30 Shop Pickup Time", "1", "2 @4-4:30 Shop Pickup Time", 2),
        ("Pickup Time", None, "Pickup Time", 1),
        ("2x2", None, "2", 1),
        ("x", None, "", 1),
        ("1x", "1", "", 3),
        ("", None, "", 1),
        (None, None, None, 3),
        ("mixed nuts", "mi", "ed nuts", 3),
    ],
)
def test_split_and_class(spark, token, quantity, item, rank):
    if token == "":
        cart = one(spark, parse_cart("t"), t=" ,")
    else:
        cart = one(spark, parse_cart("t"), t=token)
    assert [(x.quantity, x.item, x.rank, x.item_original) for x in cart] == [(quantity, item, rank, token)]


def test_numeric_quantity_option(spark):
    cart = one(spark, parse_cart("t", quantity_only_numeric=True), t="mixed nuts, .5x1 Box, 2x1 Tax")
    assert [(x.quantity, x.item) for x in cart] == [(None, "mixed nuts"), (".5", "1 Box"), ("2", "1 Tax")]


def test_text_functions(spark):
    assert one(spark, trim_blanks(F.col("a")), a="\t a b \r\n") == "a b"
    assert one(spark, na_text(F.col("a")), a=None) == "NA"
    assert one(spark, remove_first(F.col("a"), F.col("b")), a="Doe W.E. W.E.", b="W.E.") == "Doe  W.E."
    assert one(spark, remove_first(F.col("a"), F.col("b")), a="Doe", b="W.E.") == "Doe"
    assert one(spark, piece(F.col("a"), " ", 2, 3), a="2 @4 a b c") == "a b c"
    assert one(spark, piece(F.col("a"), " ", 2, 3), a="2 @4") is None
    assert [one(spark, zero_pad_week(F.col("a")), a=w) for w in ("7", "12", "123", None)] == ["07", "12", "123", None]
    assert one(spark, rgb_part(F.col("a"), 2), a="rgb(255, 51, 0)") == pytest.approx(0.2)
    assert one(spark, rgb_part(F.col("a"), 2), a="red") is None


def test_home_delivery(spark):
    rows = [
        ("Home Delivery - East W.E1 ", "Ann", " Bell W.E1", "a", 1),
        ("Home Delivery - East W.E1", "Bob", "Cole X.E1", "a", 2),
        ("Home Delivery - East W.E1", "Cy", "Doe", "a", 3),
        ("Home Delivery - East W.E1", "Di", None, "a", 4),
        ("Shop", "Ed", "Fox W.E1", "a", 5),
    ]
    df = spark.createDataFrame(rows, MEMBERS)
    got = {r.id: (r.group_name, r.lastname) for r in M.normalise_home_delivery(df).collect()}
    assert got == {
        1: ("Home Delivery - W.E1", "Bell"),
        2: ("Home Delivery - W.E1", "Cole X.E1"),
        3: ("Home Delivery - W.E1", "Doe"),
        4: ("Home Delivery - W.E1", None),
        5: ("Shop", "Fox W.E1"),
    }
    flagged = M.home_delivery_check(df).collect()
    # a missing detail never flags, a short last name does
    assert sorted((r.firstname, r.pickup_detail_v2) for r in flagged) == [("Bob", "X.E1"), ("Cy", "Doe")]


SHARES = "group_name string, group_name_short string, food_list_group_name string, highlight_color_hex string"


def test_short_names_and_group_check(spark):
    shares = spark.createDataFrame(
        [("Shop", "S", "A", "#111111"), ("Mill", "", "H", None), ("Farm", None, "H", "#222222")], SHARES
    )
    df = spark.createDataFrame(
        [("Shop", "a", "b", "", 1), ("Mill", "a", "b", "", 2), ("Farm", "a", "b", "", 3), (None, "a", "b", "", 4)],
        MEMBERS,
    )
    got = {r.id: r.group_name for r in M.short_group_names(df, shares).collect()}
    assert got == {1: "S", 2: "Mill", 3: "Farm", 4: None}
    assert [r.group_name for r in M.group_check(df, shares).collect()] == [None]
    with pytest.raises(ValueError, match="missing from the settings"):
        M.require_known_groups(df, shares)


def test_member_counts_and_reconciliation(spark):
    rows = [("G", "a", "b", "", 1), ("G", "a", "b", "", 2), ("G", None, "b", "", 3), ("H", "a", "b", "", 4)]
    start = M.member_counts(spark.createDataFrame(rows, MEMBERS), "n_start")
    end = M.member_counts(spark.createDataFrame([rows[0], ("K", "x", "y", "", 9)], MEMBERS), "n_end")
    got = sorted(tuple(r) for r in M.reconciliation(start, end).collect())
    assert got == [("G", 2, 1, -1), ("H", 1, None, None), ("K", None, 1, None)]


def carts(spark, *orders):
    rows = [("G", "F", f"L{i}", order, i) for i, order in enumerate(orders, 1)]
    return M.member_carts(spark.createDataFrame(rows, MEMBERS))


def test_long_model(spark):
    rows = N.in_print_order(N.long_lines(carts(spark, "1x1 A, 1 Half, 1x2 @4 Shop Pickup Time", None))).collect()
    shown = [(r.id, r.rank, r.item, r.description) for r in rows]
    assert shown == [
        (0, -1, "G", "....."),
        (1, 0, "L1, F", "Shop Pickup Time"),
        (1, 1, "1 Half", "Shop Pickup Time"),
        (1, 2, "2 @4 Shop Pickup Time", "Shop Pickup Time"),
        (1, 3, "1 A", "Shop Pickup Time"),
        (1, 4, None, "Shop Pickup Time"),
        (2, 0, "L2, F", None),
        (2, 3, None, None),
        (2, 4, None, None),
    ]
    assert rows[1].name_long == "L1, F [1]" and rows[0].name_long == "0, 0 [0]"


def test_empty_order_has_no_lines_but_a_name_row(spark):
    assert [r.rank for r in N.in_print_order(N.member_rows(carts(spark, ""))).collect()] == [0, 4]
    assert N.order_lines(carts(spark, "")).count() == 0


def test_slots(spark):
    df = carts(
        spark,
        "1x9 @5 Shop Pickup Time, 1x1 @4 Shop Pickup Time",
        "1x1 @4 Shop Pickup Time, 1x2 @4 Shop Pickup Time, 1x2 @4 Shop Pickup Time",
        "1xPickup Time, 1x1 @4 Zoo Pickup Time",
        "1x1 Egg",
    )
    got = {r.id: (r.time_descr, r.time) for r in U.first_pickup_slot(df).collect()}
    assert got == {
        1: ("1 @4 Shop Pickup Time", "@4"),
        2: ("1 @4 Shop Pickup Time", "@4"),  # a tie keeps the cart's order
        3: ("1 @4 Zoo Pickup Time", "@4"),  # a missing description sorts last
    }
    counts = {r.item: r.n_lines for r in U.pickup_histogram(df).collect()}
    assert counts == {
        "9 @5 Shop Pickup Time": 1, "1 @4 Shop Pickup Time": 2, "2 @4 Shop Pickup Time": 2,
        "Pickup Time": 1, "1 @4 Zoo Pickup Time": 1,
    }
    multi = sorted((r.name_long, r.item, r.n_pickups) for r in U.multi_pickup_members(df).collect())
    assert [(m[0], m[2]) for m in multi] == [("L1, F [1]", 2)] * 2 + [("L2, F [2]", 3)] * 2 + [("L3, F [3]", 2)] * 2
    ordered = [r.item for r in U.in_slot_order(U.pickup_histogram(df)).collect()]
    assert ordered[0] == "1 @4 Shop Pickup Time" and ordered[-1] == "Pickup Time"


def test_legacy_numbers(spark):
    rows = [
        ("S", "a", "b", "1 Half, 1x1 Egg,", 1), ("S", "a", "b", "1x1 @4 X Pickup Time", 5),
        ("S", "a", "b", "", 6), ("S", None, "b", None, 7),
    ]
    got = N.legacy_line_numbers(spark.createDataFrame(rows, MEMBERS)).collect()
    shown = sorted((r.id, r.rank_v, r.order_token, r.group_start, r.rows_in_group) for r in got if r.first_name)
    assert shown == [
        (1, 1, "1 Half", True, 3), (1, 2, " 1x1 Egg", False, 3), (5, 3, "1x1 @4 X Pickup Time", False, 3)
    ]
    lone = [r for r in got if r.first_name is None]
    assert [(r.order_token, r.pickuptime, r.rank_v, r.rows_in_group) for r in lone] == [(None, None, 1, 1)]
