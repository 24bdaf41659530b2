"""Deletes, search, labels, styles, and the whole weekly job."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cartloom.functions.fixed_values import FORMAT_RULES, LABEL_RULES
from cartloom.operators import cart_index as X
from cartloom.operators import deletes as D
from cartloom.operators import keywords as K
from cartloom.operators import labels as L
from cartloom.operators import layout as P
from cartloom.operators import lines as N
from cartloom.operators import members as M
from cartloom.operators import pickup as U
from cartloom.operators import rule_index
from cartloom.operators import search as Q
from cartloom.plans import weekly
from cartloom.sources.export import export_sheet, read_sheet

MEMBERS = "group_name string, firstname string, lastname string, `order` string, id long"
SHARES = "group_name string, group_name_short string, food_list_group_name string, highlight_color_hex string"
ONLY = "1 No Share - Order Only (even wk)"

ORDERS = [
    "1 Full, 1x1 Egg, 2x1 Oat, 1x2 @4 Shop Pickup Time",
    "1 Full, 1x1 Egg, 2x1 Pot Plant - Basil",
    f"1 None, {ONLY}",
    f"1 None, {ONLY}, 10x1 Egg",
    None,
]


def carts(spark, orders=ORDERS):
    rows = [("Shop", "F", f"L{i}", order, i) for i, order in enumerate(orders, 1)]
    return M.member_carts(spark.createDataFrame(rows, MEMBERS))


def items(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "item string")


def test_delete_pipeline(spark):
    df = carts(spark)
    assert [r.id for r in D.order_only_members(df).collect()] == [3]
    lines = N.member_rows(D.without_order_only(df))
    left = D.without_deleted_items(lines, items(spark, "1 Oat", None), items(spark, "1 Full"))
    assert sorted((r.id, r.item or "") for r in left.collect()) == sorted(
        [(1, "L1, F"), (1, "1 Egg"), (1, "2 @4 Shop Pickup Time"), (1, ""), (2, "L2, F"), (2, "1 Egg"), (2, ""),
         (4, "L4, F"), (4, "1 None"), (4, ONLY), (4, "1 Egg"), (4, ""), (5, "L5, F"), (5, ""), (5, "")]
    )
    report = D.delete_report(N.member_rows(df), items(spark, "1 Egg", None), items(spark, "1 Oat"))
    assert sorted((r.list_name, r.item, r.n_lines) for r in report.collect()) == [
        ("permanent", "1 Egg", 3), ("plants", "1 Pot Plant - Basil", 1), ("temporary", "1 Oat", 1)
    ]
    assert [tuple(r) for r in D.plant_extract(N.member_rows(df)).collect()] == [
        ("Shop", "L2", "F", "1 Pot Plant - Basil", "2")
    ]
    assert {r.item for r in Q.deletable_items(N.member_rows(df)).collect()} == {"1 Egg", "1 Oat", ONLY}


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_delete_lists_of_any_size_take_one_path(spark, broadcast):
    df = carts(spark)
    gone = items(spark, "1 Oat", "1 Full", "1 Full", None).unionByName(
        spark.range(20_000).select(F.concat(F.lit("other "), "id").alias("item"))
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        printed = P.printable_rows(df, gone)
        got = sorted((r.id, r.item or "") for r in P.member_lines(printed).collect())
        plan = printed._jdf.queryExecution().executedPlan().toString()
        sizes = {r.id: (r.n, r.has_header) for r in printed.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert got == sorted(
        [(1, "L1, F"), (1, "1 Egg"), (1, "2 @4 Shop Pickup Time"), (1, ""), (2, "L2, F"), (2, "1 Egg"), (2, ""),
         (4, "L4, F"), (4, "1 None"), (4, ONLY), (4, "1 Egg"), (4, ""), (5, "L5, F"), (5, ""), (5, "")]
    )
    assert sizes == {1: (4, True), 2: (3, True), 4: (5, True), 5: (3, True)}


def test_search_needs_every_term(spark):
    shares = spark.createDataFrame([("Shop", None, "A", None)], SHARES)
    df = carts(spark)

    def found(*terms):
        return {r.name_long for r in Q.cart_search(df, shares, ["A"], terms).collect()}

    assert found("EGG", "", "oat") == {"L1, F [1]"}
    assert found("egg", "l4") == {"L4, F [4]"}
    assert len(found("", "")) == 5 and found("egg", "nothing") == set()
    assert Q.cart_search(df, shares, ["H"], []).count() == 0
    assert Q.cart_search(df, shares, ["A"], ["oat"]).count() == 6
    assert Q.member_picklist(df, shares, ["A"]).count() == 5
    assert ("2x1 Oat", "1 Oat") in {tuple(r) for r in Q.item_picklist(df, shares, ["A"]).collect()}


def test_index_finds_what_the_search_finds(spark):
    shares = spark.createDataFrame([("Shop", None, "A", None)], SHARES)
    df = carts(spark, [*ORDERS, "", ",", "1 Full, 3x1 Egg, 3x1 Egg"])
    index = X.index_carts(df)
    for groups in (["A"], ["H"]):
        for terms in ([], [""], ["EGG"], ["egg", "", "oat"], ["egg", "l4"], ["egg", "nothing"], ["l.*f$"], ["egg", "f", "1 full", "x1"], ["egg"] * 70):
            rows = [sorted(map(tuple, found.collect()), key=str) for found in (
                Q.cart_search(df, shares, groups, terms), X.search_index(index, shares, groups, terms))]
            assert rows[0] == rows[1], terms
    # terms meet each distinct text once
    assert index.dictionary.count() == index.postings.select("text").distinct().count() < index.postings.count()
    assert {r.text for r in X.matching_texts(index, ["oat", "l1"]).collect()} == {"2x1 oat", "l1, f"}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_sheet_files_in_order(spark, tmp_path, fmt):
    sheet = spark.range(1, 4601).selectExpr(
        "id AS sheet_row", "1 + (id - 1) div 46 AS page_n", "concat('a, \"', id, '\"') AS item_1", "if(id % 3 = 0, NULL, 'x') AS item_2")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = export_sheet(sheet.repartition(3), str(tmp_path / "s"), fmt).orderBy("first_row").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(manifest) > 3 and manifest[0].first_row == 1 and manifest[-1].last_row == 4600
    assert all(a.last_row + 1 == b.first_row for a, b in zip(manifest, manifest[1:], strict=False))
    assert all(m.first_row % 46 == 1 and m.n_rows == m.last_row - m.first_row + 1 for m in manifest)
    # the files one after another, each from its top, are the sheet
    rows = []
    for m in manifest:
        one = f"{tmp_path}/s/rows/{m.file}"
        reader = spark.read.schema(sheet.schema)
        rows += (reader.option("header", True).option("escape", '"').csv(one) if fmt == "csv" else reader.parquet(one)).coalesce(1).collect()
    assert rows == sheet.orderBy("sheet_row").collect()
    some = read_sheet(spark, str(tmp_path / "s"), sheet.schema, 100, 146, fmt).orderBy("sheet_row").collect()
    assert [r.sheet_row for r in some] == list(range(100, 147))
    assert read_sheet(spark, str(tmp_path / "s"), sheet.schema, 5000, 6000, fmt).count() == 0


RULES = [
    ("contains", "Mi.k", "*", "C"),
    ("contains", "Milk", "*", "C"),
    ("equal", "1 Milk", None, "E"),
    ("starts with", "1 M", "A", None),
    ("ends with", "ilk", None, None),
    ("other", "1 Milk", "?", None),
]


@pytest.mark.parametrize("limit", [200, 2])
def test_symbols(spark, monkeypatch, limit):
    monkeypatch.setattr(rule_index, "RULES_PER_BATCH", limit)
    lines = items(spark, "1 Milk", "1 milk", None, "1 Milk")
    got = {r.item: r.symbol_text for r in L.item_symbols(lines, L.label_rules(spark, RULES)).collect()}
    assert got == {"1 Milk": "AC*C*E"}
    assert L.item_symbols(lines, L.label_rules(spark).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [200, 1])
def test_last_format_rule_wins(spark, monkeypatch, limit):
    monkeypatch.setattr(rule_index, "RULES_PER_BATCH", limit)
    rules = [("contains", "Milk", "bold", "#111111"), ("ends with", "Milk", "italic", None), ("equal", "1 Milk", None, None)]
    got = L.item_formats(items(spark, "1 Milk", "Milk 1", None), L.format_rules(spark, rules)).collect()
    assert sorted((r.item, r.format_name, r.color_name) for r in got) == [
        ("1 Milk", "italic", None), ("Milk 1", "bold", "#111111")
    ]


@pytest.mark.parametrize(
    "quantity, item, symbols, want",
    [
        ("1", "1 Egg", None, "1x1 Egg"),
        ("2", "1 Egg", "*", "+*2x1 Egg"),
        ("10", "1 Egg", None, "+10x1 Egg"),
        ("0.5", "1 Egg", None, "0.5x1 Egg"),
        ("1.5", "1 Egg", None, "+1.5x1 Egg"),
        (None, "1 Half", "*", "*1 Half"),
        (None, None, None, ""),
        ("mi", "ed", None, "+mixed"),
    ],
)
def test_item_label(spark, quantity, item, symbols, want):
    row = spark.createDataFrame([(quantity, item, symbols)], "q string, i string, s string")
    assert row.select(L.item_label(F.col("q"), F.col("i"), F.col("s"))).first()[0] == want


def test_default_rules():
    assert len(LABEL_RULES) == 22 and len(FORMAT_RULES) == 2


def test_calendar(spark):
    days = [dt.date(2022, 1, 5), dt.date(2022, 1, 5), dt.date(2022, 1, 12)]
    rotation = spark.createDataFrame([(d, d.isocalendar()[1], "A") for d in days], "date date, week int, season string")
    calendar = U.pickup_calendar(rotation)
    assert calendar.count() == 6
    assert [r.all_dates.day for r in U.calendar_gaps(rotation).orderBy("all_dates").collect()] == [8, 9, 10, 11]
    assert U.run_of(calendar, dt.date(2022, 1, 7)) == {"season": "A", "week": "01", "date": dt.date(2022, 1, 7)}
    with pytest.raises(ValueError, match="not a pickup day"):
        U.run_of(calendar, dt.date(2022, 1, 8))


def test_keyword_lookup(spark):
    names = spark.createDataFrame([("cow2", "C"), ("dog", "D"), ("x", "X")], "name string, emoji string")
    words = spark.createDataFrame([("moo", "cow2,dog"), ("beef_cow", "cow2"), ("pet", "dog")], "keyword string, name_list string")
    got = [tuple(r) for r in K.keyword_lookup(names, words).collect()]
    assert got == [("cow2", "C", "beef_cow,moo")]


def weekly_settings(spark):
    return weekly.Settings(
        shares=spark.createDataFrame([("Shop", "S", "A", "#AA0000"), ("Mill", None, "H", None)], SHARES),
        permanent_deletes=items(spark, "1 Each Credit", None),
        temporary_deletes=items(spark),
        std_members=spark.createDataFrame(
            [("A", None, None), ("H", None, None)], "food_list_group_name string, name_long string, keep_remove boolean"
        ),
        std_items=spark.createDataFrame([("A", "1x1 Egg")], "food_list_group_name string, item_original string"),
        label_rules=L.label_rules(spark),
        format_rules=L.format_rules(spark),
    )


def test_weekly_sheet(spark):
    rows = [
        ("Shop", "Ann", "Bell", "1 Full, 1x1 Egg, 1x2 @4 X Pickup Time", 1),
        ("Shop", "Bob", "Cole", "1 Full, 2x1 Gallon Milk - Whole, 1x1 Each Credit", 2),
        ("Shop", "Cy", "Doe", f"1 None, {ONLY}", 3),
        ("Mill", "Di", "Eck", "1 Half, 2x1 Pot Plant - Mint", 4),
    ]
    df = spark.createDataFrame(rows, MEMBERS)
    run = {"season": "A", "week": "01", "date": dt.date(2022, 1, 5)}
    out = weekly.weekly_sheet(df, weekly_settings(spark), run, max_rows=8)
    sheet = out.sheet.orderBy("sheet_row").collect()
    assert [r.sheet_row for r in sheet] == list(range(1, 17))
    assert [(r.item_1, r.item_2) for r in sheet[:5]] == [
        ("Mill (Aw01 - 2022-01-05)", None),
        ("Eck, Di", None),
        ("1 Half", None),
        ("", None),
        (None, None),
    ]
    assert [r.item_1 for r in sheet[8:14]] == [
        "S (Aw01 - 2022-01-05)", "Bell, Ann", "1 Full", "1x2 @4 X Pickup Time",
        "STANDARD SHARE ITEMS", "",
    ]
    assert [r.item_2 for r in sheet[8:13]] == [
        "S (Aw01 - 2022-01-05)", "Cole, Bob", "1 Full", "+\U0001F404*2x1 Gallon Milk - Whole", ""
    ]
    styles = {(r.group_name, r.column_n, r.row_n): r for r in out.styles.collect()}
    assert styles[("S", 1, 1)].fill_if_text == "#AA0000" and styles[("S", 1, 1)].halign == "center"
    assert styles[("S", 1, 5)].text_decoration == "bold" and styles[("S", 1, 4)].text_decoration == "italic"
    assert not any(g == "Mill" for g, _, _ in styles)
    assert sorted(tuple(r) for r in out.reconciliation.collect()) == [("Mill", 1, 1, 0), ("S", 3, 2, -1)]
    assert [tuple(r) for r in out.plants.collect()] == [("Mill", "Eck", "Di", "1 Pot Plant - Mint", "2")]
    assert out.counts == {"n_start": 4, "n_unknown": 0, "n_end": 3, "n_cells": 15, "n_overflow": 0}
    with pytest.raises(ValueError, match="longer than a page"):
        weekly.weekly_sheet(df, weekly_settings(spark), run, max_rows=3)
    with pytest.raises(ValueError, match="groups missing from the settings: .'Elsewhere'"):
        weekly.weekly_sheet(df.withColumn("group_name", F.lit("Elsewhere")), weekly_settings(spark), run)


def test_reports_and_options_of_the_job(spark):
    rows = [
        ("Shop", "Ann", "Bell", "1 Full, 1x1 Egg, 1x2 @4 X Pickup Time, 1x3 @5 Y Pickup Time", 1),
        ("Shop", "Bob", "Cole", "1 Full, 1x1 Egg, 1x1 Each Credit", 2),
        ("Mill", "Cy", "Doe", f"1 None, {ONLY}", 3),
        ("Shop", "Di", "Eck", "1 Half, 2x1 Pot Plant - Mint", 4),
    ]
    df = spark.createDataFrame(rows, MEMBERS)
    rotation = spark.createDataFrame([(dt.date(2022, 1, 5), 1, "A")], "date date, week int, season string")
    settings = replace(weekly_settings(spark), rotation=rotation)
    out = weekly.weekly_sheet(df, settings, dt.date(2022, 1, 7), options=weekly.Options(max_rows=8, extras="containment", label="BOX"))
    text = [t for r in out.sheet.orderBy("sheet_row").collect() for t in (r.item_1, r.item_2)]
    assert text[0] == "S (Aw01 - 2022-01-07)" and text.count("BOX") == 2
    said = out.reports
    assert {(r.name_long, r.extra_items) for r in said.standard_summary.collect()} == {("Bell, Ann [1]", False), ("Cole, Bob [2]", True)}
    assert {r.name_long for r in said.multi_pickup.collect()} == {"Bell, Ann [1]"} and said.pickup_histogram.count() == 2
    assert [r.id for r in said.order_only.collect()] == [3]
    assert [r.group_name for r in said.groups_without_pages.collect()] == ["Mill"]
    assert {(r.list_name, r.item) for r in said.delete_report.collect()} == {("permanent", "1 Each Credit"), ("plants", "1 Pot Plant - Mint")}
    assert said.home_delivery.count() == 0 and said.standards_coverage.first().n_groups == 1
    with pytest.raises(ValueError, match="not a pickup day"):
        weekly.weekly_sheet(df, settings, dt.date(2022, 1, 9))
    with pytest.raises(ValueError, match="needs the rotation"):
        weekly.weekly_sheet(df, weekly_settings(spark), dt.date(2022, 1, 7))
    doubled = replace(settings, shares=settings.shares.unionByName(settings.shares))
    with pytest.raises(ValueError, match="duplicate keys"):
        weekly.weekly_sheet(df, doubled, dt.date(2022, 1, 7))
    none = weekly.weekly_sheet(df.limit(0), settings, dt.date(2022, 1, 7))
    assert none.sheet.count() == 0 and none.counts["n_start"] == 0


def test_several_runs_in_one_job(spark):
    rows = [("Shop", "Ann", "Bell", "1 Full, 1x1 Egg", 1), ("Mill", "Di", "Eck", "1 Half, 2x1 Pot Plant - Mint", 2)]
    week1 = spark.createDataFrame(rows, MEMBERS).withColumn("week", F.lit(1))
    week2 = spark.createDataFrame([(*r[:4], r[4] + 10) for r in rows], MEMBERS).withColumn("week", F.lit(2))
    run = {"season": "A", "week": F.col("week"), "date": "2022"}
    out = weekly.weekly_sheet(week1.unionByName(week2), weekly_settings(spark), run, 6, ["week"])
    sheet = out.sheet.orderBy("week", "sheet_row").collect()
    assert [(r.week, r.sheet_row) for r in sheet] == [(w, n) for w in (1, 2) for n in range(1, 13)]
    assert [r.item_1 for r in sheet if r.sheet_row in (1, 7)] == [
        "Mill (Aw1 - 2022)", "S (Aw1 - 2022)", "Mill (Aw2 - 2022)", "S (Aw2 - 2022)"
    ]
    assert {r.week for r in out.styles.collect()} == {1, 2}
    assert out.reconciliation.count() == 4 and out.plants.select("week").distinct().count() == 2


def test_groups_left_without_members(spark):
    carts_two = carts(spark, ["1 Half"]).unionByName(
        carts(spark, [ONLY]).withColumns({"group_name": F.lit("Empty"), "id": F.lit(9).cast("long")})
    )
    members = P.printable_rows(carts_two, items(spark))
    packed = P.pack_pages(P.rows_per_member(members))
    assert [r.group_name for r in P.groups_without_pages(carts_two, packed).collect()] == ["Empty"]


def test_deleted_group_name_prints_no_header(spark):
    df = P.printable_rows(carts(spark, ["1 Half"]), items(spark, "Shop"))
    packed = P.pack_pages(P.rows_per_member(df))
    rows = P.page_cells(df, packed).orderBy("row_n").collect()
    assert [(r.row_n, r.item) for r in rows] == [(1, "L1, F"), (2, "1 Half"), (3, None)]
    assert P.page_grid(P.page_columns(df, packed)).count() == 92
