"""Plans that must stay free of shuffles, cross joins and single-task steps."""

import pytest
from pyspark.sql import functions as F

from cartloom import queries as q
from cartloom.operators import deletes as D
from cartloom.operators import labels as L
from cartloom.operators import layout as P
from cartloom.operators import lines as N
from cartloom.operators import members as M
from cartloom.operators import pickup as U
from cartloom.operators import search as Q
from cartloom.operators import standards as S
from cartloom.plans import pinning, weekly
from cartloom.plans.pinning import pin_table
from cartloom.sources import export

SF = "/root/testdata/sf0.001"
BAD = ["CartesianProduct", "BroadcastNestedLoopJoin"]


@pytest.fixture(scope="module")
def orders(spark):
    """Orders as a table of their own, as a weekly job would read them."""
    return pin_table(q.A.member_orders(spark, SF))


@pytest.fixture(scope="module")
def setup(spark, orders):
    shares = q.A.shares(spark, SF)
    carts = M.member_carts(M.short_group_names(M.normalise_home_delivery(orders), shares))
    chosen = q.settings(spark, SF, carts)
    return carts, chosen, weekly.group_standards(carts, chosen)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    text = plan(df)
    assert not any(b in text for b in BAD)
    return text.count("Exchange hashpartitioning") + text.count("Exchange rangepartitioning")


def of_settings(spark):
    """Shuffles of the short-name lookup, which are of settings size."""
    return shuffles(q.A.shares(spark, SF).select("group_name", "group_name_short").distinct())


def test_member_decisions_do_not_shuffle_members(spark, setup):
    carts, chosen, group_std = setup
    # both of settings size: the short-name lookup and the grouping of the standard members
    allowed = of_settings(spark) + 1
    short = S.apply_standards(carts, chosen.std_members, group_std)
    for df in (
        N.order_lines(carts),
        N.member_rows(carts),
        U.first_pickup_slot(carts),
        U.multi_pickup_members(carts),
        short,
        Q.cart_search(carts, chosen.shares, ["ASIA"], ["red", "gear"]),
    ):
        assert shuffles(df) <= allowed


def test_deletes_shuffle_hits_not_cross_joins(spark, setup):
    carts, chosen, group_std = setup
    short = S.apply_standards(carts, chosen.std_members, group_std)
    # beside the settings: the distinct items, and the places per member
    assert shuffles(P.printable_rows(short, chosen.temporary_deletes)) <= 2 * of_settings(spark) + 6


def test_order_text_is_split_once(setup):
    carts, chosen, _ = setup
    for df in (
        N.order_lines(carts),
        U.first_pickup_slot(carts),
        U.multi_pickup_members(carts),
        Q.cart_search(carts, chosen.shares, ["ASIA"], ["red", "gear"]),
    ):
        assert plan(df).lower().count("substring_index(") == 1


def test_filters_and_columns_reach_the_scan(spark, orders):
    text = plan(M.normalise_home_delivery(orders).filter(F.col("id") == 5).select("id", "group_name"))
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,5)]" in text
    assert "ReadSchema: struct<group_name:string,id:bigint>" in text


@pytest.mark.parametrize("n", [3, 5000])
def test_rules_of_any_number_meet_items_by_an_equi_join(spark, n):
    rules = [("contains", f"Item{k}x", "A", None) for k in range(n)] + [("ends with", "ther", "B", None), ("contains", "..2", "C", None)]
    lines = spark.createDataFrame([("1 Item2x",), ("other",), (None,)], "item string")
    found = L.item_symbols(lines, L.label_rules(spark, rules))
    text = plan(found)
    assert not any(b in text for b in BAD)
    assert "HashJoin" in text or "SortMergeJoin" in text
    assert sorted((r.item, r.symbol_text) for r in found.collect()) == [("1 Item2x", "AC"), ("other", "B")]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_blank_cells_take_no_part_in_joins_on_items(spark, broadcast):
    """With a symbol table above the threshold, blank cells must not meet in one task."""
    cells = pin_table(spark.range(3000).selectExpr(
        "'g' AS group_name", "id AS page_n", "1 AS row_n", "1 AS column_n", "2 AS rank", "'1' AS quantity",
        "CAST(NULL AS int) AS standard_item", "if(id < 5, concat('i', id), NULL) AS item"))
    symbols = pin_table(spark.range(5).selectExpr("concat('i', id) AS item", "'*' AS symbol_text"))
    formats = pin_table(spark.range(5).selectExpr("concat('i', id) AS item", "'bold' AS format_name", "'red' AS color_name", "1 AS row_num"))
    shares = spark.createDataFrame([("g", None, "A", None)], "group_name string, group_name_short string, food_list_group_name string, highlight_color_hex string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        shown, styles = L.labelled(cells, symbols), L.cell_styles(cells, shares, formats)
        for df in (shown, styles):
            # the side that joins reads only cells with an item
            assert "PushedFilters: [IsNotNull(item)]" in plan(df) and "PushedFilters: [IsNull(item)]" in plan(df)
        assert shown.count() == 3000 and styles.count() == 5
        assert sorted(r.item_symbol for r in shown.filter("item IS NOT NULL").collect()) == [f"*1xi{k}" for k in range(5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rows_without_an_item_do_not_meet_in_one_task(spark):
    lines = spark.range(2000).select("id", F.when(F.col("id") < 5, F.lit("a")).alias("item"))
    listed = spark.createDataFrame([("a",)], "item string")
    kept = D.without_deleted_items(lines, listed, listed.limit(0))
    assert "__spread" in plan(kept) and kept.count() == 1995


def test_pinned_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    folder = tmp_path / "pins"
    monkeypatch.setattr(pinning, "pin_folder", lambda session: str(folder))
    assert pinning.pin_table(spark.range(3)).count() == 3 and folder.exists()
    pinning.drop_pinned(spark)
    assert not folder.exists()


def test_a_column_longer_than_its_page_is_an_error(spark):
    rows = [("g", 1, r, 1, "x") for r in (1, 2, 3)]
    cells = spark.createDataFrame(rows, "group_name string, page_n long, row_n int, column_n int, item string")
    pages = P.gathered_pages(cells, ["item"])
    for sheet in (P.page_grid, P.two_column_sheet, P.sheet_rows):
        with pytest.raises(Exception, match="longer than a page: group g, page 1"):
            sheet(pages, max_rows=2).collect()
        assert sheet(pages, max_rows=3).count() == 3 * (1 + (sheet is P.page_grid))


def test_pages_take_one_shuffle_after_the_join_with_their_places(spark, setup):
    carts, chosen, group_std = setup
    short = S.apply_standards(carts, chosen.std_members, group_std)
    members = weekly.printed_members(short, chosen)
    packed = weekly.packed_pages(members)
    placed = shuffles(P.page_cells(members, packed))
    pages = P.page_columns(members, packed)
    for df in (pages, P.page_grid(pages), P.two_column_sheet(pages)):
        assert shuffles(df) == placed + 1
    cells = pin_table(P.page_cells(members, packed))
    assert shuffles(P.two_column_sheet(P.gathered_pages(cells, ["item"]))) == 1


def test_rows_of_sheet_files_move_once(spark, setup, tmp_path, monkeypatch):
    """Members go to their pages in the order of the files; the sheet's lines are not dealt again to be written."""
    carts, chosen, group_std = setup
    members = weekly.printed_members(S.apply_standards(carts, chosen.std_members, group_std), chosen)
    packed = weekly.packed_pages(members)
    sheet = P.sheet_rows(P.page_columns(members, P.numbered_pages(packed), ["item"]))
    assert shuffles(sheet) == shuffles(P.page_cells(members, packed)) + 1 and plan(sheet).count("rangepartitioning") == 1
    plain = P.sheet_rows(P.page_columns(members, packed, ["item"]))
    assert sheet.columns == plain.columns
    assert sheet.exceptAll(plain).isEmpty() and plain.exceptAll(sheet).isEmpty()
    written = []
    keep = export.export_table
    monkeypatch.setattr(export, "export_table", lambda df, *more: written.append(df) or keep(df, *more))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = export.export_sheet(sheet, str(tmp_path / "s"), in_order=True).orderBy("first_row").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert plan(written[0]).count("rangepartitioning") == 1
    assert len(manifest) > 2 and manifest[0].first_row == 1 and manifest[-1].last_row == plain.count()
    assert all(a.last_row + 1 == b.first_row for a, b in zip(manifest, manifest[1:], strict=False))
    assert all(m.first_row % 46 == 1 and m.n_rows == m.last_row - m.first_row + 1 for m in manifest)
    for m in manifest:
        rows = spark.read.parquet(f"{tmp_path}/s/rows/{m.file}").coalesce(1).collect()
        assert [r.sheet_row for r in rows] == list(range(m.first_row, m.last_row + 1))


def test_short_delete_lists_move_no_member(spark, setup, monkeypatch):
    """They are tested in the member's row, and long ones in a join, with the same rows."""
    carts, chosen, group_std = setup
    short = S.apply_standards(carts, chosen.std_members, group_std)
    gone = D.all_deletes(chosen.permanent_deletes, chosen.temporary_deletes)
    in_row = P.printable_rows(short, gone)
    assert shuffles(in_row) == shuffles(short)
    monkeypatch.setattr(P, "LISTED", 0)
    joined = P.printable_rows(short, gone).select(in_row.columns)
    assert shuffles(joined) > shuffles(short)
    assert in_row.exceptAll(joined).isEmpty() and joined.exceptAll(in_row).isEmpty()


def test_cells_are_compiled(setup):
    """No function over arrays is interpreted on the way from members to cells and to pages."""
    carts, chosen, group_std = setup
    members = weekly.printed_members(S.apply_standards(carts, chosen.std_members, group_std), chosen)
    packed = weekly.packed_pages(members)
    assert "lambda" not in plan(P.page_cells(members, packed))
    # behind the shuffle the pieces of a page are told apart by their column, members' rows are not touched
    assert "transform(" not in plan(P.page_columns(members, packed))


def test_weekly_job_builds_its_orders_once(spark, monkeypatch):
    built, make = [], q.A.member_orders
    monkeypatch.setattr(q.A, "member_orders", lambda *at: built.append(at) or make(*at))
    monkeypatch.setattr(q.W, "weekly_sheet", lambda orders, *more: weekly.WeeklySheet(orders, *[None] * 4, {}))
    assert q.weekly_job(spark, SF).count() == 1500
    assert len(built) == 1


def test_styles_write_only_what_they_depend_on(spark, monkeypatch):
    written = []
    monkeypatch.setattr(q, "pin_table", lambda df, *more: written.append(df.columns) or pin_table(df, *more))
    q.cell_styles(spark, SF)
    assert ["group_name", "page_n", "row_n", "column_n", "rank", "item", "standard_item"] in written
    assert not any("row_n" in columns and "name_long" in columns for columns in written)


def test_steps_of_the_orders_carry_no_more_than_they_need(spark, setup):
    # tokens are made behind the shuffle, from the names
    text = plan(q.A.packed_items(spark, SF))
    assert text.index("Pot Plant") < text.index("Exchange hashpartitioning(l_orderkey")
    # the settings read two fields of a line, not its texts
    member = plan(q.region_standard_member(spark, SF, q.pinned_carts(spark, SF)))
    assert "cart:array<struct<rank:int,quantity:string>>" in member
    # rows that are deleted are not flagged before
    carts, chosen, group_std = setup
    gone = D.all_deletes(chosen.permanent_deletes, chosen.temporary_deletes)
    assert "transform(filter(concat(" in plan(P.printable_rows(S.apply_standards(carts, chosen.std_members, group_std), gone))
