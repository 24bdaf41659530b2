"""Registered queries: every operator on the star-schema tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.functions.fixed_values import LABEL_RULES, ORDER_HEADER
from cartloom.operators import cart_index as X
from cartloom.operators import deletes as D
from cartloom.operators import keywords as K
from cartloom.operators import labels as L
from cartloom.operators import layout as P
from cartloom.operators import lines as N
from cartloom.operators import members as M
from cartloom.operators import pickup as U
from cartloom.operators import search as Q
from cartloom.operators import settings_edit as E
from cartloom.operators import standards as S
from cartloom.plans import weekly as W
from cartloom.plans.ordering import running_offsets
from cartloom.plans.pinning import PACKED, pin_folder, pin_table
from cartloom.sources import star as A
from cartloom.sources.export import export_sheet, export_table
from cartloom.sources.orders import load_members, load_orders
from cartloom.sources.settings import SettingsTable

SEARCH_GROUPS = ["ASIA", "EUROPE"]
SEARCH_TERMS = ["RED", "", "each .*ring$"]
STANDARD_MEMBER_REGION = "AFRICA"
SMALL_PAGE = 12

LABEL_EXAMPLES = [
    *LABEL_RULES,
    ("contains", "(red|blue) r", "*", "\U0001F534"),
    ("contains", "Pot Plant", "***", "\U0001F331"),
    ("starts with", "1 Each hot", "^", None),
    ("ends with", "bolt", None, "\U0001F529"),
    ("equal", "1 Each small gear", "=", None),
    ("ends with", " bolt", None, "\U0001F529"),
]
FORMAT_EXAMPLES = [
    ("equal", "STANDARD SHARE ITEMS", "bold", None),
    ("contains", "Pickup Time", "italic", None),
    ("contains", "re", None, "#FFEE00"),
    ("ends with", "gear", "bold", "#00FF00"),
    ("starts with", "1 Each red", "italic", None),
    ("equal", "1 Each red gear", None, None),
]


# ------------------------------------------------------------------ shared inputs


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return W.clean_members(A.member_orders(spark, sf), A.shares(spark, sf))


def carts(spark: SparkSession, sf: str) -> DataFrame:
    return M.member_carts(clean(spark, sf))


def permanent_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """Red items plus a missing entry."""
    names = A.table(spark, sf, "part").select("p_name").distinct()
    item = F.when(
        F.col("p_name").startswith("red ") & ~F.col("p_name").endswith(" plate"),
        F.concat(F.lit("1 Each "), "p_name"),
    )
    return names.select(item.alias("item")).distinct()


def temporary_deletes(spark: SparkSession, sf: str) -> DataFrame:
    names = A.table(spark, sf, "part").select("p_name").distinct()
    return names.filter(F.col("p_name").endswith(" gizmo")).select(
        F.concat(F.lit("1 Each "), "p_name").alias("item")
    )


def region_standard_items(spark: SparkSession, sf: str, cart_rows: DataFrame) -> DataFrame:
    """The most ordered tokens of a region: one, or two where the region key is odd."""
    regions = A.table(spark, sf, "region")
    shares = M.shares_by_short_name(A.shares(spark, sf)).select("group_name", "food_list_group_name")
    per_group = (
        N.exploded(cart_rows.select("group_name", "cart"))
        .filter((F.col("rank") == 3) & F.col("quantity").isNotNull())
        .groupBy("group_name", "item_original")
        .agg(F.count("*").alias("n"))
    )
    counts = (
        per_group.join(shares, "group_name")
        .filter(F.col("food_list_group_name") != STANDARD_MEMBER_REGION)
        .groupBy("food_list_group_name", "item_original")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("food_list_group_name").orderBy(F.col("n").desc(), "item_original")
    top = counts.withColumn("place", F.row_number().over(best)).filter("place <= 2")
    return (
        top.join(regions, F.col("food_list_group_name") == F.col("r_name"))
        .filter(F.col("place") <= 1 + F.col("r_regionkey") % 2)
        .select("food_list_group_name", "item_original")
    )


def region_standard_member(spark: SparkSession, sf: str, cart_rows: DataFrame) -> DataFrame:
    """One region is set by a member instead: its first member with exactly one item line."""
    shares = M.shares_by_short_name(A.shares(spark, sf)).select("group_name", "food_list_group_name")
    # only ranks and quantities are read
    ranks, quantities = F.col("cart")["rank"], F.col("cart")["quantity"]
    one_line = F.size(F.filter(ranks, lambda rank: rank == 3)) == 1
    with_item = F.get(quantities, F.array_position(ranks, 3).cast("int") - 1).isNotNull()
    return (
        cart_rows.filter(one_line & with_item)
        .join(shares, "group_name")
        .groupBy("food_list_group_name")
        .agg(F.min_by("name_long", "id").alias("name_long"))
        .select(
            "food_list_group_name",
            F.when(F.col("food_list_group_name") == STANDARD_MEMBER_REGION, F.col("name_long")).alias("name_long"),
            F.when(F.col("food_list_group_name") == STANDARD_MEMBER_REGION, F.lit(False)).alias("keep_remove"),
        )
    )


def settings(spark: SparkSession, sf: str, cart_rows: DataFrame) -> W.Settings:
    return W.Settings(
        shares=A.shares(spark, sf),
        permanent_deletes=permanent_deletes(spark, sf),
        temporary_deletes=temporary_deletes(spark, sf),
        std_members=pin_table(region_standard_member(spark, sf, cart_rows)),
        std_items=region_standard_items(spark, sf, cart_rows),
        label_rules=L.label_rules(spark, LABEL_EXAMPLES),
        format_rules=L.format_rules(spark, FORMAT_EXAMPLES),
    )


def pinned_carts(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed carts as a table, for queries that pass over them more than once."""
    return pin_table(carts(spark, sf), PACKED)


def standards(spark: SparkSession, sf: str):
    rows = pinned_carts(spark, sf)
    chosen = settings(spark, sf, rows)
    return rows, chosen, W.group_standards(rows, chosen)


def collapsed(spark: SparkSession, sf: str) -> tuple[DataFrame, W.Settings, DataFrame]:
    """Collapsed carts, the settings, and the standard lines behind them."""
    rows, chosen, group_std = standards(spark, sf)
    short = S.apply_standards(rows, chosen.std_members, group_std)
    columns = ["group_name", "firstname", "lastname", "id", "name_long", "time_descr", "description", "time"]
    return short.select(*columns, "cart", "order_only"), chosen, rows


def final(spark: SparkSession, sf: str) -> DataFrame:
    rows = pinned_carts(spark, sf)
    return W.final_members(rows, settings(spark, sf, rows))


def packed(spark: SparkSession, sf: str, max_rows: int = 46) -> tuple[DataFrame, DataFrame]:
    members = final(spark, sf)
    return members, W.packed_pages(members, max_rows)


def cells(spark: SparkSession, sf: str, max_rows: int = 46) -> DataFrame:
    members, pages = packed(spark, sf, max_rows)
    return P.page_cells(members, pages)


def _cell_view(df: DataFrame, *more: str) -> DataFrame:
    return df.select("group_name", "page_n", "row_n", "column_n", *more)


# ------------------------------------------------------------------------ queries


def picks_per_slot(spark, sf):
    """How often each item must be picked per group and pickup slot."""
    lines = N.exploded(carts(spark, sf).select("group_name", "description", "time", "cart"))
    return (
        lines.filter(F.col("rank") == 3)
        .groupBy("group_name", "description", "time", "item")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum(F.col("quantity").try_cast("decimal(10,2)")).cast("double").alias("total_qty"),
        )
    )


def order_lines(spark, sf):
    lines = N.order_lines(carts(spark, sf))
    return lines.select(
        "id", "group_name", "name_long", "seq", "quantity", "item", "item_original", "rank"
    )


def legacy_line_numbers(spark, sf):
    return N.legacy_line_numbers(pin_table(A.member_orders(spark, sf)))


def line_class_counts(spark, sf):
    return N.line_class_counts(carts(spark, sf))


def short_group_names(spark, sf):
    return clean(spark, sf).select("id", "group_name")


def home_delivery_normalised(spark, sf):
    return M.normalise_home_delivery(A.member_orders(spark, sf)).select(
        "id", "group_name", "firstname", "lastname"
    )


def home_delivery_check(spark, sf):
    return M.home_delivery_check(A.member_orders(spark, sf))


def group_check(spark, sf):
    known = A.table(spark, sf, "nation").select(F.col("n_name").alias("group_name"))
    return M.group_check(M.normalise_home_delivery(A.member_orders(spark, sf)), known)


def members_start(spark, sf):
    return M.member_counts(clean(spark, sf), "n_start")


def members_end(spark, sf):
    return M.member_counts(final(spark, sf), "n_end")


def reconciliation(spark, sf):
    rows = pinned_carts(spark, sf)
    end = W.final_members(rows, settings(spark, sf, rows))
    return M.reconciliation(M.member_counts(rows, "n_start"), M.member_counts(end, "n_end"))


def pickup_calendar(spark, sf):
    calendar = U.pickup_calendar(A.rotation(spark, sf))
    return calendar.withColumns({c: F.col(c).cast("string") for c in ("date", "date_all")})


def calendar_gaps(spark, sf):
    return U.calendar_gaps(A.rotation(spark, sf)).select(F.col("all_dates").cast("string").alias("all_dates"))


def pickup_histogram(spark, sf):
    return U.pickup_histogram(carts(spark, sf))


def first_pickup_slot(spark, sf):
    return U.first_pickup_slot(carts(spark, sf))


def multi_pickup_members(spark, sf):
    return U.multi_pickup_members(carts(spark, sf))


def synthetic_rows(spark, sf):
    return (
        N.long_lines(carts(spark, sf))
        .filter(F.col("rank").isin(-1, 0, 4))
        .select("group_name", "firstname", "lastname", "id", "name_long", "description", "rank", "item")
    )


def _flags(rows, chosen):
    return S.standard_items(S.standard_lines(rows, chosen.std_members, chosen.std_items), chosen.shares)


def standard_items(spark, sf):
    rows = pinned_carts(spark, sf)
    return _flags(rows, settings(spark, sf, rows))


def standard_full_match(spark, sf):
    rows, chosen, group_std = standards(spark, sf)
    return S.standard_full_match(rows, chosen.std_members, group_std)


def standard_with_extras(spark, sf):
    rows, _, group_std = standards(spark, sf)
    return S.standard_with_extras(rows, group_std)


def standard_containment(spark, sf):
    rows, _, group_std = standards(spark, sf)
    return S.standard_with_extras(rows, group_std, extras="containment")


def standard_collapsed(spark, sf):
    short, chosen, rows = collapsed(spark, sf)
    flags = pin_table(_flags(rows, chosen))
    lines = S.flag_standard_items(N.long_lines(short.drop("order_only")), flags)
    return lines.select("group_name", "id", "name_long", "rank", "quantity", "item", "standard_item")


def standard_summary(spark, sf):
    rows, chosen, group_std = standards(spark, sf)
    return S.standard_summary(rows, chosen.std_members, group_std)


def _named_members(spark, sf):
    rows = pinned_carts(spark, sf)
    everywhere = region_standard_member(spark, sf, rows)
    items = region_standard_items(spark, sf, rows)
    return everywhere, items


def standards_conflict(spark, sf):
    """Every region also gets a member, so regions with items conflict."""
    members, items = _named_members(spark, sf)
    named = members.withColumn("name_long", F.coalesce("name_long", F.lit("0, 0 [0]")))
    return S.standards_conflict(named, items)


def standards_coverage(spark, sf):
    members, items = _named_members(spark, sf)
    return S.standards_coverage(members, items)


def cart_search(spark, sf):
    return Q.cart_search(carts(spark, sf), A.shares(spark, sf), SEARCH_GROUPS, SEARCH_TERMS)


def cart_search_indexed(spark, sf):
    """The same search over an index of distinct texts."""
    return X.search_index(X.index_carts(carts(spark, sf)), A.shares(spark, sf), SEARCH_GROUPS, SEARCH_TERMS)


def member_picklist(spark, sf):
    return Q.member_picklist(carts(spark, sf), A.shares(spark, sf), SEARCH_GROUPS)


def item_picklist(spark, sf):
    return Q.item_picklist(carts(spark, sf), A.shares(spark, sf), SEARCH_GROUPS)


def _collapsed_lines(spark, sf):
    short, chosen, _ = collapsed(spark, sf)
    return N.long_lines(short.drop("order_only")), chosen


def deletable_items(spark, sf):
    return Q.deletable_items(_collapsed_lines(spark, sf)[0])


def delete_report(spark, sf):
    lines, chosen = _collapsed_lines(spark, sf)
    return D.delete_report(lines, chosen.permanent_deletes, chosen.temporary_deletes)


def order_only_members(spark, sf):
    return collapsed(spark, sf)[0].filter("order_only").select("id")


def lines_after_delete(spark, sf):
    short, chosen, _ = collapsed(spark, sf)
    kept = N.member_rows(short.filter("not order_only").drop("order_only"))
    lines = kept.unionByName(N.group_rows(short))
    return D.without_deleted_items(lines, chosen.permanent_deletes, chosen.temporary_deletes).select(
        "group_name", "id", "name_long", "rank", "quantity", "item"
    )


def plant_extract(spark, sf):
    return D.plant_extract(_collapsed_lines(spark, sf)[0])


def rows_per_member(spark, sf):
    return P.rows_per_member(final(spark, sf)).drop("has_header")


def page_packing(spark, sf):
    return packed(spark, sf)[1].drop("has_header")


def _pages(spark, sf, *fields):
    return P.page_columns(*packed(spark, sf), fields=fields)


def page_grid(spark, sf):
    shown = ("id", "n", "rank", "quantity", "item", "standard_item")
    return _cell_view(P.page_grid(_pages(spark, sf, *shown)), *shown)


def two_column_sheet(spark, sf):
    return P.two_column_sheet(_pages(spark, sf, "item"))


def sheet_rows(spark, sf):
    return P.sheet_rows(_pages(spark, sf, "item"))


def sheet_files(spark, sf):
    """The sheet written as ordered files, and every row read back with the place its file has in the manifest."""
    folder = _shared_folder(spark, "sheet")
    members, places = packed(spark, sf)
    # places are numbered, so that members move to their pages in the order of the files
    pages = P.page_columns(members, P.numbered_pages(places), fields=["item"])
    sheet = P.sheet_rows(pages)
    manifest = export_sheet(sheet, folder, in_order=True)
    back = spark.read.schema(sheet.schema).parquet(f"{folder}/rows")
    named = back.select("sheet_row", "group_name", "page_n", "item_1", "item_2", F.col("_metadata.file_name").alias("file"))
    inside = F.col("sheet_row").between(F.col("first_row"), F.col("last_row"))
    # files of whole pages, one after another
    whole = (F.col("first_row") % 46 == 1) & (F.col("last_row") % 46 == 0) & (F.col("n_rows") == F.col("last_row") - F.col("first_row") + 1)
    return named.join(manifest, "file").select("sheet_row", "group_name", "page_n", "item_1", "item_2", (inside & whole).alias("in_place"))


def page_subset(spark, sf):
    return P.page_subset(P.two_column_sheet(_pages(spark, sf, "item")), "N1", 1)


def page_overflow(spark, sf):
    """Short pages, so that single members are too long for a column."""
    found = P.page_overflow(cells(spark, sf, SMALL_PAGE), SMALL_PAGE)
    return _cell_view(found, "id", "n", "rank", "item")


def item_symbols(spark, sf):
    lines = N.member_rows(carts(spark, sf))
    return L.item_symbols(lines, L.label_rules(spark, LABEL_EXAMPLES))


def item_labels(spark, sf):
    lines = N.long_lines(pinned_carts(spark, sf))
    symbols = W.symbol_table(lines, L.label_rules(spark, LABEL_EXAMPLES))
    return L.labelled(lines, symbols).select("id", "group_name", "rank", "seq", "item_symbol")


def _run(spark, sf):
    calendar = U.pickup_calendar(A.rotation(spark, sf))
    last_day = calendar.agg(F.max("date_all")).first()[0]
    return U.run_of(calendar, last_day)


def header_labels(spark, sf):
    shown = pin_table(cells(spark, sf))
    symbols = W.symbol_table(shown, L.label_rules(spark, LABEL_EXAMPLES))
    with_label = L.with_run_suffix(L.labelled(shown, symbols), _run(spark, sf))
    return _cell_view(with_label, "label")


def cell_group_colour(spark, sf):
    return L.cell_group_colour(cells(spark, sf), A.shares(spark, sf))


def cell_standard_bold(spark, sf):
    return L.cell_standard_bold(cells(spark, sf))


def cell_format_rules(spark, sf):
    shown = pin_table(cells(spark, sf))
    return L.cell_format_rules(shown, W.format_table(shown, L.format_rules(spark, FORMAT_EXAMPLES)))


def cell_styles(spark, sf):
    # styles depend on the place, rank, item and flag of a cell; names and quantities are not written again
    styled = _cell_view(cells(spark, sf), "rank", "item", "standard_item")
    shown = pin_table(styled, PACKED)
    formats = W.format_table(shown, L.format_rules(spark, FORMAT_EXAMPLES))
    return L.cell_styles(shown, A.shares(spark, sf), formats)


def weekly_job(spark, sf):
    """The labelled sheet of the whole job, with all its checks."""
    # the settings and the job read the same orders, so these are put together once
    orders = pin_table(A.member_orders(spark, sf))
    rows = pin_table(W.cleaned_carts(orders, A.shares(spark, sf)))
    last_day = U.pickup_calendar(A.rotation(spark, sf)).agg(F.max("date_all")).first()[0]
    chosen = replace(settings(spark, sf, rows), rotation=A.rotation(spark, sf))
    return W.weekly_sheet(orders, chosen, last_day).sheet


def settings_append(spark, sf):
    return E.append_distinct(permanent_deletes(spark, sf), temporary_deletes(spark, sf))


def settings_remove(spark, sf):
    return E.remove_item(permanent_deletes(spark, sf), "1 Each red bolt")


def _shared_folder(spark, name):
    return f"{pin_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _orders_by_file(spark, sf):
    """The orders exported as CSV files and loaded back."""
    orders = A.member_orders(spark, sf).select("group_name", "firstname", "lastname", "order")
    folder = _shared_folder(spark, "orders")
    export_table(orders.toDF(*ORDER_HEADER), folder, "csv")
    return load_members(spark, folder)


def orders_file_rows(spark, sf):
    return _orders_by_file(spark, sf).select(
        "group_name", "firstname", "lastname", F.col("order").alias("order_text")
    )


def orders_file_ids(spark, sf):
    return _orders_by_file(spark, sf).select("id")


def orders_file_quarantine(spark, sf):
    """Files with ragged rows: the members that are kept, and the rows set aside."""
    folder = _shared_folder(spark, "ragged")
    # one column whose name is the header and whose values are whole lines
    lines = A.order_records(spark, sf).toDF(",".join(ORDER_HEADER))
    writer = lines.write.option("header", True).option("sep", "\x01").option("escapeQuotes", False)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    files = load_orders(spark, folder)
    kept = files.members.select(
        F.lit(True).alias("kept"), "group_name", "firstname", "lastname", F.col("order").alias("order_text")
    )
    aside = files.quarantined.select(F.lit(False).alias("kept"), F.col("record").alias("order_text"))
    return kept.unionByName(aside, allowMissingColumns=True)


def settings_replaced(spark, sf):
    """A written delete list, replaced by rows read from it, and read again."""
    first = permanent_deletes(spark, sf)
    table = SettingsTable(spark, _shared_folder(spark, "deletes"), first.schema)
    table.replace(first, base=0)
    table.update(lambda stored: E.append_distinct(stored, temporary_deletes(spark, sf)))
    return table.read()


def standards_upsert(spark, sf):
    std = pin_table(region_standard_member(spark, sf, carts(spark, sf)))
    added = E.upsert_standard_member(std, "ASIA", "Someone, New [1]", True)
    return E.clear_standard_member(added, STANDARD_MEMBER_REGION)


def _part_rules(spark, sf):
    """One rule per part name, numbered in name order."""
    names = A.table(spark, sf, "part").select("p_name").distinct()
    rules = names.select(
        F.lit("ends with").alias("match_name"),
        F.col("p_name").alias("text_name"),
        F.lit("*").alias("freeform_text"),
        F.lit(None).cast("string").alias("emoji_name"),
        F.ascii(F.substring("p_name", 1, 1)).alias("first_letter"),
    )
    counted = rules.withColumns({"__all": F.lit(1), "__one": F.lit(1)})
    placed = running_offsets(counted, ["__all"], [F.col("text_name").asc()], "__one")
    return placed.select(
        "match_name", "text_name", "freeform_text", "emoji_name", (F.col("before") + 1).cast("int").alias("row_num")
    )


def rules_edit(spark, sf):
    rules = _part_rules(spark, sf)
    new = spark.createDataFrame(
        [("equal", "1 Each red bolt", "!", None)],
        "match_name string, text_name string, freeform_text string, emoji_name string",
    )
    return E.remove_rule(E.add_rule(rules, new), 3)


def keyword_lookup(spark, sf):
    parts = A.table(spark, sf, "part")
    names = parts.select(F.col("p_name").alias("name"), F.upper("p_name").alias("emoji")).distinct()
    words = (
        parts.select("p_brand", "p_name")
        .distinct()
        .groupBy(F.col("p_brand").alias("keyword"))
        .agg(F.array_join(F.sort_array(F.collect_list("p_name")), ",").alias("name_list"))
    )
    return K.keyword_lookup(names, words, ["Brand#7", "Brand#11"])


def rgb_parse(spark, sf):
    return K.rgb_parse(A.shares(spark, sf)).select("group_name", "red", "green", "blue")


def preview_top(spark, sf):
    return N.preview(N.long_lines(carts(spark, sf))).select(
        "group_name", "description", "time", "lastname", "firstname", "id", "rank", "seq", "item"
    )


QUERIES = {
    f.__name__: f
    for f in (
        picks_per_slot, order_lines, legacy_line_numbers, line_class_counts, short_group_names,
        home_delivery_normalised, home_delivery_check, group_check, members_start, members_end,
        reconciliation, pickup_calendar, calendar_gaps, pickup_histogram, first_pickup_slot,
        multi_pickup_members, synthetic_rows, standard_items, standard_full_match,
        standard_with_extras, standard_containment, standard_collapsed, standard_summary,
        standards_conflict, standards_coverage, cart_search, cart_search_indexed, member_picklist, item_picklist,
        deletable_items, delete_report, order_only_members, lines_after_delete, plant_extract,
        rows_per_member, page_packing, page_grid, two_column_sheet, sheet_rows, sheet_files, page_subset,
        page_overflow, item_symbols, item_labels, header_labels, cell_group_colour,
        cell_standard_bold, cell_format_rules, cell_styles, weekly_job, settings_append, settings_remove,
        orders_file_rows, orders_file_ids, orders_file_quarantine, settings_replaced, standards_upsert, rules_edit, keyword_lookup, rgb_parse, preview_top,
    )
}
