"""The whole weekly job: member orders and settings to sheet, styles and checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions.fixed_values import PAGE_ROWS, STANDARD_LABEL
from cartloom.operators import deletes as D
from cartloom.operators import labels as L
from cartloom.operators import layout as P
from cartloom.operators import members as M
from cartloom.operators import pickup as U
from cartloom.operators import standards as S
from cartloom.operators.lines import each_line
from cartloom.plans.pinning import PACKED, pin_observed, pin_table
from cartloom.sources.settings import require_unique


@dataclass
class Settings:
    shares: DataFrame
    permanent_deletes: DataFrame
    temporary_deletes: DataFrame
    std_members: DataFrame
    std_items: DataFrame
    label_rules: DataFrame
    format_rules: DataFrame
    #: Pickup dates with week and season; needed where the run is given as a date.
    rotation: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    """Choices of the job that the orders and settings leave open."""

    max_rows: int = PAGE_ROWS
    #: ``last_line`` or ``containment``: when a cart counts as a standard share with extras.
    extras: str = "last_line"
    label: str = STANDARD_LABEL
    drop_removed: bool = False
    quantity_only_numeric: bool = False


def clean_members(orders: DataFrame, shares: DataFrame) -> DataFrame:
    """Normalised members under their short group names."""
    return M.short_group_names(M.normalise_home_delivery(orders), shares)


def cleaned_carts(orders: DataFrame, shares: DataFrame) -> DataFrame:
    return M.member_carts(clean_members(orders, shares))


def group_standards(carts: DataFrame, settings: Settings) -> DataFrame:
    """Per-group standards, pinned: they are settings from here on."""
    std_lines = S.standard_lines(carts, settings.std_members, settings.std_items)
    return pin_table(S.group_standards(std_lines, settings.shares))


def final_members(
    carts: DataFrame,
    settings: Settings,
    extras: str = "last_line",
    label: str = STANDARD_LABEL,
    drop_removed: bool = False,
) -> DataFrame:
    """Members with their printed rows after standards and deletes, as a table.

    The result is written once: the packing reads it for the sizes and the grid for the rows.
    """
    group_std = group_standards(carts, settings)
    short = S.apply_standards(carts, settings.std_members, group_std, extras, label, drop_removed)
    return printed_members(short, settings)


def printed_members(short: DataFrame, settings: Settings) -> DataFrame:
    """Collapsed carts to printed rows, as a table."""
    gone = D.all_deletes(settings.permanent_deletes, settings.temporary_deletes)
    return pin_table(P.printable_rows(short, gone), PACKED)


def packed_pages(members: DataFrame, max_rows: int = PAGE_ROWS, run_cols: Sequence[str] = ()) -> DataFrame:
    return pin_table(P.pack_pages(P.rows_per_member(members, run_cols), max_rows, run_cols), PACKED)


def symbol_table(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Symbols per matching item, pinned, so that lines meet a table of known size."""
    return pin_table(L.item_symbols(lines, rules))


def format_table(cells: DataFrame, rules: DataFrame) -> DataFrame:
    return pin_table(L.item_formats(cells, rules))


@dataclass
class Reports:
    """What the orders and settings say beside the sheet."""

    home_delivery: DataFrame
    multi_pickup: DataFrame
    pickup_histogram: DataFrame
    standards_coverage: DataFrame
    standard_summary: DataFrame
    delete_report: DataFrame
    order_only: DataFrame
    groups_without_pages: DataFrame


@dataclass
class WeeklySheet:
    sheet: DataFrame
    styles: DataFrame
    reconciliation: DataFrame
    plants: DataFrame
    reports: Reports
    #: Counts taken while the job wrote its tables.
    counts: dict


def require_sound_settings(settings: Settings) -> None:
    """Stop on settings that would multiply members or contradict each other."""
    require_unique(settings.shares, "group_name")
    require_unique(settings.std_members, "food_list_group_name")
    S.require_no_conflict(settings.std_members, settings.std_items)


def run_names(run: dict | dt.date, settings: Settings) -> dict:
    """Season, week and date of the run, looked up in the rotation where only the date is given."""
    if isinstance(run, dict):
        return run
    if settings.rotation is None:
        raise ValueError("a run given as a date needs the rotation among the settings")
    return U.run_of(U.pickup_calendar(settings.rotation), run)


def weekly_sheet(
    orders: DataFrame,
    settings: Settings,
    run: dict | dt.date,
    max_rows: int | None = None,
    run_cols: Sequence[str] = (),
    options: Options | None = None,
) -> WeeklySheet:
    """Validate, parse, collapse, delete, pack, label and style.

    Several runs go through as one job when ``run_cols`` (week, site, ...) tell them apart
    and ``run`` names columns made of these. Ids must be unique over all runs.

    Checks on orders and pages are counts over tables that the job writes anyway; only where
    one fails, another job lists what is wrong.
    """
    options = options or Options()
    max_rows = max_rows or options.max_rows
    require_sound_settings(settings)
    names = run_names(run, settings)
    cleaned = M.normalise_home_delivery(orders)
    named = M.named_groups(cleaned, settings.shares)
    carts, counts = pin_observed(
        M.member_carts(named, options.quantity_only_numeric),
        n_start=F.count(F.lit(1)), n_unknown=F.count_if(~F.col("known_group")),
    )
    if counts["n_unknown"]:
        M.require_known_groups(cleaned, settings.shares)
    carts = carts.drop("known_group")
    group_std = group_standards(carts, settings)
    collapsed = S.apply_standards(
        carts, settings.std_members, group_std, options.extras, options.label, options.drop_removed
    )
    gone = D.all_deletes(settings.permanent_deletes, settings.temporary_deletes)
    members, ends = pin_observed(P.printable_rows(collapsed, gone), n_end=F.count(F.lit(1)))
    packed = packed_pages(members, max_rows, run_cols)
    cells, printed = pin_observed(
        P.page_cells(members, packed, run_cols),
        n_cells=F.count(F.lit(1)), n_overflow=F.count_if(F.col("row_n") > max_rows),
    )
    if printed["n_overflow"]:
        P.require_no_overflow(cells, max_rows)
    symbols = symbol_table(cells, settings.label_rules)
    labelled = L.with_run_suffix(L.labelled(cells, symbols), names)
    pages = P.gathered_pages(labelled, ["label"], run_cols)
    lines = each_line(collapsed, F.col("cart"), *run_cols, "group_name", "lastname", "firstname").select("*", "line.*")
    count = [M.member_counts(df, name, run_cols) for df, name in ((carts, "n_start"), (members, "n_end"))]
    reports = Reports(
        home_delivery=M.home_delivery_check(orders),
        multi_pickup=U.multi_pickup_members(carts),
        pickup_histogram=U.in_slot_order(U.pickup_histogram(carts)),
        standards_coverage=S.standards_coverage(settings.std_members, settings.std_items),
        standard_summary=S.standard_summary(carts, settings.std_members, group_std, options.extras),
        delete_report=D.delete_report(lines, settings.permanent_deletes, settings.temporary_deletes),
        order_only=collapsed.filter("order_only").select("id"),
        groups_without_pages=P.groups_without_pages(carts, packed, run_cols),
    )
    return WeeklySheet(
        sheet=P.sheet_rows(pages, "label", max_rows, run_cols),
        styles=L.cell_styles(cells, settings.shares, format_table(cells, settings.format_rules)),
        reconciliation=M.reconciliation(*count, run_cols),
        plants=D.plant_extract(lines, run_cols),
        reports=reports,
        counts={**counts, **ends, **printed},
    )
