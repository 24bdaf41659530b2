"""Two-column pages.

Members are packed in print order: each goes to a column of the open page or opens
a new page. The rule is sequential inside a group, but a page that opens forgets
everything before it. So a run of members can be summed up by "if the first page
break in this run falls on its j-th member, the run ends in that state", and j is at
most the number of members one page can hold. The job is then

1. range partition the members (:func:`ordered_slots`); a big group spans many chunks,
2. sum up every chunk on its own,
3. join the sums of neighbouring chunks, ``FAN_IN`` at a time, level by level: a sum of sums
   has the same form and size, so this is a tree, and then
4. walk down the tree, each node giving its children their starts,
5. place the members of every chunk from its known start.

No task sees more than ``FAN_IN`` sums, however many members a group has.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.cart import line, printed_lines
from cartloom.functions.fixed_values import PAGE_ROWS
from cartloom.operators.deletes import is_order_only_member, is_plant
from cartloom.operators.lines import each_line, exploded
from cartloom.operators.standards import listed
from cartloom.plans import ordering
from cartloom.plans.ordering import join_on_keys, ordered_slots, running_offsets
from cartloom.plans.pinning import pin_table

# workers get the packing functions themselves, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EMPTY_PAGE = (0, 0, 0, 0)  # rows of column 1 and 2, members of column 1 and 2
PLACED_COLUMNS = "id bigint, n int, has_header boolean, page_n bigint, column_n int, rows_ahead int"
#: So many sums of chunks are joined in one task.
FAN_IN = 64
#: So many deleted items at most go into the plan; longer lists are joined.
LISTED = 1_000


# ---------------------------------------------------------------- rows of a member


def printable_rows(carts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Adds ``rows``: a member's printed rows after all deletes, and ``has_header`` for the group.

    A delete list of up to ``LISTED`` items is tested inside the member's row, as a set in the plan, so
    no member moves. Of a longer one only the places of rows that it hits are gathered: rows meet the list
    in a join, and the places go back to their members.
    """
    rows = printed_lines(F.col("cart"), F.col("lastname"), F.col("firstname"))
    order_only = F.col("order_only") if "order_only" in carts.columns else is_order_only_member(F.col("cart"))
    kept = carts.filter(~order_only)
    has_flags = "std_flags" in carts.columns

    def flagged(x: Column) -> Column:
        standard = listed(F.col("std_flags"), F.col("flag_null"), x["item"]) if has_flags else F.lit(False)
        return F.struct(
            x["rank"].alias("rank"),
            x["seq"].alias("seq"),
            x["quantity"].alias("quantity"),
            x["item"].alias("item"),
            F.when(standard, 1).alias("standard_item"),
        )

    unused = ("cart", "order_only", "full", "with_extras")
    items = deletes.filter(F.col("item").isNotNull()).select("item").distinct()
    some = [r.item for r in items.limit(LISTED + 1).collect()]
    if len(some) <= LISTED:
        # rows that go are not flagged first
        marked, then = kept.withColumn("rows", rows).drop(*unused), flagged

        def deleted(at: Column, item: Column) -> Column:
            return F.coalesce(item.isin(some), F.lit(False)) if some else F.lit(False)
    else:
        # flagged before they move, without what is not printed
        named = kept.withColumn("rows", F.transform(rows, flagged)).drop(*unused, "std_flags", "flag_null")
        marked, then = _with_places_gone(named, items), None

        def deleted(at: Column, item: Column) -> Column:
            return F.array_contains("gone", at)

    def stays(at: Column, item: Column) -> Column:
        return ~deleted(at, item) & ~is_plant(item)

    # the spacer has no item, so every member keeps at least one row
    kept_rows = F.filter("rows", lambda x, i: stays(i, x["item"]))
    printed = F.transform(kept_rows, then) if then else kept_rows
    out = marked.withColumns({"rows": printed, "has_header": stays(F.lit(-1), F.col("group_name"))})
    return out.drop("gone", "std_flags", "flag_null").withColumn("n", F.size("rows"))


def _with_places_gone(named: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``gone``: the places of a member's rows whose item is listed; the group's header is place -1."""
    # rows without an item match nothing
    spots = F.concat(
        F.array(F.struct(F.lit(-1).alias("at"), F.col("group_name").alias("item"))),
        F.transform("rows", lambda x, i: F.struct(i.alias("at"), x["item"].alias("item"))),
    )
    spots = F.filter(spots, lambda x: x["item"].isNotNull())
    hits = each_line(named, spots, "id").select("id", "line.at", "line.item").join(items, "item")
    # a member's rows come from one record, so these places are bounded by the record
    gone = hits.groupBy("id").agg(F.collect_set("at").alias("gone"))
    return named.join(gone, "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))


def rows_per_member(members: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    return members.select(
        *run_cols, "group_name", "description", "time", "lastname", "firstname", "id", "n", "has_header"
    )


# ------------------------------------------------------------------------- packing


def _step(state, n, cap):
    """Column for the next member and the new page state; column 0 means a new page."""
    rows1, rows2, members1, members2 = state
    full1, full2 = rows1 + n >= cap, rows2 + n >= cap
    if full1 and full2:
        return 0, (n, 0, 1, 0)
    if full1 or (not full2 and members1 > members2):
        return 2, (rows1, rows2 + n, members1, members2 + 1)
    return 1, (rows1 + n, rows2, members1 + 1, members2)


def _sizes(pdf: pd.DataFrame) -> list[int]:
    return pdf.sort_values("slot")["n"].tolist()


def _chunk_sums(sizes: list[int], cap: int) -> tuple[list[int], list[tuple]]:
    """For each member of the head as first page break: pages opened and final state."""
    head = sizes[: 2 * cap]
    done: dict[int, tuple] = {}
    for start in range(len(head)):
        trail, at = [], start
        while at not in done:
            trail.append(at)
            state, nxt = (sizes[at], 0, 1, 0), at + 1
            while nxt < len(sizes):
                column, after = _step(state, sizes[nxt], cap)
                if column == 0:
                    break
                state, nxt = after, nxt + 1
            if nxt >= len(sizes):
                done[at] = (1, *state)
                trail.pop()
                break
            at = nxt
        pages, *state = done[at]
        for opened in reversed(trail):
            pages += 1
            done[opened] = (pages, *state)
    return head, [done[j] for j in range(len(head))]


def _through(state, head, ends, cap):
    """State after a chunk, and pages opened in it, given the state before it."""
    for j, n in enumerate(head):
        column, after = _step(state, n, cap)
        if column == 0:
            pages, *state = ends[j]
            return pages, tuple(state)
        state = after
    return 0, state


def _join_sums(first, second, cap):
    """The sum of two neighbouring runs of members, from their sums."""
    (head, ends), (more, more_ends) = first, second
    joined = []
    for pages, *state in ends:
        opened, state = _through(tuple(state), more, more_ends, cap)
        joined.append((pages + opened, *state))
    # the first break can fall into the second run only if the first is shorter than a page can be
    room = 2 * cap - len(head)
    return [*head, *more[:room]], joined + more_ends[:room]


def _starts(sums: list, page: int, state: tuple, forced: bool, cap: int) -> list[tuple]:
    """Page, state and whether a page is forced open, before each of some neighbouring runs."""
    out = []
    for head, ends in sums:
        out.append((page, *state, forced))
        if forced:
            opened, *state = ends[0]
            opened, state = opened - 1, tuple(state)
        else:
            opened, state = _through(state, head, ends, cap)
        page, forced = page + opened, False
    return out


def _sums_of(pdf: pd.DataFrame) -> list:
    """``(head, ends)`` of each row, in order of nodes."""
    rows = pdf.sort_values("node")
    return [
        (list(head), [tuple(flat[i : i + 5]) for i in range(0, len(flat), 5)])
        for head, flat in zip(rows["head"], rows["ends"])
    ]


def _sums_row(keys: dict, head: list, ends: list) -> pd.DataFrame:
    return pd.DataFrame([keys | {"head": head, "ends": [v for end in ends for v in end]}])


def pack_pages(
    sizes: DataFrame, max_rows: int = PAGE_ROWS, run_cols: Sequence[str] = ()
) -> DataFrame:
    """Page, column and rows ahead in that column for every member.

    ``sizes`` has the columns of :func:`rows_per_member`. Groups are packed on their
    own. ``run_cols`` (week, site, ...) tell weekly runs apart: the very first member of
    a run opens page 1 even when it is too long for a page.
    """
    cap = max_rows - 1
    group_cols = [*run_cols, "group_name"]
    order = [F.col(c).asc_nulls_last() for c in ("description", "time", "lastname", "firstname")]
    order += [F.col("n").desc(), F.col("id").asc()]
    placed = ordered_slots(
        sizes.select(*group_cols, "description", "time", "lastname", "firstname", "id", "n", "has_header"),
        group_cols,
        order,
    ).select(*group_cols, "chunk", "slot", "id", "n", "has_header")
    fields = {f.name: f.dataType.simpleString() for f in placed.schema}
    key_ddl = ", ".join(f"`{c}` {fields[c]}" for c in group_cols)
    chunk_keys, node_keys = [*group_cols, "chunk"], [*group_cols, "node"]
    sums_schema = f"{key_ddl}, node bigint, head array<int>, ends array<bigint>"
    starts_schema = f"{key_ddl}, node bigint, page bigint, rows1 int, rows2 int, members1 int, members2 int, forced boolean"
    parent = F.expr(f"node div {FAN_IN}").alias("node")

    def chunk_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _sums_row(dict(zip(node_keys, key)), *_chunk_sums(_sizes(pdf), cap))

    sums = placed.withColumnRenamed("chunk", "node").groupBy(*node_keys).applyInPandas(chunk_sums, sums_schema)
    # a chunk's number has the partition in its high bits; nodes are numbered closely
    bits = 33 - ordering.CHUNK_BITS
    run = F.col("node").bitwiseAND((1 << bits) - 1)
    level = pin_table(sums)
    part = F.shiftright("node", bits)
    widest = level.agg(F.max(part).alias("part"), F.max(run).alias("run")).first()
    if widest.part is None:
        return sizes.sparkSession.createDataFrame([], f"{key_ddl}, {PLACED_COLUMNS}")
    runs = widest.run + 1
    level = level.withColumn("node", part * runs + run)

    def join_level(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _sums_of(pdf)
        whole = found[0]
        for more in found[1:]:
            whole = _join_sums(whole, more, cap)
        return _sums_row(dict(zip(node_keys, key)), *whole)

    levels, last = [level], widest.part * runs + widest.run
    while last >= FAN_IN:
        levels.append(pin_table(levels[-1].groupBy(*group_cols, parent).applyInPandas(join_level, sums_schema)))
        last //= FAN_IN
    # missing names sort last here too
    sortable = [f for c in group_cols for f in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    firsts = (
        placed.groupBy(*run_cols)
        .agg(F.min(F.struct(*sortable)).alias("first_group"))
        .select(*[F.col("first_group")[c].alias(c) for c in group_cols], F.lit(True).alias("opens_run"))
    )
    marked = join_on_keys(levels[-1], firsts, group_cols, "left").withColumn(
        "opens_run", F.coalesce("opens_run", F.lit(False))
    )

    def started(key: tuple, pdf: pd.DataFrame, begins: list[tuple]) -> pd.DataFrame:
        nodes = sorted(pdf["node"])
        rows = [(*key[: len(group_cols)], node, *begin) for node, begin in zip(nodes, begins)]
        return pd.DataFrame(rows, columns=[*node_keys, "page", "rows1", "rows2", "members1", "members2", "forced"])

    def from_top(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return started(key, pdf, _starts(_sums_of(pdf), 1, EMPTY_PAGE, bool(pdf["opens_run"].iloc[0]), cap))

    def from_parent(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        begin = above.iloc[0]
        state = tuple(int(begin[c]) for c in ("rows1", "rows2", "members1", "members2"))
        return started(key, pdf, _starts(_sums_of(pdf), int(begin["page"]), state, bool(begin["forced"]), cap))

    # at the top a group has FAN_IN nodes at most
    starts = marked.groupBy(*group_cols).applyInPandas(from_top, starts_schema)
    for below in reversed(levels[:-1]):
        starts = (
            below.groupBy(*group_cols, parent)
            .cogroup(starts.groupBy(*node_keys))
            .applyInPandas(from_parent, starts_schema)
        )
    number = F.shiftleft(F.expr(f"node div {runs}"), bits) + F.col("node") % runs
    starts = starts.withColumn("chunk", number).drop("node")

    def place(key: tuple, members: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("slot")
        begin = start.iloc[0]
        page, forced = int(begin["page"]), bool(begin["forced"])
        state = tuple(int(begin[c]) for c in ("rows1", "rows2", "members1", "members2"))
        pages, columns, ahead = [], [], []
        for n in members["n"].tolist():
            if forced:
                column, before, state, forced = 1, 0, (n, 0, 1, 0), False
            else:
                column, after = _step(state, n, cap)
                if column == 0:
                    page, column, before = page + 1, 1, 0
                else:
                    before = state[column - 1]
                state = after
            pages.append(page)
            columns.append(column)
            ahead.append(before)
        out = members[[*group_cols, "id", "n", "has_header"]].copy()
        out["page_n"], out["column_n"], out["rows_ahead"] = pages, columns, ahead
        return out

    return (
        placed.groupBy(*chunk_keys)
        .cogroup(starts.groupBy(*chunk_keys))
        .applyInPandas(
            place, f"{key_ddl}, {PLACED_COLUMNS}"
        )
    )


# ---------------------------------------------------------------------------- grid

#: What a cell holds.
CELL_FIELDS = ("id", "n", "rank", "quantity", "item", "standard_item", "name_long", "lastname", "firstname")


#: Fields of a cell that come from the printed row; the others are the member's.
ROW_FIELDS = ("rank", "quantity", "item", "standard_item")


def _placed_rows(members: DataFrame, packed: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Members with their place, whether they bring the group's header along, and the rows of the page above them.

    The first member of a column (no rows ahead) has the header on top, so headers
    need no join of their own.
    """
    opens = (F.col("rows_ahead") == 0) & F.col("has_header")
    seq = [c for c in ("page_seq",) if c in packed.columns]
    placed = members.join(packed.select("id", "page_n", "column_n", "rows_ahead", *seq), "id")
    skip = F.col("rows_ahead") + F.when(F.col("has_header") & (F.col("rows_ahead") > 0), 1).otherwise(0)
    return placed, opens, skip


def _in_header(field: str) -> Column:
    """What a header's cell holds."""
    row = line(-1, None, None, F.col("group_name"), None)
    if field in ("rank", "quantity", "item"):
        return row[field]
    if field == "standard_item":
        return F.lit(None).cast("int")
    return {"id": F.lit(0).cast("long"), "n": F.lit(1)}.get(field, F.lit(None).cast("string"))


def page_cells(members: DataFrame, packed: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Filled cells: the group header on top of every used column, then the members' rows.

    Rows are exploded as they are and become cells behind that: plain expressions, which Spark compiles,
    where a function over the array is interpreted for every cell.
    """
    placed, opens, skip = _placed_rows(members, packed)
    place = [*run_cols, "group_name", "page_n"]
    kind, none = members.schema["rows"].dataType.elementType, F.lit(None)
    header = F.array(F.struct(*[(_in_header(f.name) if f.name in ROW_FIELDS else none).cast(f.dataType).alias(f.name) for f in kind]))
    rows = F.concat(F.when(opens, header).otherwise(F.slice(header, 1, 0)), F.col("rows"))
    own = [c for c in CELL_FIELDS if c not in ROW_FIELDS]
    # outer: see each_line
    each = placed.select(*place, "column_n", skip.alias("skip"), opens.alias("opens"), *own, F.posexplode_outer(rows).alias("pos", "row"))
    on_top = F.col("opens") & (F.col("pos") == 0)

    def cell(field: str) -> Column:
        value = F.col("row")[field] if field in ROW_FIELDS else F.when(on_top, _in_header(field)).otherwise(F.col(field))
        return value.alias(field)

    row_n = (F.col("skip") + F.col("pos") + 1).cast("int").alias("row_n")
    return each.filter("pos is not null").select(*place, row_n, "column_n", *[cell(c) for c in CELL_FIELDS])


def page_columns(
    members: DataFrame,
    packed: DataFrame,
    fields: Sequence[str] = CELL_FIELDS,
    run_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per page: ``cells_1`` and ``cells_2``, the cells of its columns from the top.

    Members move to their page with an array for each field, in one shuffle; blank cells
    never move. A page holds few members, so a group of any size is many small keys.
    If the places are numbered (:func:`numbered_pages`), the pages keep their ``page_seq`` and come
    in its order: in ranges, each of them sorted.
    """
    placed, opens, _ = _placed_rows(members, packed)
    seq = ["page_seq"] if "page_seq" in packed.columns else []

    def values(field: str) -> Column:
        own = F.col("rows")[field] if field in ROW_FIELDS else F.array_repeat(field, F.size("rows"))
        top = F.array(_in_header(field))
        return F.concat(F.when(opens, top).otherwise(F.slice(top, 1, 0)), own).alias(field)

    piece = F.struct("column_n", F.col("rows_ahead").alias("at"), *[values(f) for f in fields])
    return _by_page(placed.select(*run_cols, "group_name", "page_n", *seq, piece.alias("piece")), fields, run_cols, seq)


def gathered_pages(cells: DataFrame, fields: Sequence[str], run_cols: Sequence[str] = ()) -> DataFrame:
    """The same from filled cells, for what is known only per cell, such as labels."""
    piece = F.struct("column_n", F.col("row_n").alias("at"), *[F.array(f).alias(f) for f in fields])
    return _by_page(cells.select(*run_cols, "group_name", "page_n", piece.alias("piece")), fields, run_cols)


def _by_page(pieces: DataFrame, fields: Sequence[str], run_cols: Sequence[str], seq: Sequence[str] = ()) -> DataFrame:
    """Pages from pieces of their columns: struct of ``column_n``, ``at`` and an array for each field."""
    page = [*run_cols, "group_name", "page_n", *seq]
    order = [F.col(c).asc_nulls_last() for c in (*run_cols, *seq)]
    # members of a page are scattered over the table, so collecting before the shuffle gains nothing
    dealt = pieces.repartitionByRange(*order) if seq else pieces.repartition(*page)
    grouped = dealt.groupBy(*page).agg(F.sort_array(F.collect_list("piece")).alias("pieces"))

    def column(k: int) -> Column:
        mine = F.filter("pieces", lambda x: x["column_n"] == k)
        return F.arrays_zip(*[F.flatten(mine[f]).alias(f) for f in fields]).alias(f"cells_{k}")

    pages = grouped.select(*page, column(1), column(2))
    return pages.sortWithinPartitions(*order) if seq else pages


def page_overflow(cells: DataFrame, max_rows: int = PAGE_ROWS) -> DataFrame:
    """Cells that fall below the page; they would not be printed."""
    return cells.filter(F.col("row_n") > max_rows)


def groups_without_pages(carts: DataFrame, packed: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Groups left without any member; they have no page."""
    group = [*run_cols, "group_name"]
    groups = carts.select(*group).distinct()
    return join_on_keys(groups, packed.select(*group).distinct(), group, "left_anti")


def require_no_overflow(cells: DataFrame, max_rows: int = PAGE_ROWS) -> DataFrame:
    bad = page_overflow(cells, max_rows).select("group_name", "page_n", "column_n").limit(5).collect()
    if bad:
        raise ValueError(f"columns longer than a page: {[tuple(r) for r in bad]}")
    return cells


def _fitting(max_rows: int) -> Column:
    """The numbers of a page's rows. A column longer than the page is an error: its end would not be printed."""
    where = F.format_string("column longer than a page: group %s, page %s", "group_name", "page_n")
    longest = F.greatest(F.size("cells_1"), F.size("cells_2"))
    return F.sequence(F.lit(1), F.when(longest > max_rows, F.raise_error(where).cast("int")).otherwise(F.lit(max_rows)))


def _cell(column: int, row: Column) -> Column:
    """A cell by its place; missing below the last one of its column."""
    return F.get(F.col(f"cells_{column}"), row - 1)


def page_grid(pages: DataFrame, max_rows: int = PAGE_ROWS, run_cols: Sequence[str] = ()) -> DataFrame:
    """Both columns of every page, rows 1 to ``max_rows``; unused cells hold no member."""

    def both(row: Column) -> Column:
        return F.array(*[
            F.struct(row.alias("row_n"), F.lit(k).alias("column_n"), _cell(k, row).alias("cell")) for k in (1, 2)
        ])

    spots = pages.select(*run_cols, "group_name", "page_n", F.explode(F.flatten(F.transform(_fitting(max_rows), both))).alias("spot"))
    return spots.select(*run_cols, "group_name", "page_n", "spot.row_n", "spot.column_n", "spot.cell.*")


def two_column_sheet(
    pages: DataFrame, value: str = "item", max_rows: int = PAGE_ROWS, run_cols: Sequence[str] = ()
) -> DataFrame:
    """The columns of a page side by side, a row per line of the page."""
    extra = [c for c in pages.columns if c not in (*run_cols, "group_name", "page_n", "cells_1", "cells_2")]

    def pair(row: Column) -> Column:
        return F.struct(
            row.alias("row_n"), _cell(1, row)[value].alias("item_1"), _cell(2, row)[value].alias("item_2")
        )

    lines = pages.select(
        *run_cols, "group_name", "page_n", *extra, F.explode(F.transform(_fitting(max_rows), pair)).alias("x")
    )
    return lines.select(*run_cols, "group_name", "page_n", "x.*", *extra)


def page_subset(sheet: DataFrame, group_name: str, page_n: int) -> DataFrame:
    return sheet.filter((F.col("group_name") == group_name) & (F.col("page_n") == page_n))


def numbered_pages(pages: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Adds ``n_pages`` of the group, its ``last_page``, and ``page_seq``: pages ahead on one long sheet per run.

    Takes pages or, as every page has a member, the places of members, which are much smaller.
    """
    group = [*run_cols, "group_name"]
    found = pages.groupBy(*group).agg(F.max("page_n").alias("last_page"), F.min("page_n").alias("first_page"))
    found = found.withColumn("n_pages", F.col("last_page") - F.col("first_page") + 1).withColumn("all", F.lit(1))
    before = running_offsets(found, [*run_cols, "all"], [F.col("group_name").asc_nulls_last()], "n_pages")
    # one row per group meets one row per page, not every line of it; a table, so that its size is known
    numbered = join_on_keys(pages, pin_table(before.drop("all", "total")), group)
    page_seq = F.col("before") + F.col("page_n") - F.col("first_page")
    return numbered.withColumn("page_seq", page_seq).drop("before", "first_page")


def sheet_rows(
    pages: DataFrame, value: str = "item", max_rows: int = PAGE_ROWS, run_cols: Sequence[str] = ()
) -> DataFrame:
    """The two-column sheet with ``sheet_row``: the row on one long sheet per run, all pages below each other.

    Pages that come in the order of their numbers (:func:`page_columns`) give the sheet in order too.
    """
    numbered = pages if "page_seq" in pages.columns else numbered_pages(pages, run_cols)
    lines = two_column_sheet(numbered, value, max_rows, run_cols)
    return lines.withColumn("sheet_row", F.col("page_seq") * max_rows + F.col("row_n")).drop("page_seq", "n_pages", "last_page")


def member_lines(members: DataFrame) -> DataFrame:
    """Printed rows of every member as lines."""
    return exploded(members, "rows")
