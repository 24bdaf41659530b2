"""One member's packed order text as an array of parsed lines (the *cart*).

Everything that is decided per member (class of each line, first pickup slot,
standard-share match, order-only test, rows on the sheet) is computed on this
array inside the row, so none of it needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartloom.functions.fixed_values import ORDER_ONLY_ITEMS, PICKUP_MARK
from cartloom.functions.text import name_text, piece

# A line is a struct (rank, seq, quantity, item, item_original). rank and seq come first:
# the natural order of the struct is the print order.
NAME_SEQ = -1
SPACER_SEQ = 2147483647


def _tokens_sql(order: str) -> str:
    name = f"`{order}`"
    return f"""CASE
        WHEN {name} IS NULL THEN array(CAST(NULL AS STRING))
        WHEN {name} = '' THEN CAST(array() AS ARRAY<STRING>)
        ELSE split(if(endswith({name}, ','), left({name}, length({name}) - 1), {name}), ',') END"""


def order_tokens(order: str) -> Column:
    """Comma-separated pieces; one empty last piece is dropped, '' has none, NULL has one NULL."""
    return F.expr(_tokens_sql(order))


def line(rank, seq, quantity, item, item_original) -> Column:
    return F.struct(
        F.lit(rank).cast("int").alias("rank"),
        F.lit(seq).cast("int").alias("seq"),
        F.lit(quantity).cast("string").alias("quantity"),
        F.lit(item).cast("string").alias("item"),
        F.lit(item_original).cast("string").alias("item_original"),
    )


def parse_cart(order: str, quantity_only_numeric: bool = False) -> Column:
    """Split every token at its first ``x`` and classify it: (rank, seq, quantity, item, item_original).

    Head and item are both the whole token where it has no ``x``, so equal ones mean no quantity. Functions
    over arrays are interpreted, so they are few and short. With ``quantity_only_numeric`` the text before
    ``x`` must be a number, so that an item holding an ``x`` of its own stays whole.
    """
    head, item = "substring_index(t, 'x', 1)", "substr(t, instr(t, 'x') + 1)"
    if quantity_only_numeric:
        head, item = (rf"if(t RLIKE r'^\d*\.?\d+x', {part}, t)" for part in (head, item))
    order_only = ", ".join(f"'{t}'" for t in ORDER_ONLY_ITEMS)
    trimmed = rf"transform({_tokens_sql(order)}, t -> btrim(t, '\t\r\n '))"
    parts = f"transform({trimmed}, t -> struct(t AS token, {head} AS head, {item} AS item))"
    return F.expr(f"""transform({parts}, (t, i) -> struct(
        CASE WHEN t.head <> t.item THEN if(contains(t.token, '{PICKUP_MARK}'), 2, 3)
            WHEN t.item IS NULL OR t.item IN ({order_only}) THEN 3 ELSE 1 END AS rank,
        i AS seq,
        if(t.head <> t.item, t.head, NULL) AS quantity,
        t.item AS item,
        t.token AS item_original))""")


def of_rank(cart: Column, rank: int) -> Column:
    return F.filter(cart, lambda x: x["rank"] == rank)


def slot_time(pickup_item: Column) -> Column:
    return piece(pickup_item, " ", 1, 3)


def slot_description(pickup_item: Column) -> Column:
    return piece(pickup_item, " ", 2, 3)


def first_slot(cart: Column) -> Column:
    """The pickup line that comes first by (description, time, position); missing texts sort last."""

    def sortable(x: Column) -> Column:
        desc, time = slot_description(x["item"]), slot_time(x["item"])
        return F.struct(
            desc.isNull().alias("no_desc"),
            desc.alias("description"),
            time.isNull().alias("no_time"),
            time.alias("time"),
            x["seq"].alias("seq"),
            x["item"].alias("item"),
        )

    return F.array_min(F.transform(of_rank(cart, 2), sortable))


def printed_lines(cart: Column, lastname: Column, firstname: Column) -> Column:
    """Name row, cart lines in print order, spacer row."""
    name = name_text(lastname, firstname)
    return F.concat(
        F.array(line(0, NAME_SEQ, None, name, name)),
        F.sort_array(cart),
        F.array(line(4, SPACER_SEQ, None, None, None)),
    )
