"""Cart search and pick lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions.cart import printed_lines
from cartloom.functions.text import name_text
from cartloom.operators.deletes import is_plant
from cartloom.operators.lines import each_line
from cartloom.operators.members import shares_by_short_name


def food_group_scope(df: DataFrame, shares: DataFrame, food_groups: Sequence[str]) -> DataFrame:
    """Rows whose group belongs to one of the food groups."""
    wanted = (
        shares_by_short_name(shares)
        .filter(F.col("food_list_group_name").isin(list(food_groups)))
        .select("group_name", "food_list_group_name")
    )
    return df.join(wanted, "group_name")


def cart_search(
    carts: DataFrame, shares: DataFrame, food_groups: Sequence[str], terms: Sequence[str]
) -> DataFrame:
    """All rows of members who have, for every non-empty term, a row that matches it.

    Terms are patterns, not case sensitive. The test runs inside the member's row, as a
    condition on the exploded array: a filter would be pushed down to the order text and
    parse it once more per term.
    """
    rows = printed_lines(F.col("cart"), F.col("lastname"), F.col("firstname"))
    scoped = food_group_scope(carts, shares, food_groups).select(
        "group_name",
        "name_long",
        rows.alias("rows"),
        F.transform("cart", lambda x: F.lower(x["item_original"])).alias("tokens"),
        F.lower(name_text(F.col("lastname"), F.col("firstname"))).alias("name"),
    )
    hit = F.lit(True)
    for term in terms:
        if term:
            pattern = term.lower()
            in_cart = F.exists("tokens", lambda t: F.coalesce(t.rlike(pattern), F.lit(False)))
            hit = hit & (F.col("name").rlike(pattern) | in_cart)
    return each_line(scoped, F.when(hit, F.col("rows")), "group_name", "name_long").select(
        "group_name", "name_long", "line.item_original"
    )


def member_picklist(carts: DataFrame, shares: DataFrame, food_groups: Sequence[str]) -> DataFrame:
    return food_group_scope(carts, shares, food_groups).select("name_long").distinct().orderBy("name_long")


def item_picklist(carts: DataFrame, shares: DataFrame, food_groups: Sequence[str]) -> DataFrame:
    scoped = food_group_scope(carts.select("group_name", "cart"), shares, food_groups)
    return (
        each_line(scoped, F.col("cart"))
        .filter(F.col("line.rank") == 3)
        .select("line.item_original", "line.item")
        .distinct()
        .orderBy(F.col("item").asc_nulls_last(), "item_original")
    )


def deletable_items(lines: DataFrame) -> DataFrame:
    """Items that may be put on a delete list: rank 3 and not a plant."""
    return (
        lines.filter((F.col("rank") == 3) & F.col("item").isNotNull() & ~is_plant(F.col("item")))
        .select("item")
        .distinct()
    )
