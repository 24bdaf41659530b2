"""Delete lists, order-only members, plants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.cart import of_rank
from cartloom.functions.fixed_values import ORDER_ONLY_ITEMS, POT_PLANT_MARK
from cartloom.plans.ordering import join_on_item


def is_plant(item: Column, mark: str = POT_PLANT_MARK) -> Column:
    return F.coalesce(item.contains(mark), F.lit(False))


def is_order_only_member(cart: Column) -> Column:
    """The cart holds an order-only line and nothing else of rank 3."""
    listed = F.array(*[F.lit(item) for item in ORDER_ONLY_ITEMS])
    only = F.coalesce(F.arrays_overlap(cart["item"], listed), F.lit(False))
    return only & (F.size(of_rank(cart, 3)) == 1)


def order_only_members(carts: DataFrame) -> DataFrame:
    return carts.filter(is_order_only_member(F.col("cart"))).select("id")


def delete_report(lines: DataFrame, permanent: DataFrame, temporary: DataFrame) -> DataFrame:
    """Lines per item that each list, and the plant rule, removes.

    The lines are read once and counted per item; the lists then meet item counts, not lines.
    """
    counts = lines.groupBy("item").agg(F.count("*").alias("n_lines"))
    named = permanent.select("item", F.lit("permanent").alias("list_name")).unionByName(
        temporary.select("item", F.lit("temporary").alias("list_name"))
    )
    # at most two names per item
    lists = named.filter(F.col("item").isNotNull()).groupBy("item").agg(F.collect_set("list_name").alias("lists"))
    plant = F.when(is_plant(F.col("item")), F.lit("plants"))
    every = F.array_compact(F.array_append(F.coalesce("lists", F.array().cast("array<string>")), plant))
    return counts.join(lists, "item", "left").select("item", "n_lines", F.explode(every).alias("list_name"))


def all_deletes(permanent: DataFrame, temporary: DataFrame) -> DataFrame:
    both = permanent.select("item").unionByName(temporary.select("item"))
    return both.filter(F.col("item").isNotNull()).distinct()


def without_order_only(carts: DataFrame) -> DataFrame:
    return carts.filter(~is_order_only_member(F.col("cart")))


def without_deleted_items(lines: DataFrame, permanent: DataFrame, temporary: DataFrame) -> DataFrame:
    """Lines minus both lists and the plants; rows without an item (spacers) stay."""
    kept = join_on_item(lines, all_deletes(permanent, temporary), "left_anti")
    return kept.filter(~is_plant(F.col("item")))


def plant_extract(lines: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Plant lines, taken before the deletes."""
    return lines.filter(is_plant(F.col("item"))).select(
        *run_cols, "group_name", "lastname", "firstname", "item", "quantity"
    )
