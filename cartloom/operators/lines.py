"""Carts to long lines, and the synthetic rows around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.cart import NAME_SEQ, order_tokens, printed_lines
from cartloom.functions.fixed_values import GROUP_SORT_TEXT, PICKUP_MARK
from cartloom.plans.ordering import running_offsets

LINE_FIELDS = ["rank", "seq", "quantity", "item", "item_original"]
SORT_KEYS = ["group_name", "description", "time", "lastname", "firstname", "id", "rank", "seq"]


def each_line(carts: DataFrame, lines: Column, *keep: str) -> DataFrame:
    """``keep`` and ``line``, one row per struct of an array of lines.

    The outer explode keeps Catalyst from testing the array's size in a filter of its own,
    which would parse every order text twice; its row for an empty array goes at once.
    """
    return carts.select(*keep, F.explode_outer(lines).alias("line")).filter("line is not null")


def exploded(carts: DataFrame, column: str = "cart") -> DataFrame:
    """One row per element of the cart column, its fields next to the member's columns."""
    others = [c for c in carts.columns if c != column]
    return each_line(carts, F.col(column), *others).select(*others, "line.*")


def order_lines(carts: DataFrame) -> DataFrame:
    return exploded(carts)


def group_rows(carts: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """One header row per group: rank -1, id 0, names '0'."""
    groups = carts.select(*run_cols, "group_name").distinct()
    none = F.lit(None).cast("string")
    return groups.select(
        *run_cols,
        "group_name",
        F.lit("0").alias("firstname"),
        F.lit("0").alias("lastname"),
        F.lit(0).cast("long").alias("id"),
        F.lit("0, 0 [0]").alias("name_long"),
        none.alias("time_descr"),
        F.lit(GROUP_SORT_TEXT).alias("description"),
        none.alias("time"),
        F.lit(-1).alias("rank"),
        F.lit(NAME_SEQ).alias("seq"),
        none.alias("quantity"),
        F.col("group_name").alias("item"),
        F.col("group_name").alias("item_original"),
    )


def member_rows(carts: DataFrame) -> DataFrame:
    """Name row, lines and spacer of every member, built inside the member's row."""
    rows = printed_lines(F.col("cart"), F.col("lastname"), F.col("firstname"))
    return exploded(carts.withColumn("cart", rows))


def long_lines(carts: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """All rows of the long model. The carts are read once for the members and once,
    reduced to the group name, for the headers."""
    return member_rows(carts).unionByName(group_rows(carts, run_cols))


def in_print_order(lines: DataFrame) -> DataFrame:
    """Sort for a sink; missing values last."""
    return lines.orderBy(*[F.col(c).asc_nulls_last() for c in SORT_KEYS])


def line_class_counts(carts: DataFrame) -> DataFrame:
    return (
        exploded(carts.select("group_name", "cart"))
        .groupBy("group_name", "rank")
        .agg(F.count("*").alias("n_lines"))
    )


def legacy_line_numbers(members: DataFrame) -> DataFrame:
    """Untrimmed tokens numbered per (site, first name, last name) across all their rows."""
    names = ["pickup_site", "first_name", "last_name"]
    packed = members.select(
        F.col("group_name").alias("pickup_site"),
        F.col("firstname").alias("first_name"),
        F.col("lastname").alias("last_name"),
        "id",
        order_tokens("order").alias("tokens"),
    ).withColumn("n_tokens", F.size("tokens").cast("long"))
    # only the counts are put in order; the texts join their offsets by id
    counts = packed.select(*names, "id", "n_tokens")
    offsets = running_offsets(counts, names, [F.col("id").asc()], "n_tokens").select("id", "before", "total")
    rank_v = F.col("before") + F.col("pos") + 1
    placed = packed.join(offsets, "id").filter("n_tokens > 0")
    return placed.select("*", F.posexplode_outer("tokens").alias("pos", "order_token")).select(
        *names,
        "id",
        "order_token",
        F.col("order_token").contains(PICKUP_MARK).alias("pickuptime"),
        rank_v.alias("rank_v"),
        (rank_v == 1).alias("group_start"),
        F.col("total").alias("rows_in_group"),
    )


def preview(lines: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows in print order."""
    return in_print_order(lines).limit(n)
