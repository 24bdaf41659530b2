"""Standard shares: members who kept the standard list collapse to one line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.cart import line, of_rank
from cartloom.functions.fixed_values import FOOD_GROUPS, STANDARD_LABEL
from cartloom.operators.deletes import is_order_only_member
from cartloom.operators.lines import each_line
from cartloom.operators.members import shares_by_short_name
from cartloom.plans.ordering import join_on_keys

COLLAPSED_SEQ = -1


def standards_conflict(std_members: DataFrame, std_items: DataFrame) -> DataFrame:
    """Food groups that name both a member and items, which is not allowed."""
    entries = std_members.select("food_list_group_name", "name_long").unionByName(
        std_items.select("food_list_group_name", "item_original"), allowMissingColumns=True
    )
    return (
        entries.groupBy("food_list_group_name")
        .agg(F.count("name_long").alias("name_cnt"), F.count("item_original").alias("item_cnt"))
        .filter((F.col("name_cnt") > 0) & (F.col("item_cnt") > 0))
    )


def require_no_conflict(std_members: DataFrame, std_items: DataFrame) -> None:
    bad = standards_conflict(std_members, std_items).limit(5).collect()
    if bad:
        raise ValueError(f"food groups with both a member and items: {[r.food_list_group_name for r in bad]}")


def standards_coverage(std_members: DataFrame, std_items: DataFrame, expected: int = len(FOOD_GROUPS)) -> DataFrame:
    """One row: food groups with any standard, and whether some are missing (a warning)."""
    named = std_members.filter(F.col("name_long").isNotNull()).select("food_list_group_name")
    listed = std_items.filter(F.col("item_original").isNotNull()).select("food_list_group_name")
    return (
        named.unionByName(listed)
        .agg(F.countDistinct("food_list_group_name").alias("n_groups"))
        .select("n_groups", (F.col("n_groups") < expected).alias("incomplete"))
    )


def standard_lines(carts: DataFrame, std_members: DataFrame, std_items: DataFrame) -> DataFrame:
    """(food_list_group_name, item_original, item, quantity), distinct, from both kinds of standard."""
    named = std_members.filter(F.col("name_long").isNotNull()).select("food_list_group_name", "name_long")
    of_member = (
        carts.select("name_long", "cart")
        .join(named, "name_long")
    )
    of_member = each_line(of_member, of_rank(F.col("cart"), 3), "food_list_group_name").select(
        "food_list_group_name", "line.item_original", "line.item"
    )
    token = F.col("item_original")
    at = F.instr(token, "x")
    listed = std_items.filter(token.isNotNull()).select(
        "food_list_group_name",
        "item_original",
        # an item typed without a quantity has no item part
        F.when(at > 0, F.substr(token, at + 1)).alias("item"),
    )
    return of_member.unionByName(listed).distinct()


def standard_items(std_lines: DataFrame, shares: DataFrame) -> DataFrame:
    """(group_name, item, standard_item = 1): items to flag per group, whatever their quantity."""
    groups = shares_by_short_name(shares).select("group_name", "food_list_group_name")
    return (
        std_lines.select("food_list_group_name", "item")
        .distinct()
        .join(groups, "food_list_group_name", "left")
        .select("group_name", "item", F.lit(1).alias("standard_item"))
    )


def group_standards(std_lines: DataFrame, shares: DataFrame) -> DataFrame:
    """One row per group: its standard tokens (``std``, with quantity), how many they are
    (``std_size``), and its standard items (``std_flags``). Missing entries are told by
    ``std_null`` and ``flag_null``. As large as the settings, not the orders.
    """
    # sites that share a short name are one group, with the standards of all of them
    groups = shares_by_short_name(shares).select("group_name", "food_list_group_name").distinct()
    token, item = F.col("item_original"), F.col("item")
    sets = std_lines.join(groups, "food_list_group_name").groupBy("group_name").agg(
        F.sort_array(F.collect_set(token)).alias("std"),
        F.max(token.isNull()).alias("std_null"),
        F.sort_array(F.collect_set(item)).alias("std_flags"),
        F.max(item.isNull()).alias("flag_null"),
    )
    size = F.size("std") + F.col("std_null").cast("int")
    return sets.select(
        "group_name", "std", "std_null", size.alias("std_size"), "std_flags", "flag_null"
    )


def listed(values: Column, has_null: Column, value: Column) -> Column:
    """Membership where a missing value can be a member; False when there is no list."""
    inside = F.when(value.isNull(), has_null).otherwise(F.array_contains(values, value))
    return F.coalesce(inside, F.lit(False))


def matched_carts(carts: DataFrame, group_std: DataFrame, extras: str = "last_line") -> DataFrame:
    """Adds ``full`` and ``with_extras`` to every member.

    Tokens are compared with their quantity, repeated tokens count once. A cart with
    extras matches when it holds the whole standard and, unless ``extras`` is
    ``containment``, its last line is a standard line.
    """
    if extras not in ("last_line", "containment"):
        raise ValueError(f"unknown extras rule {extras!r}")
    lines = F.array_distinct(F.transform(of_rank(F.col("cart"), 3), lambda x: x["item_original"]))
    with_sets = join_on_keys(carts, group_std, ["group_name"], "left").withColumn("lines", lines)
    held = F.size(F.filter("lines", lambda t: listed(F.col("std"), F.col("std_null"), t)))
    whole = (F.col("std_size") > 0) & (F.col("held") == F.col("std_size"))
    more = F.size("lines") > F.col("held")
    extra_match = whole & more
    if extras == "last_line":
        last = F.element_at(F.col("lines"), -1)
        extra_match = extra_match & listed(F.col("std"), F.col("std_null"), last)
    return (
        with_sets.withColumn("held", held)
        .withColumns(
            {
                "full": F.coalesce(whole & ~more, F.lit(False)),
                "with_extras": F.coalesce(extra_match, F.lit(False)),
            }
        )
        .drop("lines", "held", "std_size")
    )


def with_keep_flag(matched: DataFrame, std_members: DataFrame) -> DataFrame:
    """``keep`` is False only for a full match that is a standard member marked for removal."""
    # a member who is the standard of several food groups stays one row
    named = (
        std_members.filter(F.col("name_long").isNotNull())
        .groupBy("name_long")
        .agg(F.max(F.coalesce("keep_remove", F.lit(True))).alias("keep_remove"))
    )
    return (
        matched.join(named, "name_long", "left")
        .withColumn(
            "keep", F.when(F.col("full"), F.coalesce("keep_remove", F.lit(True))).otherwise(F.lit(True))
        )
        .drop("keep_remove")
    )


def collapsed_carts(
    matched: DataFrame, label: str = STANDARD_LABEL, drop_removed: bool = False
) -> DataFrame:
    """Matched members keep shares and pickups, one label line, and their extra lines.

    A member marked for removal is printed in full; ``drop_removed`` leaves it out.
    ``order_only`` is decided here on the cart as ordered; a collapsed cart has its label
    line besides, so it never is.
    """
    cart = F.col("cart")
    kept = F.filter(cart, lambda x: x["rank"] <= 2)
    label_line = F.array(line(3, COLLAPSED_SEQ, None, label, None))
    extra = F.filter(
        cart, lambda x: (x["rank"] == 3) & ~listed(F.col("std"), F.col("std_null"), x["item_original"])
    )
    short = F.concat(kept, label_line, F.when(F.col("with_extras"), extra).otherwise(F.slice(cart, 1, 0)))
    hit = F.col("keep") & (F.col("full") | F.col("with_extras"))
    out = matched.withColumns(
        {"order_only": is_order_only_member(cart) & ~hit, "cart": F.when(hit, short).otherwise(cart)}
    )
    if drop_removed:
        out = out.filter(F.col("keep"))
    return out.drop("std", "std_null", "keep")


def apply_standards(
    carts: DataFrame,
    std_members: DataFrame,
    group_std: DataFrame,
    extras: str = "last_line",
    label: str = STANDARD_LABEL,
    drop_removed: bool = False,
) -> DataFrame:
    """Match and collapse in one pass over the carts; keeps the match flags."""
    flagged = with_keep_flag(matched_carts(carts, group_std, extras), std_members)
    return collapsed_carts(flagged, label, drop_removed)


def standard_full_match(carts: DataFrame, std_members: DataFrame, group_std: DataFrame) -> DataFrame:
    return (
        with_keep_flag(matched_carts(carts, group_std), std_members)
        .filter("full")
        .select("id", F.col("keep").alias("keep_remove"))
    )


def standard_with_extras(carts: DataFrame, group_std: DataFrame, extras: str = "last_line") -> DataFrame:
    """(id, item_original): the distinct extra lines of members who match with extras."""
    hits = matched_carts(carts, group_std, extras).filter("with_extras")
    tokens = F.array_distinct(F.transform(of_rank(F.col("cart"), 3), lambda x: x["item_original"]))
    extra = F.filter(tokens, lambda t: ~listed(F.col("std"), F.col("std_null"), t))
    return hits.select("id", F.explode(extra).alias("item_original"))


def standard_summary(
    carts: DataFrame, std_members: DataFrame, group_std: DataFrame, extras: str = "last_line"
) -> DataFrame:
    return (
        with_keep_flag(matched_carts(carts, group_std, extras), std_members)
        .filter(F.col("full") | F.col("with_extras"))
        .select(
            "group_name",
            "name_long",
            F.col("keep").alias("in_printout"),
            F.col("with_extras").alias("extra_items"),
        )
        .distinct()
    )


def flag_standard_items(lines: DataFrame, std_flags: DataFrame) -> DataFrame:
    """Left join of the per-group flags; a missing item matches a missing item."""
    return join_on_keys(lines, std_flags, ["item", "group_name"], "left")
