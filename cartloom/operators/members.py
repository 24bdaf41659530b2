"""One row per member: cleaning, checks, carts and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions.cart import first_slot, parse_cart
from cartloom.functions.fixed_values import HOME_DELIVERY_MARK, HOME_DELIVERY_PREFIX
from cartloom.functions.text import name_with_id, remove_first, trim_blanks
from cartloom.plans.ordering import join_on_keys


def home_delivery_details(members: DataFrame) -> DataFrame:
    """Trimmed names plus the delivery detail as the group and the last name state it."""
    trimmed = members.withColumns(
        {"group_name": trim_blanks(F.col("group_name")), "lastname": trim_blanks(F.col("lastname"))}
    )
    is_home = F.col("group_name").contains(HOME_DELIVERY_MARK)
    return trimmed.withColumns(
        {
            "pickup_detail_v1": F.when(is_home, F.right("group_name", F.lit(4))),
            "pickup_detail_v2": F.when(is_home, F.right("lastname", F.lit(4))),
        }
    )


def home_delivery_check(members: DataFrame) -> DataFrame:
    """Members whose two details differ. A report only: the flow goes on."""
    return (
        home_delivery_details(members)
        .filter(F.col("pickup_detail_v1") != F.col("pickup_detail_v2"))
        .select("group_name", "firstname", "lastname", "pickup_detail_v1", "pickup_detail_v2")
    )


def normalise_home_delivery(members: DataFrame) -> DataFrame:
    detail = F.col("pickup_detail_v1")
    shortened = trim_blanks(remove_first(F.col("lastname"), detail))
    return (
        home_delivery_details(members)
        .withColumn("lastname", F.when(detail.isNotNull(), shortened).otherwise(F.col("lastname")))
        .withColumn(
            "group_name",
            F.when(detail.isNotNull(), F.concat(F.lit(HOME_DELIVERY_PREFIX), detail)).otherwise(
                F.col("group_name")
            ),
        )
        .drop("pickup_detail_v1", "pickup_detail_v2")
    )


def group_check(members: DataFrame, shares: DataFrame) -> DataFrame:
    """Members whose group is missing from the settings."""
    known = shares.select(F.col("group_name").alias("known_group")).distinct()
    return members.join(
        known, F.col("group_name").eqNullSafe(F.col("known_group")), "left_anti"
    ).select("group_name", "firstname", "lastname")


def require_known_groups(members: DataFrame, shares: DataFrame) -> DataFrame:
    """Stop when a group is unknown, naming a few of the groups."""
    unknown = group_check(members, shares).select("group_name").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"groups missing from the settings: {[r.group_name for r in unknown]}")
    return members


def short_or_long(long_name, short_name):
    return F.coalesce(F.nullif(short_name, F.lit("")), long_name)


def named_groups(members: DataFrame, shares: DataFrame) -> DataFrame:
    """Members under the short names of their groups; ``known_group`` tells those in the settings."""
    names = shares.select("group_name", "group_name_short").distinct().withColumn("known_group", F.lit(True))
    joined = join_on_keys(members, names, ["group_name"], "left")
    return joined.withColumns({
        "group_name": short_or_long(F.col("group_name"), F.col("group_name_short")),
        "known_group": F.coalesce("known_group", F.lit(False)),
    }).drop("group_name_short")


def short_group_names(members: DataFrame, shares: DataFrame) -> DataFrame:
    return named_groups(members, shares).drop("known_group")


def shares_by_short_name(shares: DataFrame) -> DataFrame:
    """Settings keyed by the name the lines carry."""
    return shares.withColumn(
        "group_name", short_or_long(F.col("group_name"), F.col("group_name_short"))
    ).drop("group_name_short")


def member_carts(members: DataFrame, quantity_only_numeric: bool = False) -> DataFrame:
    """Adds name_long, cart and the first pickup slot (time_descr, description, time).

    Columns besides the five of an order (week, site, ...) are carried along.
    """
    slot = F.col("slot")
    known = {"group_name", "firstname", "lastname", "id", "order"}
    carried = [c for c in members.columns if c not in known]
    return (
        members.withColumn("cart", parse_cart("order", quantity_only_numeric))
        .withColumn("slot", first_slot(F.col("cart")))
        .select(
            *carried,
            "group_name",
            "firstname",
            "lastname",
            "id",
            name_with_id(F.col("lastname"), F.col("firstname"), F.col("id")).alias("name_long"),
            slot["item"].alias("time_descr"),
            slot["description"].alias("description"),
            slot["time"].alias("time"),
            "cart",
        )
    )


def member_counts(members: DataFrame, name: str, run_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct members per group; members without a name count too."""
    return members.groupBy(*run_cols, "group_name").agg(
        F.countDistinct(F.struct("firstname", "lastname")).alias(name)
    )


def reconciliation(start: DataFrame, end: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Start and end counts side by side; a group missing on one side has no difference."""
    left, right = start.alias("s"), end.alias("e")
    keys = [*run_cols, "group_name"]
    same = reduce(and_, [F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
    return left.join(right, same, "full").select(
        *[F.coalesce(f"s.{k}", f"e.{k}").alias(k) for k in keys],
        "n_start",
        "n_end",
        (F.col("n_end") - F.col("n_start")).alias("difference"),
    )
