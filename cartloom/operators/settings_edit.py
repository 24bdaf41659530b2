"""Edits of settings-sized tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.plans.ordering import running_offsets


def append_distinct(settings: DataFrame, new_rows: DataFrame) -> DataFrame:
    return settings.unionByName(new_rows).distinct()


def remove_item(settings: DataFrame, item: str) -> DataFrame:
    """The list without ``item`` and without missing entries."""
    return settings.filter(F.col("item").isNotNull() & (F.col("item") != item)).distinct()


def upsert_standard_member(
    std_members: DataFrame, food_group: str, name_long: str | None, keep: bool | None
) -> DataFrame:
    """Replace the row of one food group; a group that is not listed stays absent."""
    here = F.col("food_list_group_name") == food_group
    changed = std_members.filter(here).select(
        "food_list_group_name",
        F.lit(name_long).cast("string").alias("name_long"),
        F.lit(keep).cast("boolean").alias("keep_remove"),
    )
    return std_members.filter(~here).unionByName(changed)


def clear_standard_member(std_members: DataFrame, food_group: str) -> DataFrame:
    return upsert_standard_member(std_members, food_group, None, None)


def renumbered(rules: DataFrame) -> DataFrame:
    """``row_num`` 1, 2, ... again after an edit, in the old order."""
    counted = rules.withColumns({"__all": F.lit(1), "__one": F.lit(1)})
    placed = running_offsets(counted, ["__all"], [F.col("row_num").asc()], "__one")
    return placed.withColumn("row_num", (F.col("before") + 1).cast("int")).select(*rules.columns)


def add_rule(rules: DataFrame, new_rule: DataFrame) -> DataFrame:
    """Append a rule unless an equal one exists; the earlier copy keeps its place."""
    last = rules.agg(F.max("row_num")).first()[0] or 0
    added = new_rule.withColumn("row_num", F.lit(last + 1))
    content = [c for c in rules.columns if c != "row_num"]
    merged = rules.unionByName(added).groupBy(*content).agg(F.min("row_num").alias("row_num"))
    return renumbered(merged)


def remove_rule(rules: DataFrame, row_num: int) -> DataFrame:
    content = [c for c in rules.columns if c != "row_num"]
    left = rules.filter(F.col("row_num") != row_num)
    return renumbered(left.groupBy(*content).agg(F.min("row_num").alias("row_num")))
