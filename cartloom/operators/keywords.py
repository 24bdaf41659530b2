"""Keyword lookup and colour parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions.fixed_values import LOOKUP_WORDS
from cartloom.functions.text import rgb_part


def keyword_lookup(
    names: DataFrame, keywords: DataFrame, words: Sequence[str] = LOOKUP_WORDS
) -> DataFrame:
    """Names (name, emoji) with all their keywords, kept when the list holds one of the words.

    ``keywords`` has (keyword, name_list), the list comma-packed.
    """
    pairs = keywords.select("keyword", F.explode(F.split("name_list", ",")).alias("name")).distinct()
    lists = (
        names.join(pairs, "name", "left")
        .groupBy("name", "emoji")
        .agg(
            F.array_join(
                F.sort_array(F.collect_list(F.coalesce("keyword", F.lit("NA")))), ","
            ).alias("keyword_list")
        )
    )
    return lists.filter(F.col("keyword_list").rlike("|".join(words)))


def rgb_parse(colours: DataFrame, column: str = "highlight_color_rgb") -> DataFrame:
    text = F.col(column)
    return colours.select(
        "*", rgb_part(text, 1).alias("red"), rgb_part(text, 2).alias("green"), rgb_part(text, 3).alias("blue")
    )
