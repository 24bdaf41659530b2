"""Four-way text match used by label and format rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_TYPES = ("equal", "contains", "starts with", "ends with")


def text_match(item: Column, match: str, text: str) -> Column:
    """Match against a known rule; ``contains`` is a case-sensitive pattern, the rest is literal."""
    if match == "equal":
        hit = item == text
    elif match == "contains":
        hit = item.rlike(text)
    elif match == "starts with":
        hit = item.startswith(text)
    elif match == "ends with":
        hit = item.endswith(text)
    else:
        return F.lit(False)
    return F.coalesce(hit, F.lit(False))


def text_match_columns(item: Column, match: Column, text: Column) -> Column:
    """The same match with the rule held in columns."""
    hit = (
        F.when(match == "equal", item == text)
        .when(match == "contains", F.rlike(item, text))
        .when(match == "starts with", F.startswith(item, text))
        .when(match == "ends with", F.endswith(item, text))
    )
    return F.coalesce(hit, F.lit(False))
