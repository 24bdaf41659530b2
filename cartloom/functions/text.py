"""Text expressions whose missing-value behaviour is fixed on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_CHARS = "\t\r\n "


def trim_blanks(text: Column) -> Column:
    """Strip blanks, tabs and line ends (plain ``trim`` strips blanks only)."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def na_text(text: Column) -> Column:
    """A missing value prints as the text ``NA`` when names are pasted together."""
    return F.coalesce(text.cast("string"), F.lit("NA"))


def name_text(lastname: Column, firstname: Column) -> Column:
    return F.concat(na_text(lastname), F.lit(", "), na_text(firstname))


def name_with_id(lastname: Column, firstname: Column, member_id: Column) -> Column:
    return F.concat(name_text(lastname, firstname), F.lit(" ["), member_id.cast("string"), F.lit("]"))


def remove_first(text: Column, part: Column) -> Column:
    """``text`` without the first literal occurrence of ``part``."""
    at = F.instr(text, part)
    return F.when(
        at > 0,
        F.concat(F.substring(text, F.lit(1), at - 1), F.substr(text, at + F.length(part))),
    ).otherwise(text)


def zero_pad_week(week: Column) -> Column:
    text = week.cast("string")
    return F.when(F.length(text) == 1, F.concat(F.lit("0"), text)).otherwise(text)


def piece(text: Column, sep: str, at: int, limit: int) -> Column:
    """Piece ``at`` (0-based) of ``text``; missing pieces are NULL, the last one keeps the rest."""
    return F.get(F.split(text, sep, limit), F.lit(at))


def rgb_part(text: Column, at: int) -> Column:
    """Component ``at`` (1-3) of ``rgb(r, g, b)`` as a fraction of 255."""
    number = r"(\d+)"
    pattern = r"rgb\(\s*" + r"\s*,\s*".join([number] * 3) + r"\s*\)"
    found = F.regexp_extract(text, pattern, at)
    return F.when(found != "", found.cast("int") / F.lit(255.0))
