"""Labels and cell styles by text rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.fixed_values import FORMAT_RULES, LABEL_RULES
from cartloom.operators.members import shares_by_short_name
from cartloom.operators.rule_index import rule_hits
from cartloom.plans.ordering import join_on_keys

LABEL_SCHEMA = "match_name string, text_name string, freeform_text string, emoji_name string, row_num int"
FORMAT_SCHEMA = "match_name string, text_name string, format_name string, color_name string, row_num int"


# what a cell holds; its other columns say where it is
CELL_CONTENT = {
    "id", "n", "rank", "quantity", "item", "standard_item", "name_long", "lastname", "firstname",
    "symbol_text", "item_symbol", "label",
}


def cell_place(cells: DataFrame) -> list[str]:
    """Run columns, group, page, row and column."""
    return [c for c in cells.columns if c not in CELL_CONTENT]


def _numbered(rules: Sequence[tuple]) -> list[tuple]:
    return [(*rule, at) for at, rule in enumerate(rules, 1)]


def label_rules(spark: SparkSession, rules: Sequence[tuple] = LABEL_RULES) -> DataFrame:
    return spark.createDataFrame(_numbered(rules), LABEL_SCHEMA)


def format_rules(spark: SparkSession, rules: Sequence[tuple] = FORMAT_RULES) -> DataFrame:
    return spark.createDataFrame(_numbered(rules), FORMAT_SCHEMA)


def item_symbols(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(item, symbol_text): the texts of all matching rules, sorted and pasted together.

    Rules meet distinct items, not lines. Equal texts of several rules all stay.
    """
    items = lines.filter(F.col("item").isNotNull()).select("item").distinct()
    emoji, text = F.col("emoji_name"), F.col("freeform_text")
    symbol = F.when(
        emoji.isNotNull() | text.isNotNull(),
        F.concat(F.coalesce(emoji, F.lit("")), F.coalesce(text, F.lit(""))),
    )
    texts = rules.withColumn("symbol", symbol).filter(F.col("symbol").isNotNull())
    return (
        rule_hits(items, texts, ["symbol"])
        .groupBy("item")
        .agg(F.array_join(F.sort_array(F.collect_list("symbol")), "").alias("symbol_text"))
    )


def item_label(quantity: Column, item: Column, symbol_text: Column) -> Column:
    """``+`` when the quantity text sorts after '1', the symbols, then ``quantity x item``."""
    qty = F.coalesce(quantity, F.lit(""))
    text = F.coalesce(item, F.lit(""))
    return F.concat(
        F.when(qty > F.lit("1"), "+").otherwise(""),
        F.coalesce(symbol_text, F.lit("")),
        F.when(qty == "", text).otherwise(F.concat(qty, F.lit("x"), text)),
    )


def labelled(cells: DataFrame, symbols: DataFrame) -> DataFrame:
    """Cells with ``item_symbol``."""
    joined = _with_items(cells, symbols)
    return joined.withColumn("item_symbol", item_label(F.col("quantity"), F.col("item"), F.col("symbol_text")))


def _with_items(cells: DataFrame, named: DataFrame) -> DataFrame:
    """Cells with the columns of their item. There is a blank cell per member, and blank cells
    match nothing, so they take no part in the join, where all of them would share one key."""
    filled = cells.filter(F.col("item").isNotNull()).join(named, "item", "left")
    blank = cells.filter(F.col("item").isNull())
    return filled.unionByName(blank, allowMissingColumns=True)


def with_run_suffix(cells: DataFrame, run: dict) -> DataFrame:
    """Group headers say which run they belong to; a blank row has no label.

    ``run`` has season, week and date, as values or, for several runs, as columns.
    """

    def part(name: str) -> Column:
        value = run[name]
        return (value if isinstance(value, Column) else F.lit(str(value))).cast("string")

    suffix = F.concat(F.lit(" ("), part("season"), F.lit("w"), part("week"), F.lit(" - "), part("date"), F.lit(")"))
    rank = F.col("rank")
    return cells.withColumn(
        "label", F.when(rank == -1, F.concat("item_symbol", suffix)).when(rank.isNotNull(), F.col("item_symbol"))
    )


def cell_group_colour(cells: DataFrame, shares: DataFrame) -> DataFrame:
    """Header and name cells of groups that have a colour: filled, bold, centred."""
    colours = shares_by_short_name(shares).filter(F.col("highlight_color_hex").isNotNull())
    return (
        cells.filter(F.col("rank") <= 0)
        .join(colours.select("group_name", "highlight_color_hex"), "group_name")
        .select(
            *cell_place(cells), "highlight_color_hex",
            F.lit("bold").alias("text_decoration"), F.lit("center").alias("halign"),
        )
    )


def cell_standard_bold(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("standard_item").isNotNull()).select(
        *cell_place(cells), "item", F.lit("bold").alias("text_decoration")
    )


def item_formats(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """(item, format_name, color_name, row_num) of the last matching rule of each item."""
    items = cells.filter(F.col("item").isNotNull()).select("item").distinct()
    useful = rules.filter(F.col("format_name").isNotNull() | F.col("color_name").isNotNull())
    last = F.max(F.struct("row_num", "format_name", "color_name")).alias("last")
    return (
        rule_hits(items, useful, ["row_num", "format_name", "color_name"])
        .groupBy("item")
        .agg(last)
        .select("item", "last.format_name", "last.color_name", "last.row_num")
    )


def cell_format_rules(cells: DataFrame, formats: DataFrame) -> DataFrame:
    """Cells a format rule styles; the last rule replaces earlier ones and the centring."""
    return cells.join(formats, "item").select(
        *cell_place(cells), "item", "format_name", "color_name"
    )


def cell_styles(cells: DataFrame, shares: DataFrame, formats: DataFrame) -> DataFrame:
    """One style row per styled cell: conditional fill and bold, then the static style on top."""
    colours = shares_by_short_name(shares).select("group_name", F.col("highlight_color_hex").alias("group_hex"))
    with_colour = join_on_keys(cells, colours, ["group_name"], "left")
    joined = _with_items(with_colour, formats)
    hex_colour = F.when(F.col("rank") <= 0, F.col("group_hex"))
    styled = F.col("row_num").isNotNull()
    out = joined.select(
        *cell_place(cells),
        hex_colour.alias("fill_if_text"),
        (hex_colour.isNotNull() | F.col("standard_item").isNotNull()).alias("bold_if_text"),
        F.when(~styled & hex_colour.isNotNull(), "center").alias("halign"),
        F.col("format_name").alias("text_decoration"),
        F.col("color_name").alias("fill"),
    )
    return out.filter(
        F.col("fill_if_text").isNotNull() | F.col("bold_if_text")
        | F.col("text_decoration").isNotNull() | F.col("fill").isNotNull()
    )
