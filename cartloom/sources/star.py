"""Adapter: the star-schema test tables as member orders and settings.

Each order becomes one member row with a packed order text; nations are the
groups and regions the food groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.fixed_values import ORDER_ONLY_ITEMS


# columns read from each table
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int",
    "part": "p_partkey bigint, p_name string, p_brand string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def packed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item tokens of each order, packed as the order files hold them: the text is one field
    of one record, so an order is bounded by what a record can hold."""
    fields = "l_linenumber, l_partkey, l_suppkey"
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")
    )
    kind = "if(endswith(p_name, ' plate'), '1 Pot Plant - ', '1 Each ')"
    token = f"concat(1 + l_linenumber % 2, 'x', {kind}, p_name) AS token"
    # lines of an order are scattered over the table, so collecting before the shuffle gains nothing;
    # tokens are longer than names, so they are made behind it
    return (
        lines.selectExpr("l_orderkey", *fields.split(", "), "p_name")
        .repartition("l_orderkey")
        .selectExpr("l_orderkey", f"struct({fields}, {token}) AS t")
        .groupBy("l_orderkey")
        .agg(F.expr("array_join(sort_array(collect_list(t)).token, ', ') AS items"))
    )


def member_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_name, firstname, lastname, order, id) as the order files hold them.

    Some sites are home deliveries, some orders are missing, end in a comma, or hold no
    or two pickup slots or an order-only token.
    """
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .join(packed_items(spark, sf_dir), F.expr("o_orderkey = l_orderkey"), "left")
    )
    hour = "4 + o_orderkey % 3"
    detail = "if(o_orderkey % 50 = 7, 'none', right(n_name, 4))"
    number = "split_part(c_name, '#', 2)"
    return joined.selectExpr(
        """if(n_nationkey % 7 = 0, concat('Home Delivery - Zone ', n_name, ' '), n_name) AS group_name""",
        """if(c_custkey % 501 <> 9, split_part(c_name, '#', 1), NULL) AS firstname""",
        rf"""concat(if(o_orderkey % 20 = 3, '\t', ''), {number},
            if(n_nationkey % 7 = 0, concat(' ', {detail}), '')) AS lastname""",
        f"""if(o_orderkey % 1009 <> 5, concat(concat_ws(', ',
            concat('1 ', c_mktsegment),
            if(o_orderkey % 10 <> 0, concat('1x', left(o_orderpriority, 1), ' @', {hour}, '-', {hour}, ':30 ',
                r_name, ' Pickup Time'), NULL),
            if(o_orderkey % 10 = 1, concat('1x9 @3-3:30 ', r_name, ' Pickup Time'), NULL),
            CASE WHEN o_orderkey % 11 = 0 THEN
                if(o_orderkey % 2 = 0, '{ORDER_ONLY_ITEMS[0]}', '{ORDER_ONLY_ITEMS[3]}') END,
            items), if(o_orderkey % 13 = 4, ',', '')), NULL) AS `order`""",
        "o_orderkey + 1 AS id",
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record): member orders as lines of an order file, some of them ragged.

    Some orders miss their quotes, so each of their tokens is a field; some end after the first name.
    """
    site_and_name = "concat_ws(',', group_name, coalesce(firstname, ''))"
    named = f"concat({site_and_name}, ',', lastname, ',')"
    return member_orders(spark, sf_dir).selectExpr(
        f"""CASE WHEN id % 41 = 3 THEN concat({named}, coalesce(`order`, ''))
            WHEN id % 43 = 5 THEN {site_and_name}
            ELSE concat({named}, '"', coalesce(`order`, ''), '"') END AS record"""
    )


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings per group: short name, food group, colours."""
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr(
            "if(n_nationkey % 7 = 0, concat('Home Delivery - ', right(n_name, 4)), n_name) AS group_name",
            "CASE n_nationkey % 4 WHEN 1 THEN concat('N', n_nationkey) WHEN 2 THEN '' END AS group_name_short",
            "r_name AS food_list_group_name",
            """if(n_nationkey % 6 <> 5, concat('#', right(concat('000000', n_nationkey * 12345), 6)), NULL)
                AS highlight_color_hex""",
            """concat('rgb(', n_nationkey * 10, ', ', n_nationkey, ', ', 255 - n_nationkey, ')')
                AS highlight_color_rgb""",
        )
    )


def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, week, season): the Wednesday of every week that has an order."""
    wednesday = F.date_add(F.date_trunc("week", "o_orderdate").cast("date"), 2)
    dates = table(spark, sf_dir, "orders").select(wednesday.alias("date")).distinct()
    season = F.concat(
        F.when(F.month("date") <= 6, "A").otherwise("B"), F.year("date").cast("string")
    )
    return dates.select("date", F.weekofyear("date").alias("week"), season.alias("season"))
