"""Pickup calendar and pickup slots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions.cart import of_rank, slot_description, slot_time
from cartloom.functions.text import piece, zero_pad_week
from cartloom.operators.lines import each_line


def pickup_dates(rotation: DataFrame, extra_days: int = 2) -> DataFrame:
    """Every rotation date with the pickup days that follow it."""
    offsets = F.array(*[F.lit(d) for d in range(extra_days + 1)])
    return (
        rotation.select("date")
        .distinct()
        .withColumn("day", F.explode(offsets))
        .select("date", F.date_add("date", F.col("day")).alias("date_all"))
    )


def pickup_calendar(rotation: DataFrame) -> DataFrame:
    weeks = rotation.select("date", "week", "season").distinct()
    return (
        pickup_dates(rotation)
        .join(weeks, "date", "left")
        .select("date", "date_all", zero_pad_week(F.col("week")).alias("week"), "season")
    )


def calendar_gaps(rotation: DataFrame) -> DataFrame:
    """Days between the first and the last pickup day on which nobody picks up."""
    days = pickup_dates(rotation).select("date_all").distinct()
    span = days.agg(F.min("date_all").alias("lo"), F.max("date_all").alias("hi"))
    every_day = span.select(F.explode(F.sequence("lo", "hi")).alias("all_dates"))
    return every_day.join(days, every_day.all_dates == days.date_all, "left_anti")


def run_of(calendar: DataFrame, day: dt.date) -> dict:
    """Week and season of a run date; an error when nobody picks up that day."""
    row = calendar.filter(F.col("date_all") == F.lit(day)).select("season", "week", "date_all").distinct().first()
    if row is None:
        raise ValueError(f"{day} is not a pickup day")
    return {"season": row.season, "week": row.week, "date": row.date_all}


def pickup_histogram(carts: DataFrame) -> DataFrame:
    counts = (
        each_line(carts, of_rank(F.col("cart"), 2))
        .groupBy(F.col("line.item").alias("item"))
        .agg(F.count("*").alias("n_lines"))
    )
    return counts.select(
        "item",
        "n_lines",
        piece(F.col("item"), " ", 0, 3).alias("q"),
        slot_time(F.col("item")).alias("time"),
        slot_description(F.col("item")).alias("description"),
    )


def in_slot_order(histogram: DataFrame) -> DataFrame:
    return histogram.orderBy(*[F.col(c).asc_nulls_last() for c in ("description", "time", "q")])


def first_pickup_slot(carts: DataFrame) -> DataFrame:
    # an optional one-element array instead of a filter, which would parse the order again
    slot = F.when(F.col("time_descr").isNotNull(), F.array(F.struct("time_descr", "description", "time")))
    return each_line(carts, slot, "id").select("id", "line.*")


def multi_pickup_members(carts: DataFrame) -> DataFrame:
    """Members with more than one pickup line, one row per distinct slot."""
    slots = carts.select("name_long", of_rank(F.col("cart"), 2).alias("slots"))
    count = F.size("slots").cast("long")
    distinct = F.array_distinct(F.transform("slots", lambda x: F.struct(x["item"], count.alias("n_pickups"))))
    several = F.when(F.size("slots") > 1, distinct)
    return each_line(slots, several, "name_long").select("name_long", "line.item", "line.n_pickups")
