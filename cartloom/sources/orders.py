"""Member-order files: scan, header contract, malformed rows, row identity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.fixed_values import ORDER_HEADER
from cartloom.functions.text import trim_blanks
from cartloom.plans.ordering import running_offsets
from cartloom.plans.pinning import pin_table

RENAMES = {"pickup.site": "group_name", "first.name": "firstname", "last.name": "lastname"}
FILE_COLUMNS = ["source_file", "source_block", "source_row"]
#: Holds the text of a row that does not have the fields of the header; missing for all others.
MALFORMED = "malformed_record"


def check_header(df: DataFrame) -> DataFrame:
    """Raise unless the columns are exactly the expected header."""
    found = [c for c in df.columns if c not in FILE_COLUMNS]
    if found != ORDER_HEADER:
        raise ValueError(
            "file is not of the correct format: expected columns "
            f"{','.join(ORDER_HEADER)} but found {','.join(found)}"
        )
    return df


def read_member_orders(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Scan order CSVs. Files stay splittable unless fields hold line ends (``multi_line``).

    The first file's header is checked here, every other file's when it is read. A row
    with more or fewer fields than the header has its text in ``malformed_record``: which
    of its fields is which cannot be known, so none of them may be used.
    """
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )
    check_header(reader.csv(path))
    schema = ", ".join(f"`{c}` string" for c in [*ORDER_HEADER, MALFORMED])
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
    raw = reader.option("enforceSchema", False).schema(schema).csv(path)
    cleaned = [
        F.when(~trim_blanks(F.col(f"`{c}`")).isin("", "NA"), trim_blanks(F.col(f"`{c}`"))).alias(c)
        for c in ORDER_HEADER
    ]
    return raw.select(
        *cleaned,
        MALFORMED,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
    )


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case column names, blanks to dots, then the pipeline's own names."""
    lowered = {c: c.lower().replace(" ", ".") for c in df.columns}
    return df.withColumnsRenamed({c: RENAMES.get(n, n) for c, n in lowered.items()})


def with_row_id(df: DataFrame) -> DataFrame:
    """``id`` = 1, 2, ... in file order (0 is kept for group rows)."""
    return numbered_rows(pin_table(df)).drop(*FILE_COLUMNS, "file_row")


def numbered_rows(scan: DataFrame) -> DataFrame:
    """A written scan with ``id``, the row's number over all files, and ``file_row``, that in its file.

    The scan must be written once: where blocks begin depends on the split size of the moment, so
    counting blocks in one scan and numbering rows in another could disagree. Rows of one
    file block are contiguous in their partition, so an id is the rows of all earlier
    blocks plus the distance to the block's first row: one small row per block is summed
    up, the data itself is never sorted or windowed.
    """
    block = ["source_file", "source_block"]
    blocks = scan.groupBy(*block).agg(F.count("*").alias("rows"), F.min("source_row").alias("first_row"))
    placed = running_offsets(
        blocks.withColumn("all", F.lit(1)), ["all"], [F.col(c).asc() for c in block], "rows"
    ).select(*block, "first_row", "before")
    files = placed.groupBy("source_file").agg(F.min("before").alias("before_file"))
    number = F.col("before") + F.col("source_row") - F.col("first_row") + 1
    missing = F.raise_error(F.lit("a row of the scan has no file block")).cast("long")
    return (
        scan.join(placed.join(files, "source_file"), block, "left")
        .withColumn("id", F.when(number.isNull(), missing).otherwise(number))
        .withColumn("file_row", F.col("id") - F.col("before_file"))
        .drop("first_row", "before", "before_file")
    )


@dataclass
class OrderFiles:
    """``members`` (group_name, firstname, lastname, order, id) and ``quarantined`` (source_file, file_row, record).

    Every row of the files is in exactly one of the two. Ids count all rows, so those of
    members do not change when a malformed row is mended in its place.
    """

    members: DataFrame
    quarantined: DataFrame


def load_orders(spark: SparkSession, path: str, multi_line: bool = False) -> OrderFiles:
    """Order files with malformed rows set aside, by file and row."""
    rows = numbered_rows(pin_table(read_member_orders(spark, path, multi_line)))
    bad = rows.filter(F.col(MALFORMED).isNotNull())
    return OrderFiles(
        members=normalise_names(rows.filter(F.col(MALFORMED).isNull()).drop(MALFORMED, *FILE_COLUMNS, "file_row")),
        quarantined=bad.select("source_file", "file_row", F.col(MALFORMED).alias("record")),
    )


def load_members(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The members of order files; a malformed row is an error that names its file and row."""
    files = load_orders(spark, path, multi_line)
    bad = files.quarantined.orderBy("source_file", "file_row").limit(5).collect()
    if bad:
        listed = "; ".join(f"{r.source_file} row {r.file_row}: {r.record}" for r in bad)
        raise ValueError(f"rows do not have the fields of the header: {listed}")
    return files.members
