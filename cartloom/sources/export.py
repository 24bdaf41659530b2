"""Tabular export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.functions.fixed_values import PAGE_ROWS


def export_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def export_sheet(
    sheet: DataFrame,
    path: str,
    fmt: str = "parquet",
    max_rows: int = PAGE_ROWS,
    run_cols: Sequence[str] = (),
    in_order: bool = False,
) -> DataFrame:
    """Write a sheet as files in the order of its rows, and return the manifest.

    Below ``path``, ``rows`` holds the files and ``manifest`` one row per file and run: ``file``,
    ``first_row``, ``last_row``, ``n_rows``. Files read in the order of the manifest are the sheet from
    top to bottom. They are cut by ranges of pages, so no page is in two files, and no task
    sorts more than its range, however long the sheet is. With ``in_order`` the sheet comes cut and
    sorted like that, as from numbered places, and no row moves again.
    """
    page = F.expr(f"(sheet_row - 1) div {max_rows}")
    runs = [F.col(c).asc_nulls_last() for c in run_cols]
    # a range keeps rows of one page together: its number is the whole key
    ranged = sheet
    if not in_order:
        ranged = sheet.repartitionByRange(*runs, page.asc()).sortWithinPartitions(*runs, F.col("sheet_row").asc())
    base = path.rstrip("/")
    export_table(ranged, f"{base}/rows", fmt)
    written = _rows(sheet.sparkSession, f"{base}/rows", sheet.schema, fmt)
    found = written.groupBy(F.col("_metadata.file_name").alias("file"), *run_cols).agg(
        F.min("sheet_row").alias("first_row"), F.max("sheet_row").alias("last_row"), F.count("*").alias("n_rows")
    )
    # one row per file
    found.coalesce(1).sortWithinPartitions(*runs, "first_row").write.parquet(f"{base}/manifest")
    return sheet.sparkSession.read.parquet(f"{base}/manifest")


def _rows(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_sheet(
    spark: SparkSession, path: str, schema: T.StructType, first_row: int, last_row: int, fmt: str = "parquet"
) -> DataFrame:
    """Rows of a written sheet by number, read only from the files that hold them."""
    base = path.rstrip("/")
    manifest = spark.read.parquet(f"{base}/manifest").filter((F.col("last_row") >= first_row) & (F.col("first_row") <= last_row))
    files = sorted({f"{base}/rows/{r.file}" for r in manifest.select("file").collect()})
    if not files:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    found = reader.option("header", True).option("escape", '"').csv(files) if fmt == "csv" else reader.format(fmt).load(files)
    return found.filter(F.col("sheet_row").between(first_row, last_row))
