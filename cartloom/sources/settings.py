"""Settings tables: typed scan, uniqueness check, and versions changed by one pointer."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SHARES = _strings(
    "group_name", "group_name_short", "food_list_group_name", "highlight_color_hex", "highlight_color_rgb"
)
DELETES = _strings("item")
ROTATION = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("week", T.IntegerType()),
        T.StructField("season", T.StringType()),
    ]
)


def read_settings(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A settings table; the header of each CSV file must be the schema's column names."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    return reader.parquet(path)


def duplicate_keys(settings: DataFrame, *keys: str) -> DataFrame:
    """Keys held by more than one row; such rows multiply whatever joins them."""
    return settings.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def require_unique(settings: DataFrame, *keys: str) -> DataFrame:
    bad = duplicate_keys(settings, *keys).limit(5).collect()
    if bad:
        raise ValueError(f"settings hold duplicate keys: {[tuple(r) for r in bad]}")
    return settings


class StaleVersion(Exception):
    """The table has moved on since the version that a change was made from."""


class SettingsTable:
    """A settings table that is replaced by changing one pointer.

    Every version is a folder of its own that is never changed. ``_versions`` holds one small
    file per version, named by its number, with the name of the folder as text: the
    greatest number is the table. A version is written first and becomes visible by creating
    its number, which fails if another writer has taken it. So a reader sees one whole
    version or another at any time, a failed write leaves the table as it was, and of two
    writers that start from the same version one is refused. ``update`` then tries again.

    Creating a name that must not exist has to be atomic. It is on a local disk (a hard
    link), and on stores whose rename refuses an existing target, such as HDFS.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        """The numbers of all versions that are still there, in order."""
        folder = self._path("_versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The present version; 0 before the first."""
        return max(self.versions(), default=0)

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._path("_versions", f"{version:020d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the present one if none is named; no rows before the first."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._folder(version)}")

    def replace(self, rows: DataFrame, base: int) -> int:
        """Make ``rows`` the table if it still is at version ``base``; the new version.

        The rows may be read from the table itself.
        """
        if self.version() != base:
            raise StaleVersion(f"{self.path} is at version {self.version()}, not {base}")
        folder = f"data-{base + 1}-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        try:
            self._commit(base + 1, folder)
        except StaleVersion:
            self._fs.delete(self._path(folder), True)
            raise
        return base + 1

    def _commit(self, version: int, folder: str) -> None:
        target = self._path("_versions", f"{version:020d}")
        fresh = self._path("_versions", f".{folder}")
        stream = self._fs.create(fresh, False)
        stream.write(bytearray(folder.encode()))
        stream.close()
        try:
            if not self._take(fresh, target):
                raise StaleVersion(f"{self.path}: another writer made version {version}")
        finally:
            self._fs.delete(fresh, False)

    def _take(self, fresh, target) -> bool:
        """Give the written pointer its name; False if the name is taken."""
        if self._fs.getUri().getScheme() != "file":
            return bool(self._fs.rename(fresh, target))
        try:
            # a rename would replace the other file here
            os.link(*(p.toUri().getPath() for p in (fresh, target)))
        except FileExistsError:
            return False
        return True

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Replace the table by ``change(rows)``, again from the new rows if another writer was first."""
        for _ in range(tries):
            base = self.version()
            try:
                return self.replace(change(self.read(base)), base)
            except StaleVersion:
                continue
        raise StaleVersion(f"{self.path}: {tries} changes in a row were overtaken")

    def drop_old(self, keep: int = 10) -> None:
        """Delete all but the last ``keep`` versions. Readers of an older one fail from here on."""
        for version in self.versions()[:-keep] if keep > 0 else []:
            folder = self._folder(version)
            # first the name, so no version ever points to a folder that is gone
            self._fs.delete(self._path("_versions", f"{version:020d}"), False)
            self._fs.delete(self._path(folder), True)
