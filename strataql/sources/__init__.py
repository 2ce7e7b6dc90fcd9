"""Readers and writers: CSV, scripts, SQLite files, folders and zip archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import FolderSource, SqliteSource, ZipSource, write_sqlite

__all__ = ["read_csv", "read_folder", "register_sources", "write_output", "write_sqlite"]


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    """A CSV file as a table; values that look like numbers make numeric columns."""
    return spark.read.csv(path, header=header, inferSchema=True, sep=delimiter, multiLine=False, enforceSchema=False)


def read_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, modified, size, data) of the files below a folder, by the distributed binary reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").alias("data"))


def register_sources(spark: SparkSession) -> None:
    """Formats ``folder`` (fsdir), ``zipfile`` and ``sqlite``, with column pruning and pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FolderSource, ZipSource, SqliteSource):
        spark.dataSource.register(source)


def write_output(df: DataFrame, path: str, mode: str = "json") -> None:
    """Results as json lines, csv with a header, or lines of name = value."""
    if mode == "json":
        df.write.json(path)
    elif mode == "csv":
        df.write.csv(path, header=True)
    elif mode == "line":
        parts = [F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n")) for c in df.columns]
        df.select(F.concat(*parts).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown output mode: {mode}")
