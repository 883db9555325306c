"""File scans and sinks.

A directory tree of note files (``*.txt``) or annotation files (``*.xmi``) is read with one
distributed scan; every file becomes one row (``wholetext``), so files are spread over tasks
and no listing or reading goes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import note_body


def _file_name() -> F.Column:
    # _metadata.file_name is URL-encoded; '+' stays literal in file names.
    raw = F.col("_metadata.file_name")
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def scan_text_files(spark: SparkSession, paths: str | Sequence[str], pattern: str) -> DataFrame:
    """Recursive whole-file scan: ``name, path, value``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
          .text(paths, wholetext=True))
    return df.select(_file_name().alias("name"), F.col("_metadata.file_path").alias("path"), "value")


def scan_notes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """S1 + S2: ``file, round, note_des`` from ``*.txt`` files (round = parent folder)."""
    df = scan_text_files(spark, paths, "*.txt")
    return df.select(F.col("name").alias("file"), _parent(F.col("path")).alias("round"),
                     note_body(F.col("value")).alias("note_des"))


def scan_xmi(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """S3: ``xmi, round, content`` with the first physical line of each ``*.xmi`` file."""
    df = scan_text_files(spark, paths, "*.xmi")
    first_line = F.get(F.split(F.col("value"), r"\r\n|\r|\n"), 0)  # text mode ends a line at each of these
    return df.select(F.col("name").alias("xmi"), _parent(F.col("path")).alias("round"),
                     first_line.alias("content"))


def _parent(path: F.Column) -> F.Column:
    parts = F.split(path, "/")
    return F.get(parts, F.size(parts) - 2)


def union_rounds(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)


def read_exclusions(spark: SparkSession, paths: str | Sequence[str], header: bool = True, sep: str = ",") -> DataFrame:
    """The exclusion list, one ``mrn`` per row: the first column of one or more delimited files.

    Values are compared as text, without the spaces around them; empty ones and repeats are left out.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.option("header", header).option("sep", sep).option("inferSchema", False).csv(paths)
    if not rows.columns:
        return spark.createDataFrame([], "mrn string")
    mrn = F.trim(F.col(f"`{rows.columns[0]}`"))
    return rows.select(mrn.alias("mrn")).where(F.col("mrn") != "").distinct()
