"""CSV rows in the order of their files, first-row de-duplication, and writing in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.blocks import positions
from barloom.operators.normalize import keep_first_rows

POSITION = "__position"


def read_rows(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns of CSV files with a header as text, and the ``POSITION`` of each row over all files by name: splits are
    counted, and a prefix sum over them shifts the numbers inside a split. ``multiline`` reads files with line breaks in
    quotes, whole files at a time."""
    options = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": multiline, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    rows = spark.read.options(**options).csv(path)
    names = rows.columns
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row"))
    return positions(rows, [], F.struct("__file", "__start"), ["__row"], POSITION).select(*names, POSITION)


def distinct_rows(rows: DataFrame) -> DataFrame:
    """The first of equal rows, with its ``POSITION``."""
    return keep_first_rows(rows, POSITION)


def write_rows(rows: DataFrame, path: str) -> None:
    """In the order of ``POSITION``: ranges of it are the part files, in the order of their names, each with the header."""
    names = [c for c in rows.columns if c != POSITION]
    rows.orderBy(POSITION).select(*names).write.options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def remove_duplicates(spark: SparkSession, source: str, target: str, multiline: bool = False) -> None:
    """``source`` without its repeated rows, in order."""
    write_rows(distinct_rows(read_rows(spark, source, multiline)), target)
