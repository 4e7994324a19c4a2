"""Whole-file text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pokerlake.session import listing_by_cores


def base_name(path: Column) -> Column:
    """Last part of a file path."""
    return F.regexp_extract(path, "[^/]+$", 0)


def envelope(files: DataFrame) -> DataFrame:
    """raw_content, file_name, file_path and ingested_at of whole-text rows."""
    return files.select(
        F.col("value").alias("raw_content"),
        F.col("_metadata.file_path").alias("file_path"),
        F.current_timestamp().alias("ingested_at"),
    ).select("raw_content", base_name(F.col("file_path")).alias("file_name"), "file_path", "ingested_at")


def read_text_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Batch read of a folder, one row per file."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    with listing_by_cores(spark):
        return envelope(reader.load(path))


#: White space as ``\s`` has it.
BLANKS = " \t\n\x0b\f\r"
#: Fixed value: what a hand begins with, at the start of a line.
HAND_START = "Poker Hand #"


def read_hand_blocks(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row per hand text of large files: file_name, block_no, block.

    A file is read by byte ranges, record by record, a record ending where the next line begins
    with ``HAND_START``, so that neither a row nor a task grows with the file. A hand ends at its first
    blank line. ``block_no`` is the byte at which the range begins plus the number of the record
    within the task: it ascends along a file and is unique in it, but has gaps. Text in front of
    the first hand of a file becomes a block that no parser accepts; blank ones are left out.
    """
    reader = spark.read.format("text").option("lineSep", f"\n{HAND_START}").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    text = F.replace("value", F.lit("\r\n"), F.lit("\n"))
    record = F.rtrim(F.ltrim(text, F.lit(f"{BLANKS}\uFEFF")), F.lit(BLANKS))
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # counts the rows of a task
    rows = reader.load(path).select(
        base_name(F.col("_metadata.file_path")).alias("file_name"),
        (F.col("_metadata.file_block_start") + number).alias("block_no"),
        record.alias("record"),
    )
    # Only the first record of a file still has its beginning.
    whole = F.when(F.col("record").startswith(HAND_START), F.col("record")).otherwise(F.concat(F.lit(HAND_START), F.col("record")))
    block = F.rtrim(F.get(F.split(whole, "\n\n+", 2), F.lit(0)), F.lit(BLANKS))
    return rows.filter("record <> ''").select("file_name", "block_no", block.alias("block"))


def preview_text_files(spark: SparkSession, path: str, n: int, pattern: str | None = None) -> DataFrame:
    """The first n files of a folder in the order of their paths; the others are listed, not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        listed = listed.option("pathGlobFilter", pattern)
    paths = [r.path for r in listed.load(path).select("path").orderBy("path").limit(n).collect()]
    empty = read_text_files(spark, path, pattern).limit(0)
    return envelope(spark.read.format("text").option("wholetext", True).load(paths)) if paths else empty


def scan(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """Table scan; only the named columns are read."""
    table = spark.read.table(name)
    return table.select(*columns) if columns else table
