"""Log files as rows: one physical line each, with its place.

A line ends at a line feed and nowhere else. ``scan`` adds no shuffle: a line's place is
(file, block, row), which orders the lines of a file as they stand in it. ``positions`` adds
exact byte offsets and line numbers by sums within a block and over blocks: lines meet in
groups of one input block, never all lines of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, block, row, raw, size) of every line; size: bytes without the line feed."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("raw"),
        F.octet_length("value").cast("long").alias("size"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def positions(lines: DataFrame) -> DataFrame:
    """scan() with offset (bytes before the line), line (from 1) and torn (no line feed ends it)."""
    within = Window.partitionBy("file", "block").orderBy("row")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum(F.col("size") + 1).alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "file", "block",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("line0"),
    )
    placed = lines.withColumn("at", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0))).withColumn("nth", F.row_number().over(within))
    return placed.join(blocks, ["file", "block"]).select(
        "file", "block", "row", "raw", "size",
        (F.col("byte0") + F.col("at")).alias("offset"),
        (F.col("line0") + F.col("nth")).alias("line"),
        (F.col("byte0") + F.col("at") + F.col("size") + 1 > F.col("file_size")).alias("torn"),
    )


def tail(lines: DataFrame, start: int) -> DataFrame:
    """The lines of positions() from a byte offset on; what lies before isn't counted: line is null."""
    return lines.where(F.col("offset") >= start).withColumn("line", F.lit(None).cast("long"))
