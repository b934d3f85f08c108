"""Aggregates that maintenance commands need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_only_violations(versions: DataFrame, key: str, tombstone: Column) -> DataFrame:
    """(dups, tombs): records beyond the first of their key, and tombstones. Both may be shuffled combined."""
    by = versions.groupBy(key).agg(F.count_if(~tombstone).alias("n"), F.count_if(tombstone).alias("t"))
    return by.agg(
        F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("long").alias("dups"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("tombs")
    )


def segment_stats(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """(records, bytes, sha256) of the lines of each segment, as they are written.

    A segment is one file, so its lines meet in one row here; split segments by size first.
    """
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n"), F.lit("\n"))
    return lines.groupBy(*by).agg(
        F.count_if(F.trim(F.col(line)) != "").alias("records"), F.sum(F.octet_length(line) + 1).alias("bytes"), F.sha2(text, 256).alias("sha256")
    )


def validity(classified: DataFrame, key: str, order: Column) -> DataFrame:
    """(valid, bad): live records and bad lines, from one pass over the lines and one exchange by key."""
    bad = F.count_if(F.col("reason").isNotNull())
    good = F.col("readable") & ~F.col("tombstone") & F.col("reason").isNull()
    by = classified.groupBy(key).agg(
        F.max(F.when(F.col("readable") & F.col("tombstone"), order)).alias("cut"), F.max(F.when(good, order)).alias("last"), bad.alias("bad")
    )
    live = F.col("last").isNotNull() & (F.col("cut").isNull() | (F.col("last") > F.col("cut")))
    return by.agg(F.count_if(live).alias("valid"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
