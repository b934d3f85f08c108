"""The fold: current records of a log, the last valid version of each key.

A version table has a key, an order (unique within a key), a tombstone flag and, for the
fold proper, a validity flag. A record is live if a valid version follows its key's last
tombstone; it is the latest such version, and its place (``pos``) is the earliest such one.
An invalid version hides nothing. Without the validity flag the same is the index fold: the
last readable version wins, valid or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractlog import scratch


def fold(versions: DataFrame, key: list[str] | str, order: Column, tombstone: Column, columns: list[str], valid: Column | None = None) -> DataFrame:
    """(key columns, columns, last, pos) of live records. No task meets all versions of a key.

    The last tombstone of each key is a maximum, combined before it is shuffled; versions
    before it go by a join that adaptive execution can split; the rest is an aggregate that is
    combined before it is shuffled as well. So a key with a third of the log costs no more than
    others. versions is read twice: settle it first (see contractlog.scratch) if it is costly.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = versions.withColumn("_at", order).withColumn("_gone", tombstone).withColumn("_fine", F.lit(True) if valid is None else valid)
    cuts = rows.where("_gone").groupBy(*keys).agg(F.max("_at").alias("_cut"))
    live = rows.where(~F.col("_gone") & F.col("_fine")).join(cuts, keys, "left").where(F.col("_cut").isNull() | (F.col("_at") > F.col("_cut")))
    by = live.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_at").alias("_rec"), F.max("_at").alias("last"), F.min("_at").alias("pos"))
    return by.select(*keys, *[F.col(f"_rec.{c}").alias(c) for c in columns if c not in keys], "last", "pos")


def numbered(rows: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """rows with their place, from 1, in an order that no two share: ranges are sorted apart and then counted.

    The ranges are settled before they are counted, as a second sampling could cut them otherwise.
    """
    placed = rows.repartitionByRange(order).sortWithinPartitions(order)
    placed = scratch.settle(placed.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() % F.lit(1 << 33)), "ranges")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    base = counts.withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return placed.join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + F.col("_nth") + 1).cast("long")).drop("_part", "_nth", "_base")


def last_versions(versions: DataFrame, key: str, order: Column, tombstone: Column, valid: Column) -> DataFrame:
    """(key, readable_at, valid_at) of keys that are live by the index or by the fold: the places of the two versions.

    Three maxima a key, combined before the one exchange: no order within a key is needed.
    """
    at = versions.select(F.col(key), order.alias("_at"), tombstone.alias("_gone"), valid.alias("_fine"))
    by = at.groupBy(key).agg(
        F.max(F.when(F.col("_gone"), F.col("_at"))).alias("_cut"),
        F.max(F.when(~F.col("_gone"), F.col("_at"))).alias("readable_at"),
        F.max(F.when(~F.col("_gone") & F.col("_fine"), F.col("_at"))).alias("valid_at"),
    )
    after = lambda c: F.when(F.col("_cut").isNull() | (F.col(c) > F.col("_cut")), F.col(c)).alias(c)
    return by.select(key, after("readable_at"), after("valid_at")).where("readable_at is not null or valid_at is not null")


def live_keys(versions: DataFrame, key: str, order: Column, tombstone: Column) -> DataFrame:
    """Live keys without their order: the latest readable version isn't a tombstone."""
    return versions.groupBy(key).agg(F.max_by(tombstone, order).alias("_gone")).where("not _gone").select(key)


def ordered(folded: DataFrame, limit: int | None = None) -> DataFrame:
    """In order of insertion; limit below 0 counts as 0."""
    out = folded.orderBy("pos")
    return out if limit is None else out.limit(max(0, limit))
