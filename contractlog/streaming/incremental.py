"""Folds that are kept up to date: a state, and what came after it.

Log order is arrival order, so nothing is ever late and no watermark applies; the state is
one row for each live key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlog.operators.fold import fold


def caught_up(state: DataFrame, later: DataFrame, key: str, order: Column, tombstone: Column, columns: list[str], valid: Column | None = None) -> DataFrame:
    """The fold of all versions from the fold of the earlier ones: only later versions are read.

    state: fold() of earlier versions (key, columns, pos). A key without later versions keeps
    its row; one whose later versions hold a tombstone starts again after it.
    """
    fine = F.lit(True) if valid is None else valid
    touched = later.groupBy(key).agg(F.max(tombstone).alias("_cut"), F.count_if(~tombstone & fine).alias("_n"))
    fresh = fold(later, key, order, tombstone, columns, valid).drop("last")
    rest = [c for c in columns if c != key]
    old = state.select(key, *[F.col(c).alias(f"_{c}") for c in rest], F.col("pos").alias("_pos"), F.lit(True).alias("_was"))
    new = fresh.select(key, *rest, "pos", F.lit(True).alias("_is"))
    met = old.join(touched, key, "full").join(new, key, "left")
    kept = F.col("_was") & ~F.coalesce("_cut", F.lit(False))
    met = met.where(F.col("_is") | kept)
    return met.select(
        key,
        *[F.when(F.col("_is"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in rest],
        F.when(F.col("_is") & kept, F.col("_pos")).when(F.col("_is"), F.col("pos")).otherwise(F.col("_pos")).alias("pos"),
    )


def follow(spark: SparkSession, log_dir: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None]):
    """A query over the log parts of a folder that hands each new batch of lines to on_batch.

    The stream's checkpoint remembers which parts were seen; on_batch must be idempotent in
    the batch number (it may be called again for the last one after a failure).
    """
    lines = spark.readStream.option("lineSep", "\n").text(log_dir).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
