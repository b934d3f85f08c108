"""Shared pieces of the training-data operators: tables, scratch tables, filters.

Nothing here keeps state on a machine: whatever is written goes below the folder
that the session names in ``spark.checkpoint.dir``, so that a lost executor costs
only the tasks it ran.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlog.scratch import delete, drop_at_exit, shared_dir

#: Most bits of a membership filter: 2 ** 28 bits are 32 MB when broadcast.
MOST_FILTER_BITS = 1 << 28
#: Bits of one bitmap of bitmap_construct_agg.
BITMAP_BITS = 32768
#: Rows and bytes of an Arrow batch at most.
ARROW_ROWS, ARROW_BYTES = 1024, 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand Python at most ARROW_ROWS rows and about ARROW_BYTES at once: both sides hold a batch whole, and texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


class Scratch:
    """Tables written to the shared folder to cut lineage; dropped when Python ends.

    A result may read them for as long as it lives, so no earlier moment is safe.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/contractlog/{what}-{uuid.uuid4().hex}"
        drop_at_exit(spark, self.root)
        small_batches(spark)

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def tidy(self) -> None:
        """Let Spark drop the shuffle files of jobs that have ended: it does so when their plans are collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def filter_bits(keys: int) -> int:
    """A power of two with at least eight bits a key, between 2 ** 15 and MOST_FILTER_BITS."""
    bits = BITMAP_BITS
    while bits < 8 * keys and bits < MOST_FILTER_BITS:
        bits *= 2
    return bits


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def membership(df: DataFrame, key: str, bits: int) -> DataFrame:
    """Bitmaps of the hashed keys of df: at most bits / 32768 rows of 4 KB, whatever df's size."""
    slot = _slot(F.col(key), bits)
    return df.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits")
    )


def maybe_member(df: DataFrame, key: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """df with ``maybe``: false only for keys that membership() never saw (no false negatives).

    The bitmaps are broadcast: MOST_FILTER_BITS / 8 bytes bound their size.
    """
    slot = _slot(F.col(key), bits)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (
        df.withColumn("_bucket", F.bitmap_bucket_number(slot))
        .withColumn("_at", at)
        .join(F.broadcast(bitmaps), "_bucket", "left")
        .withColumn(
            "maybe",
            F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False)),
        )
        .drop("_bucket", "_at", "_bits")
    )
