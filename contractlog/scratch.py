"""Tables that settle what is costly to compute: written to the folder that executors share.

The folder is the one that the session names in ``spark.checkpoint.dir``. Where it names none,
a temporary folder serves local sessions, and only those: on a cluster each executor would
write to a disk of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="contractlog-")
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Results may read the folder for as long as they live, so it goes when Python ends."""

    def drop() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session has gone, and its shared folder with it
            pass

    atexit.register(drop)


def settle(df: DataFrame, what: str) -> DataFrame:
    """df, computed once: later reads start from what was written."""
    path = f"{shared_dir(df.sparkSession)}/contractlog/{what}-{uuid.uuid4().hex}"
    drop_at_exit(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
