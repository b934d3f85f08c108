"""What a batch of writes does: created, updated, unchanged or rejected; deleted or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserts(incoming: DataFrame, live: DataFrame, key: str, seq: str, body: str, issues: str | None = None) -> DataFrame:
    """incoming with op. Rows of a key take effect in order of seq, the first against live.

    body: what two versions are compared by (canonical text). issues: a column whose text,
    unless empty, rejects the row; rejected rows change nothing for those after them.
    """
    bad = F.coalesce(F.col(issues) != "", F.lit(False)) if issues else F.lit(False)
    rows = incoming.withColumn("_bad", bad)
    now = live.select(F.col(key), F.col(body).alias("_now")).withColumn("_is", F.lit(True))
    met = rows.join(now, key, "left")
    # among rows that aren't rejected the one before is the latest state, whatever its op was
    before = F.lag(F.struct(body)).over(Window.partitionBy(key, "_bad").orderBy(seq))
    state = F.when(before.isNotNull(), before.getField(body)).otherwise(F.col("_now"))
    known = before.isNotNull() | F.col("_is").isNotNull()
    op = F.when(F.col("_bad"), "rejected").when(~known, "created").when(state.eqNullSafe(F.col(body)), "unchanged").otherwise("updated")
    return met.withColumn("op", op).drop("_now", "_is", "_bad")


def deletes(ids: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """ids with op: deleted (once a key) or absent."""
    known = live.select(key).withColumn("_is", F.lit(True))
    rows = ids.select(key).groupBy(key).agg(F.count("*").alias("_n")).join(known, key, "left")
    each = rows.withColumn("_k", F.explode(F.expr("sequence(1L, _n)")))
    return each.select(key, F.when(F.col("_is") & (F.col("_k") == 1), "deleted").otherwise("absent").alias("op"))


def counts(changed: DataFrame) -> DataFrame:
    """(written, rejected, unchanged) of upserts()."""
    is_op = lambda *ops: F.count_if(F.col("op").isin(*ops))
    return changed.agg(is_op("created", "updated").alias("written"), is_op("rejected").alias("rejected"), is_op("unchanged").alias("unchanged"))
