"""Bounded labelled samples for the classifiers: at most so many rows of each label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that a sample of one label may hold; its first text is taken whatever its size.
SAMPLE_BYTES = 1 << 24


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def class_shares(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> dict[int, float]:
    """Share of each label, 0 and 1, among all rows that may be learnt."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    total = sum(counts.values())
    return {k: v / total for k, v in counts.items()}


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_label: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int | None = None
) -> DataFrame:
    """(id, text, label) of at most per_label rows of each label, the first by a hash of the id, and of most_bytes of text.

    The ids of the sample are at most 2 * per_label rows: they may be broadcast at any size.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).withColumn("h", F.xxhash64("id"))
    parts = [rows.where(F.col("label") == k).orderBy("h", "id").limit(per_label) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").withColumn("b", F.octet_length("text").cast("long"))
    # per_label rows a label, but for ids that repeat
    before = Window.partitionBy("label").orderBy("h", "id", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("b").over(before), F.lit(0)) + F.col("b")
    fits = (upto <= (SAMPLE_BYTES if most_bytes is None else most_bytes)) | (upto == F.col("b"))
    return found.withColumn("fits", fits).where("fits").select("id", "text", "label")
