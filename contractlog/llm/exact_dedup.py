"""Exact dedup by a log-structured merge index over text digests (DataFrame functions only).

The index keeps *runs* of (digest, least doc_id, copies), each a Parquet folder:

* a **memtable** is what is read of a batch; ``flush`` pre-aggregates it by digest and writes
  it sorted by digest, with Parquet's own Bloom filter on the digest, by which ``lookup``
  skips row groups. A batch that is flushed twice replaces its own run, so a retry changes
  nothing. ``build`` flushes a table as FAN_IN batches at once, by a hash of the id.
* ``compact`` merges the runs of a level into one run of the next level and keeps the
  smallest identifier and the sum of copies of each digest. It happens whenever a level has
  FAN_IN runs, so ``build`` ends with one merged run.
* ``probe`` tells texts that may have copies from those that surely have none, by a filter of
  the digests that occur more than once; it is a bitmap of a bounded size that is broadcast,
  or, for more digests than that is good for (see common.MOST_FILTER_BITS), a join by digest.
* hits receive **byte verification**: of all whole texts of one digest the least and the
  greatest are kept, combined before they are shuffled; where they are the same, all are.
  Digests that stand for several texts are told apart by the texts themselves.

Which document stays and how many copies it has comes from the index. Digests that hold over
one in HOT_SHARE of all rows are at most HOT_SHARE; they are broadcast, so that a group with
a third of all rows isn't one task's.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space.
A null text is an empty text; empty texts are copies of each other. A null doc_id counts
as a copy but is never the least one; where a class has only null ids, keep_id is null
and nothing of it is kept. Rows that repeat both text and doc_id are all marked kept by
``classes`` and become one row in ``dedup``. An empty table gives an empty result. Columns of
any name and type stay as they are in ``dedup`` and are ignored in ``classes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlog.llm import common
from contractlog.llm.common import Scratch, filter_bits, maybe_member, membership

#: Runs that may lie on one level before they are merged.
FAN_IN = 8
#: A Bloom filter on the digest in each file, of the size that the file's digests ask for.
FILTERS = {"parquet.bloom.filter.enabled#_digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(1 << 20)}
#: A digest is hot if it holds over one in so many rows.
HOT_SHARE = 1000
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _norm, _digest) of every row."""
    return docs.select(named(id_col).alias("_id"), normalised(named(text_col)).alias("_norm")).withColumn(
        "_digest", digest(F.col("_norm"))
    )


class DigestIndex:
    """The runs below one shared folder; ``levels[k]`` names the runs of level k."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.runs = scratch, [[]], {}

    def _write(self, run: DataFrame, name: str) -> None:
        self.runs[name] = self.scratch.write(run.sortWithinPartitions("_digest"), name, **FILTERS)

    @staticmethod
    def _memtable(batch: DataFrame, *by: str) -> DataFrame:
        return batch.groupBy(*by, "_digest").agg(F.min("_id").alias("_least"), F.count("*").alias("_copies"))

    def flush(self, batch: DataFrame, batch_id: str) -> None:
        """Add (_id, _digest) rows as one sorted run; the same batch_id again replaces it."""
        name = f"level0-{batch_id}"
        self._write(self._memtable(batch), name)
        if name not in self.levels[0]:
            self.levels[0].append(name)
        if len(self.levels[0]) >= FAN_IN:
            self.compact(0)

    def flush_all(self, rows: DataFrame, batches: int) -> None:
        """Add (_id, _digest) rows as so many runs, written by one job."""
        parted = rows.withColumn("_run", F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int"))
        runs = self._memtable(parted, "_run").select("_digest", "_least", "_copies", "_run")
        # by ranges: a task holds a piece of one run, so files are as many as tasks and not as tasks times runs
        runs = runs.repartitionByRange("_run", "_digest").sortWithinPartitions("_run", "_digest")
        path = f"{self.scratch.root}/memtables"
        runs.write.mode("overwrite").partitionBy("_run").options(**FILTERS).parquet(path)
        written = self.scratch.spark.read.schema(runs.schema).parquet(path)
        for k in range(batches):
            name = f"memtables/_run={k}"
            self.runs[name] = written.where(F.col("_run") == k).drop("_run")
            self.levels[0].append(name)
        if len(self.levels[0]) >= FAN_IN:
            self.compact(0)

    def compact(self, level: int) -> None:
        names = self.levels[level]
        if len(names) < 2:
            return
        if len(self.levels) == level + 1:
            self.levels.append([])
        into = f"level{level + 1}-{len(self.runs)}"
        self._write(self._merged(names), into)
        self.levels[level + 1].append(into)
        self.scratch.forget(*names)
        for name in names:
            del self.runs[name]
        self.levels[level] = []
        if len(self.levels[level + 1]) >= FAN_IN:
            self.compact(level + 1)

    def _merged(self, names: list[str]) -> DataFrame:
        every = self.runs[names[0]]
        for name in names[1:]:
            every = every.unionByName(self.runs[name])
        return every.groupBy("_digest").agg(F.min("_least").alias("_least"), F.sum("_copies").alias("_copies"))

    def entries(self) -> DataFrame:
        """(_digest, _least, _copies) over all runs."""
        names = [x for level in self.levels for x in level]
        return self.runs[names[0]] if len(names) == 1 else self._merged(names)

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """entries() of a few digests: the runs' Bloom filters leave out what doesn't hold them."""
        return self.entries().where(F.col("_digest").isin([F.lit(x) for x in digests]))

    def repeated(self) -> DataFrame:
        return self.entries().where("_copies > 1")

    def probe(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """texts(_digest, ...) as (those that are surely single, possible copies)."""
        repeated = self.repeated()
        probed = may_hold(texts, repeated, "_digest", self.scratch, "filter")
        return probed.where("not maybe").drop("maybe"), probed.where("maybe").drop("maybe")


def may_hold(rows: DataFrame, keys: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """rows with maybe: false only where the key is surely not among keys."""
    count = keys.count()
    if 8 * count <= common.MOST_FILTER_BITS:
        bits = filter_bits(count)
        return maybe_member(rows, key, scratch.write(membership(keys, key, bits), name), bits)
    there = keys.select(key).distinct().withColumn("maybe", F.lit(True))
    return rows.join(there, key, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))


def build(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", batches: int = FAN_IN) -> tuple[DigestIndex, DataFrame]:
    """An index over docs, flushed in so many batches, and the (_id, _digest) of every row."""
    index = DigestIndex(scratch)
    rows = scratch.write(with_digest(docs, id_col, text_col).select("_id", "_digest"), "rows")
    index.flush_all(rows, batches)
    return index, rows


def _verified(hits: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Digests of hits(_digest, _norm) that stand for several texts, and whether there are any."""
    ends = hits.groupBy("_digest").agg(F.min("_norm").alias("a"), F.max("_norm").alias("b"))
    broken = scratch.write(ends.where("a <> b").select("_digest"), "broken")
    return broken, not broken.isEmpty()


def _told(rows: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """rows with _least and _copies of their digests, where known has them: hot ones by a broadcast."""
    hot = known.where(F.col("_copies") * HOT_SHARE > total)  # HOT_SHARE rows at most
    by_hot = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_digest", "left")
    cold = by_hot.where("_hot is null").drop("_hot", "_least", "_copies")
    return by_hot.where("_hot").drop("_hot").unionByName(cold.join(known, "_digest", "left"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "dedup")
    index, rows = build(docs, scratch, id_col, text_col)
    _, hits = index.probe(with_digest(docs, id_col, text_col))
    hits = scratch.write(hits, "hits")
    broken, any_broken = _verified(hits, scratch)
    if any_broken:
        rows = rows.join(broken, "_digest", "left_anti")
    told = _told(rows, index.repeated(), rows.count())
    every = told.select("_id", "_digest", F.when(F.col("_copies").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("_keep"), F.coalesce("_copies", F.lit(1)).alias("_size"))
    if any_broken:
        hits = hits.join(broken, "_digest", "left_semi")
        groups = hits.groupBy("_digest", "_norm").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
        every = every.unionByName(hits.join(groups, ["_digest", "_norm"]).select("_id", "_digest", "_keep", "_size"))
    return every.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("_keep"), F.lit(False)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def _orderable(docs: DataFrame, name: str) -> Column:
    """The column, or its JSON text where its type has no order."""
    shown = docs.schema[name].dataType.simpleString()
    return F.to_json(F.struct(named(name))) if "map<" in shown or "variant" in shown else named(name)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without copies, all columns as they were: of equal texts the row with the least id.

    Among rows of that id the least row in column order stays (one row, even of repeats).
    A class whose ids are all null keeps its least row as well.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    index, _ = build(docs, scratch, id_col, text_col)
    texts = docs.select(
        named(id_col).alias("_id"),
        normalised(named(text_col)).alias("_norm"),
        F.struct(*(named(c) for c in docs.columns)).alias("_row"),
        F.struct(named(id_col).isNull(), named(id_col), *(_orderable(docs, c) for c in docs.columns if c not in (id_col, text_col)), named(text_col)).alias("_order"),
    ).withColumn("_digest", digest(F.col("_norm")))
    single, hits = index.probe(texts)
    hits = scratch.write(hits, "hits")
    broken, any_broken = _verified(hits, scratch)
    first = F.min_by("_row", "_order").alias("_row")
    # a row that isn't its digest's least one goes before anything is shuffled
    one = F.xxhash64("_digest", F.coalesce(F.col("_least").cast("string"), F.lit("")))
    least = index.entries().select("_digest", "_least", one.alias("_one"))
    marked = hits.withColumn("_one", F.xxhash64("_digest", F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    wanted = may_hold(marked, least.join(hits.select("_digest").distinct(), "_digest", "left_semi"), "_one", scratch, "keepers").where("maybe")
    found = wanted.join(least.drop("_one"), "_digest").where(F.col("_id").eqNullSafe(F.col("_least")))
    if any_broken:
        found = found.join(broken, "_digest", "left_anti")
    kept = found.groupBy("_digest").agg(first).select("_row")
    if any_broken:
        kept = kept.unionByName(hits.join(broken, "_digest", "left_semi").groupBy("_digest", "_norm").agg(first).select("_row"))
    return single.select("_row").unionByName(kept).select(*(F.col("_row")[c].alias(c) for c in docs.columns))
