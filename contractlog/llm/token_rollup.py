"""Token counts: additive totals by source, language and tokenizer version, kept by deltas.

Changes are signed rows: an insert adds a document and its tokens, a delete takes them away,
a revision takes the old count away and adds the new one. A batch of changes is summed by
(source, lang, tokenizer) where it is read, and only these sums are stored. Totals are sums
of sums: no document is ever read again.

A batch is committed once: its sums are written to a staging folder, which one rename makes
``batches/<batch id>``. A batch id that is there already (or that a base already holds) is
skipped, so a retried or repeated batch changes nothing, and a commit that dies leaves only
staging files that no reader looks at. ``compact`` sums all committed batches into a new base
that names the batches it holds; the newest complete base and the batches outside it are the
state, so readers see each batch exactly once at any moment. The folder's file system must
rename folders atomically (HDFS and local disks do; object stores need a committer that does).
Batch ids may be any text; they are escaped where they name folders. Whether an id is known is
asked of the base by a filter, so no list of all ids is ever gathered to commit a batch.

A tokenizer version is a name: one of TOKENIZERS (column functions) or one of MODELS (rank files
of the op2 encoder, whose ids are counted). A new version of a tokenizer is a new name, whose counts
come by a batch of their own; the old one's go by deletes of its name alone.

A null source, language or text is a value of its own (a null text has no tokens; its row
counts as a document). Totals that return to zero documents and tokens are left out. Rows
that repeat count each time. Other columns are ignored, whatever they are called. A text is
counted whole, however long; an empty table gives no rows and its batch is committed all the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlog.llm import byte_bpe
from contractlog.scratch import drop_at_exit, shared_dir

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"

#: Tokenizer versions without a model: name -> white-space words or UTF-8 bytes of a text.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "bytes-1": F.octet_length,
}
#: Tokenizer versions that the op2 encoder runs: name -> rank file (None: the one of op2).
MODELS: dict[str, str | None] = {"byte-bpe-multi-50k-1": None}


def counted(
    docs: DataFrame, sign: int, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS, text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    models: dict[str, str | None] | None = None,
) -> DataFrame:
    """Signed changes of documents: one row for each document and tokenizer version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pairs = [(k, f(text).cast("long")) for k, f in tokenizers.items()]
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"), *(n.alias(f"n{k}") for k, (_, n) in enumerate(pairs)))
    names = [k for k, _ in pairs]
    for name, ranks in (models or {}).items():
        coded = byte_bpe.encode(rows, "text", ranks, offsets=False)
        rows = coded.withColumn(f"n{len(names)}", F.size("ids").cast("long")).drop("ids")
        names.append(name)
    each = F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.col(f"n{k}").alias("n")) for k, name in enumerate(names)))
    rows = rows.select("source", "lang", F.explode(each).alias("c"))
    return rows.select("source", "lang", "c.tokenizer", F.lit(sign).cast("long").alias("documents"), (F.col("c.n") * sign).alias("tokens"))


def inserts(docs: DataFrame, **options) -> DataFrame:
    return counted(docs, 1, **options)


def deletes(docs: DataFrame, **options) -> DataFrame:
    return counted(docs, -1, **options)


def revisions(before: DataFrame, after: DataFrame, **options) -> DataFrame:
    return counted(before, -1, **options).unionByName(counted(after, 1, **options))


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm, sc = spark._jvm, spark.sparkContext
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(sc._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _base(self) -> tuple[str | None, DataFrame]:
        """The newest complete base and the batches that it holds."""
        names = self._names("bases")
        if not names:
            return None, self.spark.createDataFrame([], "batch string")
        return names[-1], self.spark.read.schema("batch string").parquet(f"{self.path}/bases/{names[-1]}/held")

    def _loose(self) -> tuple[str | None, DataFrame, list[str]]:
        """The base, what it holds, and the batches that aren't in it: those committed since, by a list of one folder."""
        base, held = self._base()
        there = [unquote(n) for n in self._names("batches")]
        if base is None or not there:
            return base, held, there
        # few are both: a compaction that died before it deleted what it had summed
        both = {r.batch for r in held.where(F.col("batch").isin(there)).collect()}
        return base, held, [n for n in there if n not in both]

    def known(self, batch_id: str) -> bool:
        if self._fs.exists(self._path(f"{self.path}/batches/{quote(batch_id, safe='')}")):
            return True
        return not self._base()[1].where(F.col("batch") == batch_id).isEmpty()

    def batches(self) -> list[str]:
        """Ids of all committed batches, for a report: they are as many as there were commits."""
        _, held, loose = self._loose()
        return sorted({*loose, *(r.batch for r in held.collect())})

    def _publish(self, staged: str, into: str) -> bool:
        target = self._path(f"{self.path}/{into}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._path(staged), target):
            self._fs.delete(self._path(staged), True)
            return False
        # a rename onto a folder that came meanwhile moves into it: then the other one counts
        inner = self._path(f"{self.path}/{into}/{staged.rsplit('/', 1)[1]}")
        if self._fs.exists(inner):
            self._fs.delete(inner, True)
            return False
        return True

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Store the batch's sums unless its id is known; whether they were stored."""
        if self.known(batch_id):
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        summed(changes).coalesce(1).write.parquet(staged)
        return self._publish(staged, f"batches/{quote(batch_id, safe='')}")

    def _read(self) -> DataFrame:
        base, _, loose = self._loose()
        paths = [f"{self.path}/batches/{quote(n, safe='')}" for n in loose]
        paths += [f"{self.path}/bases/{base}/sums"] if base else []
        return self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)

    def totals(self) -> DataFrame:
        return summed(self._read()).where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Sum everything into a new base; batches in it are deleted once it is there."""
        base, held, loose = self._loose()
        if not loose:
            return
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        self.totals().coalesce(1).write.parquet(f"{staged}/sums")
        every = held.unionByName(self.spark.createDataFrame([(b,) for b in loose], "batch string"))
        every.write.parquet(f"{staged}/held")
        if self._publish(staged, f"bases/{int(base or '0') + 1:012d}"):
            for name in loose:
                self._fs.delete(self._path(f"{self.path}/batches/{quote(name, safe='')}"), True)


def _short(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) < 5)


def _fresh(spark: SparkSession) -> Rollup:
    path = f"{shared_dir(spark)}/contractlog/rollup-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return Rollup(spark, path)


def whole(docs: DataFrame) -> DataFrame:
    """Token totals of every document by the words, the bytes and the op2 encoder's ids of its text as it is.

    All documents are loaded, and again; the encoder's version comes as a later batch; texts of
    under five words are withdrawn and inserted again, so the totals cover every row.
    """
    rollup = _fresh(docs.sparkSession)
    plain = docs.select("source", "lang", "text")
    for _ in range(2):
        rollup.commit("load", inserts(plain))
    rollup.commit("encoder", inserts(plain, tokenizers={}, models=MODELS))
    rollup.commit("withdraw", deletes(_short(plain), models=MODELS))
    rollup.compact()
    rollup.commit("restore", inserts(_short(plain), models=MODELS))
    return rollup.totals()


def query(docs: DataFrame) -> DataFrame:
    """The op4 query: words and bytes of every document, reached by inserts, revisions and deletes.

    All documents are loaded with each run of white space as one space, and loaded again; the
    revision counts every text as it is (other byte counts, same words); texts of under five
    words are withdrawn and inserted again. The totals cover every row of the table.
    """
    rollup = _fresh(docs.sparkSession)
    plain = docs.select("source", "lang", "text")
    tidy = plain.withColumn("text", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    for _ in range(2):
        rollup.commit("load", inserts(tidy))
    rollup.commit("revise", revisions(tidy, plain))
    rollup.commit("withdraw", deletes(_short(plain)))
    rollup.compact()
    rollup.commit("restore", inserts(_short(plain)))
    return rollup.totals()


QUERY_SQL = r"""
WITH t AS (
  SELECT source, lang, CAST(len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words, CAST(strlen(coalesce("text", '')) AS BIGINT) AS bytes FROM documents)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS documents, CAST(sum(words) AS BIGINT) AS tokens FROM t GROUP BY ALL
UNION ALL SELECT source, lang, 'bytes-1', count(*), CAST(sum(bytes) AS BIGINT) FROM t GROUP BY ALL
"""
