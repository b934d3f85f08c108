"""Stores: a log in a folder or in a file, a contract, and what can be done with them.

A folder store (``Store``) has ``log/<version>.jsonl`` parts and ``_commits/<version>.json``
files. A commit names the parts it adds, with their sizes, and those it removes; the parts in
force, in order of version and then of place, are the log. A commit is one exclusive creation
of a small file on the driver: of two writers that want the same version one loses and tries
again on the newer state. Every CHECKPOINT commits the parts in force are listed in one file, so
readers replay few commits. Readers resolve the commits first and read just those parts: they
see one state whatever happens meanwhile, and parts of a write that died are never read.

A plain ``.jsonl`` file is a store as well (``FileStore``, see ``open_store``): lines are
appended under an advisory lock, a torn tail is closed first, and the file is replaced as a
whole by compaction. What such a store writes passes through the driver as a stream of rows, as
the file is on the driver's disk; a log that outgrows this belongs into a folder.

A folder store keeps an index: ``_index/<version>`` holds where each live key's newest version
and first place are, over the parts that its list names. It holds as long as those parts begin
the log (until a compaction), so readers of keys and of one record fold the parts that came after
it and no others; every INDEX_AFTER parts a writer brings it up to date from itself.

Each write settles what it is about to do in the session's shared folder, so its lines are
judged once, and what is reported is what was written.
"""

from __future__ import annotations

import fcntl
import json
import os
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractlog import scratch
from contractlog.contract import SEGMENT, SEGMENT_TEXT, Contract, load_contract
from contractlog.functions import checks
from contractlog.operators import changes, classify, fold, maintenance
from contractlog.sources import lines as log_lines
from contractlog.streaming.incremental import caught_up

TRIES = 20
#: Commits between two lists of all parts.
CHECKPOINT = 50
#: Parts beyond the index after which a writer refreshes it.
INDEX_AFTER = 8
#: Bad lines that a report shows at most.
MOST_ISSUES = 10_000
QUARANTINE = "offset long, line long, reason string, raw string"
INDEX = "key string, seq struct<part:int,offset:long>, fine boolean, pos struct<part:int,offset:long>"


class StoreError(Exception):
    def __init__(self, code: str, message: str, **extra):
        super().__init__(message)
        self.code, self.extra = code, extra


@dataclass(frozen=True)
class Snapshot:
    """One state of a log: its parts in order."""

    version: int
    parts: tuple[str, ...]
    size: int
    modified: int

    @property
    def revision(self) -> dict:
        return {"version": self.version or None, "size": self.size, "mtime": self.modified or None}


class Store:
    def __init__(self, spark: SparkSession, path: str, contract: Contract | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.contract = load_contract(contract) if isinstance(contract, str) else contract
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._fs(self.path)
        if self.fs.getScheme() == "file" and not self._path(self.path).isAbsolute():
            self.path = os.path.abspath(self.path)  # the JVM has a working folder of its own

    # -- files --

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, body: str) -> bool:
        """Whether the file was created here; false if it was there already."""
        fs, at = self._fs(name), self._path(name)
        if fs.exists(at):
            return False
        try:
            out = fs.create(at, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(body.encode())
        out.close()
        return True

    @contextmanager
    def _locked(self):
        """Nothing here: a commit that comes second fails and is tried again."""
        yield

    def snapshot(self) -> Snapshot:
        at = self._path(self.path)
        if self.fs.exists(at) and self.fs.getFileStatus(at).isFile():
            s = self.fs.getFileStatus(at)
            return Snapshot(1, (self.path,), s.getLen(), s.getModificationTime())
        names = self._names("_commits")
        lists = [k for k, n in enumerate(names) if n.endswith(".parts.json")]
        parts: dict[str, int] = {}
        version = modified = 0
        if lists:
            body = json.loads(self._read(f"{self.path}/_commits/{names[lists[-1]]}"))
            parts, version, modified = dict(body["parts"]), body["version"], body["at"]
        for name in names:
            if name.endswith(".parts.json") or int(name.split(".")[0]) <= version:
                continue
            change = json.loads(self._read(f"{self.path}/_commits/{name}"))
            gone = set(change["remove"])
            parts = {p: n for p, n in parts.items() if p not in gone} | dict(change["add"])
            version, modified = int(name.split(".")[0]), change["at"]
        return Snapshot(version, tuple(f"{self.path}/log/{p}" for p in parts), sum(parts.values()), modified)

    def _commit(self, version: int, add: list[tuple[str, int]], remove: Iterable[str] = ()) -> bool:
        now = int(time.time() * 1000)
        body = json.dumps({"add": add, "remove": [os.path.basename(p) for p in remove], "at": now})
        if not self._create(f"{self.path}/_commits/{version:020d}.json", body):
            return False
        if version % CHECKPOINT == 0:
            at = self.snapshot()
            if at.version == version:
                sizes = [(os.path.basename(p), self.fs.getFileStatus(self._path(p)).getLen()) for p in at.parts]
                self._create(f"{self.path}/_commits/{version:020d}.parts.json", json.dumps({"version": version, "parts": sizes, "at": now}))
        return True

    def _write_parts(self, texts: DataFrame, column: str) -> list[tuple[str, int]]:
        """The rows' lines as new parts in order; rows must be sorted already. Returns their names and sizes."""
        staged = f"{self.path}/_staging/{uuid.uuid4().hex}"
        texts.select(column).write.text(staged)
        made = []
        self.fs.mkdirs(self._path(f"{self.path}/log"))
        for k, s in enumerate(sorted((s for s in self.fs.listStatus(self._path(staged)) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())):
            if s.getLen():
                name = f"{uuid.uuid4().hex}-{k:06d}.jsonl"
                self.fs.rename(s.getPath(), self._path(f"{self.path}/log/{name}"))
                made.append((name, s.getLen()))
        self.fs.delete(self._path(staged), True)
        return made

    def _append(self, rows: DataFrame, at: Snapshot) -> bool:
        """Add the rows' records (ordered) to the log as it was; whether nothing came between."""
        made = self._write_parts(rows, "record")
        return not made or self._commit(at.version + 1, made)

    def _replace(self, rows: DataFrame | None, at: Snapshot) -> bool:
        """Put the rows' records (ordered) in the place of the log as it was, none for an empty log."""
        made = self._write_parts(rows, "record") if rows is not None else []
        return self._commit(at.version + 1, made, at.parts)

    # -- reads --

    def lines(self, at: Snapshot | None = None, first: int = 0, last: int | None = None) -> DataFrame:
        """positions() of the snapshot's lines, with seq: an order over all parts. first, last: only parts from one to another."""
        at = at or self.snapshot()
        parts = at.parts[first:last]
        if not parts:
            empty = "file string, block long, row long, raw string, size long, offset long, line long, torn boolean, seq struct<part:int,offset:long>"
            return self.spark.createDataFrame([], empty)
        found = log_lines.positions(log_lines.scan(self.spark, *parts))
        if len(parts) == 1:
            return found.withColumn("seq", F.struct(F.lit(first).alias("part"), F.col("offset").alias("offset")))
        # names of parts, which the driver has listed already: some 60 bytes each
        ranks = self.spark.createDataFrame([(os.path.basename(p), k) for k, p in enumerate(parts, first)], "name string, part int")
        placed = found.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(F.broadcast(ranks), "name")
        return placed.withColumn("seq", F.struct("part", "offset")).drop("name", "part")

    def classified(self, at: Snapshot | None = None, record: bool = False, key: str | None = None, first: int = 0, last: int | None = None) -> DataFrame:
        """The lines and what they are. With a key, only its lines are held against the contract, and no others are returned."""
        return classify.classify(classify.parse(self.lines(at, first, last).drop("block", "row", "size")), self.contract, record, key)

    @staticmethod
    def _live(rows: DataFrame) -> DataFrame:
        """live() of classified rows with their records, which are settled already."""
        rows = rows.where("readable").select("key", "seq", "tombstone", "reason", "record")
        found = fold.fold(rows, "key", F.col("seq"), F.col("tombstone"), ["seq", "record"], F.col("reason").isNull())
        return found.select("key", "seq", "pos", "record")

    def live(self, at: Snapshot | None = None) -> DataFrame:
        """(key, seq, pos, record): valid records, record as canonical JSON."""
        rows = self.classified(at, record=True).where("readable").select("key", "seq", "tombstone", "readable", "reason", "record")
        return self._live(scratch.settle(rows, "live"))

    def index(self, at: Snapshot | None = None) -> DataFrame:
        """(key, seq, fine, pos): live keys, where their last readable version is, whether it is valid, and their first place."""
        at = at or self.snapshot()
        state, known = self._state(at)
        rows = self.classified(at, first=known).where("readable").select("key", "seq", "tombstone", F.col("reason").isNull().alias("fine"))
        rows = scratch.settle(rows, "index")
        if state is None:
            return fold.fold(rows, "key", F.col("seq"), F.col("tombstone"), ["seq", "fine"]).drop("last")
        return caught_up(state, rows, "key", F.col("seq"), F.col("tombstone"), ["seq", "fine"]) if known < len(at.parts) else state

    def _state(self, at: Snapshot) -> tuple[DataFrame | None, int]:
        """The newest index, if the parts that it covers begin this state's log, and how many they are."""
        lists = [n for n in self._names("_index") if n.endswith(".json")]
        if not lists:
            return None, 0
        told = json.loads(self._read(f"{self.path}/_index/{lists[-1]}"))
        if told["parts"] != [os.path.basename(p) for p in at.parts[: len(told["parts"])]]:
            return None, 0
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/_index/{told['rows']}"), len(told["parts"])

    def refresh_index(self) -> None:
        """Bring the index up to the log as it is; what it covered isn't read again."""
        at = self.snapshot()
        if self._state(at)[1] == len(at.parts):
            return
        rows = f"{at.version:020d}-{uuid.uuid4().hex}"
        found = self.index(at).select("key", "seq", "fine", "pos")
        # sorted by key, so that a reader of one key skips the rest by the row groups' bounds
        found.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.path}/_index/{rows}")
        self._create(f"{self.path}/_index/{at.version:020d}.json", json.dumps({"rows": rows, "parts": [os.path.basename(p) for p in at.parts]}))

    def _grown(self) -> None:
        at = self.snapshot()
        if len(at.parts) - self._state(at)[1] >= INDEX_AFTER:
            self.refresh_index()

    def count(self, at: Snapshot | None = None) -> int:
        """Live keys by the last readable version."""
        return self.index(at).count()

    def records(self, at: Snapshot | None = None) -> DataFrame:
        """Live records as columns of the contract, ordered by nothing; pos orders them."""
        fields = T.StructType([T.StructField(f.name, f.kind.spark) for f in self.contract.fields])
        parsed = self.live(at).withColumn("r", F.from_json("record", fields))
        return parsed.select(*(F.col(f"r.{n}").alias(n) for n in self.contract.names), "pos")

    def bad_lines(self, at: Snapshot | None = None) -> DataFrame:
        return classify.bad_lines(self.classified(at))

    def first_bad_lines(self, at: Snapshot | None = None, most: int = MOST_ISSUES) -> list[dict]:
        return [r.asDict() for r in self.bad_lines(at).orderBy("offset").limit(most).collect()]

    def get(self, key, by_index: bool = False, at: Snapshot | None = None) -> dict | None:
        """The record of a key, or None. by_index: None as well where the newest version is off contract.

        With an index only the parts after it are parsed, and the one part that it names. One
        aggregate over the lines of that key; other lines are parsed, and no more.
        """
        at = at or self.snapshot()
        state, known = self._state(at)
        cut, newest, best = self._ends(self.classified(at, record=True, key=str(key), first=known))
        if state is not None and newest is None:
            row = None if cut is not None else state.where(F.col("key") == str(key)).first()
            if row is None or (by_index and not row.fine):
                return None
            if row.fine:
                part = self.classified(at, record=True, key=str(key), first=row.seq.part, last=row.seq.part + 1)
                return json.loads(part.where(F.col("seq") == F.struct(F.lit(row.seq.part).alias("part"), F.lit(row.seq.offset).cast("long").alias("offset"))).first().record)
        if state is not None and best is None and cut is None and not by_index:  # the newest valid version is older than the index or beside it
            cut, newest, best = self._ends(self.classified(at, record=True, key=str(key)))
        if best is None or (cut is not None and best.seq < cut) or (by_index and best.seq != newest):
            return None
        return json.loads(best.record)

    @staticmethod
    def _ends(rows: DataFrame):
        """Of one key's lines: the last tombstone, the last readable version, the last valid one."""
        return rows.where("readable").agg(
            F.max(F.when(F.col("tombstone"), F.col("seq"))).alias("cut"),
            F.max(F.when(~F.col("tombstone"), F.col("seq"))).alias("newest"),
            F.max_by(F.struct("seq", "record"), F.when(~F.col("tombstone") & F.col("reason").isNull(), F.col("seq"))).alias("best"),
        ).first()

    def keys(self, limit: int | None = None) -> list[str]:
        return [r.key for r in fold.ordered(self.index().select("key", "pos"), limit).collect()]

    def page(self, limit: int = 100, fields: list[str] | None = None) -> tuple[list[dict], int, int]:
        """(first records, live keys in all, bad lines); fields in the order given."""
        wanted = [f.strip() for f in fields or [] if f.strip()]
        if unknown := [f for f in wanted if f not in self.contract.names]:
            raise StoreError("USAGE_ERROR", f"unknown field: {', '.join(unknown)}", help=[f"Fields: {', '.join(self.contract.names)}"])
        rows = scratch.settle(self.classified(self.snapshot(), record=True).select("key", "seq", "tombstone", "readable", "reason", "record"), "page")
        shown = [json.loads(r.record) for r in fold.ordered(self._live(rows), limit).collect()]
        total = fold.live_keys(rows.where("readable"), "key", F.col("seq"), F.col("tombstone")).count()
        return [{f: r.get(f) for f in wanted} if wanted else r for r in shown], total, rows.where("reason is not null").count()

    def validate(self, most: int = MOST_ISSUES) -> dict:
        """{valid, bad, issues}: live records, bad lines and what is wrong with the first of them."""
        rows = self.classified(self.snapshot()).select("key", "seq", "tombstone", "readable", "reason", "offset", "line")
        rows = scratch.settle(rows, "validate")
        ends = maintenance.validity(rows, "key", F.col("seq")).first()
        found = rows.where("reason is not null").orderBy("seq").limit(most).collect()
        return {"valid": ends.valid, "bad": ends.bad, "issues": [{"line": r.line, "byte": r.offset, "reason": r.reason} for r in found]}

    def append_only_violations(self, at: Snapshot | None = None) -> tuple[int, int]:
        r = maintenance.append_only_violations(self.classified(at).where("readable"), "key", F.col("tombstone")).first()
        return r.dups, r.tombs

    # -- writes --

    def incoming(self, records: Iterable[dict | str], overrides: dict | None = None) -> DataFrame:
        """(seq, key, record, issues) of records given as objects or JSON lines; a wrong line raises before anything is written."""
        rows = []
        for k, r in enumerate(r for r in records if not isinstance(r, str) or r.strip()):
            if isinstance(r, str):
                try:
                    r = json.loads(r)
                except json.JSONDecodeError as e:
                    raise StoreError("USAGE_ERROR", f"record {k + 1}: invalid json: {e.msg} at col {e.colno}") from e
            if not isinstance(r, dict):
                raise StoreError("USAGE_ERROR", f"record {k + 1}: not an object")
            rows.append((k, json.dumps(r | (overrides or {}), ensure_ascii=False)))
        return self.prepared(self.spark.createDataFrame(rows, "seq long, raw string"))

    def prepared(self, raw: DataFrame) -> DataFrame:
        """raw(seq, raw) as upsert rows, at any size."""
        parsed, rec = checks.spread(raw.withColumn("rec", checks.settled(F.parse_json("raw"))), self.contract)
        key = checks.field_columns(self.contract[self.contract.key], rec[self.contract.key])[0].cast("string")
        made = F.struct(key.alias("key"), checks.canonical(self.contract, rec).alias("record"), checks.issues(self.contract, rec).alias("issues"))
        return parsed.select("seq", checks.settled(made).alias("m")).select("seq", "m.key", "m.record", "m.issues")

    def put(self, incoming: DataFrame) -> DataFrame:
        """Write what is new or changed of incoming(); returns (seq, key, op, issues)."""
        with self._locked():
            for _ in range(TRIES):
                at = self.snapshot()
                changed = changes.upserts(incoming, self.live(at).select("key", "record"), "key", "seq", "record", "issues")
                changed = scratch.settle(changed.select("seq", "key", "op", "issues", "record"), "put")
                if self._append(changed.where("op in ('created', 'updated')").orderBy("seq"), at):
                    self._grown()
                    return changed.drop("record")
        raise StoreError("IO_ERROR", "the log kept changing")

    def delete(self, keys: Iterable) -> list[tuple[str, str]]:
        """(key, deleted or absent) of each."""
        ids = self.spark.createDataFrame([(str(k),) for k in keys], "key string")
        with self._locked():
            for _ in range(TRIES):
                at = self.snapshot()
                done = scratch.settle(changes.deletes(ids, self.live(at), "key"), "delete")
                key = F.to_json(F.struct(F.col("key").try_cast(self.contract[self.contract.key].kind.spark).alias(self.contract.key)))
                gone = done.where("op = 'deleted'").select(F.concat(F.substring(key, F.lit(1), F.char_length(key) - 1), F.lit(',"_deleted":true}')).alias("record"))
                if self._append(gone.coalesce(1), at):
                    self._grown()
                    return [(r.key, r.op) for r in done.collect()]  # as many as were asked for
        raise StoreError("IO_ERROR", "the log kept changing")

    def compact(self, on_bad: str = "drop") -> dict:
        """Rewrite the log as its live records in order; on_bad="error" refuses to lose bad lines."""
        return self._rewritten(lambda bad, at: None, on_bad)

    def repair(self) -> dict:
        """Bad lines to quarantine first, then compaction of the same state."""
        done = self._rewritten(self._quarantined, "drop")
        return {"kept": done["kept"], "dropped": done["bad"]}

    def _rewritten(self, first, on_bad: str) -> dict:
        with self._locked():
            for _ in range(TRIES):
                at = self.snapshot()
                bad_only = F.when(F.col("reason").isNotNull(), F.col("raw")).alias("raw")
                rows = self.classified(at, record=True).select("key", "seq", "tombstone", "readable", "reason", "record", "offset", "line", bad_only)
                rows = scratch.settle(rows, "rewrite")
                bad = classify.bad_lines(rows)
                found = bad.count()
                if found and on_bad == "error":
                    raise StoreError("CONTRACT_VIOLATION", f"{found} bad lines would be lost")
                if found:
                    first(bad, at)
                kept = scratch.settle(self._live(rows), "kept")
                if self._replace(kept.orderBy("pos"), at):
                    return {"kept": kept.count(), "bad": found, "reclaimed_bytes": at.size - self.snapshot().size}
        raise StoreError("IO_ERROR", "the log kept changing")

    def _quarantined(self, bad: DataFrame, at: Snapshot) -> None:
        """Written by version: a second try at the same state replaces the first."""
        lines = bad.orderBy("offset").select(F.to_json(F.struct("offset", "line", "reason", "raw"), {"ignoreNullFields": "false"}))
        lines.write.mode("overwrite").text(f"{self.path}/quarantine/{at.version:020d}")

    def quarantine(self) -> DataFrame:
        if not self._names("quarantine"):
            return self.spark.createDataFrame([], QUARANTINE)
        return self.spark.read.schema(QUARANTINE).json(f"{self.path}/quarantine/*")

    # -- archives --

    @property
    def archive(self) -> str:
        return f"{self.path}/archive"

    @property
    def stem(self) -> str:
        return os.path.basename(self.path).removesuffix(".jsonl")

    def _sealed(self, parts: Iterable[str], target: str) -> str:
        """The parts' bytes, one after another, as a gzip file; returns their SHA-256. One stream, no text in memory."""
        jvm = self.spark._jvm
        digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
        out = jvm.java.util.zip.GZIPOutputStream(self._fs(target).create(self._path(target), False))
        try:
            for part in parts:
                stream = jvm.java.security.DigestInputStream(self.fs.open(self._path(part)), digest)
                try:
                    stream.transferTo(out)
                finally:
                    stream.close()
        finally:
            out.close()
        return bytes(digest.digest()).hex()

    def roll(self, archive: str | None = None, threshold: int = 1, force: bool = False) -> dict | None:
        """Seal the log into a compressed segment of the archive and begin anew; None below the threshold.

        Refused unless the log is append-only (records only, each key once), but with force.
        The segment holds the log's bytes as they are, torn tails included.
        """
        archive = (archive or self.archive).rstrip("/")
        with self._locked():
            at = self.snapshot()
            if at.size < max(threshold, 1):
                return None
            dups, tombs = (0, 0) if force else self.append_only_violations(at)
            if dups or tombs:
                raise StoreError(
                    "UNSAFE_ROLL", f"{self.path} isn't append-only: {dups} repeated keys and {tombs} tombstones", updated_keys=dups, tombstones=tombs,
                    help=["A segment isn't folded again: what it holds can't be read by key any more", f"Run `contractlog compact -f {self.path}` first, or roll with --force"],
                )
            fs = self._fs(archive)
            stamp = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
            names = (f"{self.stem}-{stamp}{f'-{k}' if k else ''}.jsonl.gz" for k in range(1000))
            try:
                fs.mkdirs(self._path(archive))
                name = next(n for n in names if not fs.exists(self._path(f"{archive}/{n}")))
                sha256 = self._sealed(at.parts, f"{archive}/{name}")
            except Py4JError as e:
                raise StoreError("IO_ERROR", f"cannot archive into {archive}: {str(e).splitlines()[0]}") from e
            records = self.lines(at).where(F.trim(F.regexp_replace("raw", classify.BLANKS, "")) != "").count()
            row = {
                "segment": name, "records": records, "bytes": at.size, "gz_bytes": fs.getFileStatus(self._path(f"{archive}/{name}")).getLen(),
                "sha256": sha256, "rolled_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
            }
            manifest = self.manifest(archive)
            manifest.put(manifest.incoming([row]))
            self._create(f"{archive}/schema-manifest.yaml", SEGMENT_TEXT)
            if not self._replace(None, at):
                manifest.delete([name])
                fs.delete(self._path(f"{archive}/{name}"), False)
                raise StoreError("IO_ERROR", "the log changed while it was sealed")
        return row

    def manifest(self, archive: str | None = None) -> "Store":
        """The store of an archive's segments; its contract lies beside it."""
        return open_store(self.spark, f"{archive or self.archive}/manifest.jsonl", SEGMENT)

    def audit(self, archive: str | None = None) -> list[dict]:
        """Segments of the manifest with ok: whether their bytes and digest are what it says. One stream a segment."""
        archive = (archive or self.archive).rstrip("/")
        jvm, out = self.spark._jvm, []
        for row in self.manifest(archive).live().orderBy("pos").toLocalIterator():
            told = json.loads(row.record)
            digest, stream, ok = jvm.java.security.MessageDigest.getInstance("SHA-256"), None, False
            try:  # a segment that is missing or can't be read isn't what the manifest says
                raw = self._fs(archive).open(self._path(f"{archive}/{told['segment']}"))
                stream = jvm.java.security.DigestInputStream(jvm.java.util.zip.GZIPInputStream(raw), digest)
                size = stream.transferTo(jvm.java.io.OutputStream.nullOutputStream())
                ok = size == told["bytes"] and bytes(digest.digest()).hex() == told["sha256"]
            except Py4JError:
                pass
            finally:
                if stream is not None:
                    stream.close()
            out.append({"segment": told["segment"], "ok": ok})
        return out


class FileStore(Store):
    """A log in one file on the driver's disk."""

    def __init__(self, spark: SparkSession, path: str, contract: Contract | str):
        super().__init__(spark, path, contract)
        self.local = self._path(self.path).toUri().getPath()

    @contextmanager
    def _locked(self):
        with open(f"{self.local}.lock", "a") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def snapshot(self) -> Snapshot:
        if not os.path.exists(self.local):
            return Snapshot(0, (), 0, 0)
        s = os.stat(self.local)
        return Snapshot(0, (self.path,) if s.st_size else (), s.st_size, int(s.st_mtime * 1000))

    def _state(self, at: Snapshot) -> tuple[DataFrame | None, int]:
        return None, 0  # one file: what came after a place in it can't be read without the rest

    def refresh_index(self) -> None:
        pass

    def _grown(self) -> None:
        pass

    @staticmethod
    def _stream(rows: DataFrame, f) -> None:
        for r in rows.toLocalIterator():
            f.write(r.record.encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())

    def _append(self, rows: DataFrame, at: Snapshot) -> bool:
        with open(self.local, "ab+") as f:
            if f.seek(0, os.SEEK_END):
                f.seek(-1, os.SEEK_END)
                if f.read(1) != b"\n":  # a torn tail would swallow the next line
                    f.write(b"\n")
            self._stream(rows, f)
        return True

    def _replace(self, rows: DataFrame | None, at: Snapshot) -> bool:
        new = f"{self.local}.{uuid.uuid4().hex}.new"
        try:
            with open(new, "wb") as f:
                if rows is not None:
                    self._stream(rows, f)
            os.replace(new, self.local)
        finally:
            if os.path.exists(new):
                os.unlink(new)
        folder = os.open(os.path.dirname(os.path.abspath(self.local)), os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)
        return True

    @property
    def quarantine_path(self) -> str:
        return f"{self.local}.quarantine"

    def _quarantined(self, bad: DataFrame, at: Snapshot) -> None:
        lines = bad.orderBy("offset").select(F.to_json(F.struct("offset", "line", "reason", "raw"), {"ignoreNullFields": "false"}).alias("record"))
        with open(self.quarantine_path, "ab") as f:
            self._stream(lines, f)

    def quarantine(self) -> DataFrame:
        there = os.path.exists(self.quarantine_path)
        return self.spark.read.schema(QUARANTINE).json(f"file://{os.path.abspath(self.quarantine_path)}") if there else self.spark.createDataFrame([], QUARANTINE)

    @property
    def archive(self) -> str:
        return os.path.join(os.path.dirname(os.path.abspath(self.local)), "archive")


def open_store(spark: SparkSession, path: str, contract: Contract | str) -> Store:
    """The store at a path: a file if it is one or, on the driver's disk, is called .jsonl; a folder otherwise."""
    store = Store(spark, path, contract)
    at = store._path(store.path)
    local = store.fs.getScheme() == "file"
    is_file = store.fs.exists(at) and store.fs.getFileStatus(at).isFile()
    named = path.endswith(".jsonl") and not store.fs.exists(at)
    return FileStore(spark, path, contract) if local and (is_file or named) else store
