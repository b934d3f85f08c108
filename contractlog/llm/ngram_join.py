"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two sets of sizes
x <= y are similar when ``(100 + T) * common >= T * (x + y)`` (Jaccard >= T / 100, in
integers). The steps (after Xiao et al., "Efficient Similarity Joins for Near Duplicate
Detection", 2008):

1. **marks**: an n-gram that stands in one document only joins nothing, and a set whose
   n-grams are repeated for less than T per cent has no partner at all. One pass over the
   texts sends a 32-bit fingerprint of each n-gram, once from each group of documents, to one
   of ``buckets`` tables; what comes back is how many of its n-grams each document shares.
   Fingerprints that are equal by chance let a document pass in vain, never the reverse.
   The buckets are as many as the text is long, nothing of them is broadcast, and an n-gram
   that half of all documents hold costs one entry of each group.
2. **classes**: of what is left, documents with equal sets are one *class*; the row of its
   least id stands for it, by a 64-bit key of (id, text): an id can stand on several texts,
   and is a name only.
3. **postings**: exact frequencies of the classes' n-grams order them from rare to frequent;
   sets are judged by their repeated n-grams once more, and of each only the prefix is kept.
   Sizes x need the first ``x - ceil(2t x / (1 + t)) + 1`` n-grams against longer sets and the
   first ``x - ceil(t x) + 1`` against shorter ones; n-grams of one class come first and join
   nothing. Beside the length and positional filters, a bitmap filter (Sandes et al., "Bitmap
   Filter", 2020) holds back pairs early: 512 parities of each set, of which no more can
   differ than n-grams do.
4. **lists**: n-grams in the prefixes of two or more classes. In the first round every class
   of a list is paired with one *anchor* of the list, and what has been verified becomes
   links. Then the classes outside a list's largest component are paired with an anchor of
   that component; classes that are connected already need no further pair. Thousands of near
   copies thus cost a few pairs each and not a pair for every two of them.
5. **rest**: for lists that still join several components, every pair between different
   components, reached from the members outside the list's largest component. Sizes are part
   of the join's key, by bands that are as wide as the length filter. This step leaves out
   nothing that the filters let pass: rounds only make it small. Here all n-grams that two prefixes share are known, and their number
   bounds the intersection as well.
6. **verify**: each pair once, by the suffix filter (the sets' sizes between fixed pivots
   bound their difference) and then by the exact intersection.

A false equality of two hashes within one pair has a probability below
``(x + y) ** 2 / 2 ** 64``. A null text is an empty text: no n-gram, no link. A text with
fewer words than n has its whole sequence as its only n-gram. A null id links with nothing
and has a null component. Repeated ids are judged row by row. Extra columns are ignored. Keys
are salted anew until no two rows of one key differ in id or set. An empty table gives an
empty result; a very long text is one group of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractlog.llm.common import MOST_FILTER_BITS, Scratch, filter_bits, maybe_member, membership
from contractlog.llm.components import components

WORDS = 5
PERCENT = 75
#: Text whose marks are gathered before they are sent, and text for each bucket of marks: what a task holds of either.
GROUP_BYTES = 1 << 22
BUCKET_BYTES = 1 << 22
LEAST_BUCKETS = 8
#: Documents of a group at most: they are numbered in 16 bits, of which the last number says "several". Marks in one row.
SEVERAL = (1 << 16) - 1
MARKS_IN_ROW = 1 << 12
#: Rounds of anchors before the exact rest, at every size.
ROUNDS = 2
#: Text that one task splits into words at once.
SLICE_BYTES = 1 << 20
#: Rows of one Arrow batch that a task hands back.
BATCH_ROWS = 1 << 17
SUFFIX_PIVOTS = 16
#: Columns of the parity bitmap, of 64 bits each; as many as a power of two.
BITMAP = tuple(f"w{k}" for k in range(8))

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct n-gram hashes of texts; A-Z count as a-z, words are [^\\x20\\x09-\\x0D]+."""

    def __init__(self, n: int = WORDS):
        self.n = n
        self.factors = [np.uint64(pow(_BASE, k + 1, 1 << 64) | 1) for k in range(n)]

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, words before each text)"""
        texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))  # a copy from 0 on: ascii_lower misreads slices that were cast
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat, ends = split.flatten(), np.asarray(split.offsets).astype(np.int64)
        ends -= ends[0]
        some = np.asarray(pc.greater(pc.binary_length(flat), 0))  # white space at an end leaves an empty part
        if not some.all():
            ends, flat = np.concatenate([[0], np.cumsum(some)])[ends], flat.filter(pa.array(some))
        coded = flat.dictionary_encode()
        known = np.array([xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
        return known[np.asarray(coded.indices)] if len(flat) else np.empty(0, np.uint64), ends

    def __call__(self, texts: pa.Array):
        """The set of each text."""
        w, ends = self._words(texts)
        n = self.n
        h = np.zeros(max(0, len(w) - n + 1), np.uint64)
        for k in range(n):
            h += w[k : k + len(h)] * self.factors[k]
        h = _mixed(h)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= n:
                s = np.sort(h[a : b - n + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                x = np.array([b - a], np.uint64)
                for k in range(b - a):
                    x = _mixed((x ^ w[a + k]) * self.factors[k] + np.uint64(k + 1))
                yield x
            else:
                yield np.empty(0, np.uint64)


def _slices(batches):
    """Batches of about SLICE_BYTES of text, by whole rows."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_BYTES)) + 1
            yield batch.slice(start, end - start)
            start = end


def _texts(batches, n: int):
    """(id, set) of every row; ids may be null."""
    shingle = Shingler(n)
    for batch in _slices(batches):
        yield from zip(batch.column(0).to_pylist(), shingle(batch.column(1)))


def _parities(s: np.ndarray) -> np.ndarray:
    """Of each bucket whether it holds an odd number of the n-grams, as integers of 64 bits."""
    buckets = 64 * len(BITMAP)
    odd = np.bincount((s >> np.uint64(65 - buckets.bit_length())).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: A row is a document (the columns from id on) or marks of a group in a bucket (prints and who).
MARKS = "bucket int, grp long, prints binary, who binary, id long, doc long, n long, digest binary, at int, own long"
_MARKS = pa.schema([
    ("bucket", pa.int32()), ("grp", pa.int64()), ("prints", pa.binary()), ("who", pa.binary()), ("id", pa.int64()),
    ("doc", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("at", pa.int32()), ("own", pa.int64()),
])


def _batch(rows: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The columns that are given, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


class _Group:
    """Documents whose marks are sent together: an n-gram that several of them hold is sent once."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.ids, self.docs, self.sizes, self.digests, self.sets, self.sent_by = [], [], [], [], [], []

    def add(self, i, doc, s: np.ndarray) -> None:
        if doc is not None and len(s):
            self.sent_by.append(len(self.ids))
            self.sets.append(s)
        self.ids.append(i)
        self.docs.append(doc)
        self.sizes.append(len(s))
        self.digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)

    def batches(self):
        own = np.zeros(len(self.ids), np.int64)
        if self.sets:
            h = np.concatenate(self.sets)
            who = np.repeat(np.array(self.sent_by, np.uint16), [len(s) for s in self.sets])
            order = np.argsort(h, kind="stable")
            h, who = h[order], who[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            starts = np.flatnonzero(first)
            several = np.diff(np.append(starts, len(h))) > 1
            own += np.bincount(who[np.repeat(several, np.diff(np.append(starts, len(h))))], minlength=len(own))
            h, who = h[starts], np.where(several, np.uint16(SEVERAL), who[starts])
            bucket = (h & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets)
            order = np.argsort(bucket << np.uint64(16) | who, kind="stable")
            bucket, who, prints = bucket[order], who[order], (h[order] >> np.uint64(32)).astype(np.uint32)
            edges = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=np.uint64))
            cuts = [(k, at, min(at + MARKS_IN_ROW, int(edges[k + 1]))) for k in range(self.buckets) for at in range(int(edges[k]), int(edges[k + 1]), MARKS_IN_ROW)]
            for some in (cuts[k : k + 256] for k in range(0, len(cuts), 256)):
                yield _batch(
                    len(some), _MARKS, bucket=[k for k, _, _ in some], grp=[self.number] * len(some),
                    prints=[prints[a:b].tobytes() for _, a, b in some], who=[who[a:b].tobytes() for _, a, b in some],
                )
        at = np.arange(len(self.ids), dtype=np.int32)
        yield _batch(
            len(self.ids), _MARKS, bucket=at % self.buckets, grp=[self.number] * len(self.ids),
            id=self.ids, doc=self.docs, n=self.sizes, digest=self.digests, at=at, own=own,
        )


def _marks(n: int, buckets: int):
    """Rows of MARKS of texts (id, text, doc)."""

    def run(batches):
        shingle, made = Shingler(n), TaskContext.get().partitionId() << 32
        group, held = _Group(made, buckets), 0
        for batch in _slices(batches):
            for i, doc, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle(batch.column(1))):
                group.add(i, doc, s)
                if len(group.ids) == SEVERAL:
                    yield from group.batches()
                    made, held = made + 1, 0
                    group = _Group(made, buckets)
            held += batch.column(1).nbytes
            if held >= GROUP_BYTES:
                yield from group.batches()
                made, held = made + 1, 0
                group = _Group(made, buckets)
        yield from group.batches()

    return run


def _of_several(rows: list[tuple[int, np.ndarray, np.ndarray]]):
    """(group, who) of the marks of one bucket that several documents hold, but for those that a group has counted itself."""
    prints = np.concatenate([p for _, p, _ in rows])
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    several = np.concatenate([w for _, _, w in rows]) == SEVERAL
    shared = (np.diff(np.append(starts, len(prints))) > 1) | np.logical_or.reduceat(several[order], starts)
    flags = np.empty(len(prints), bool)
    flags[order] = np.repeat(shared, np.diff(np.append(starts, len(prints))))
    flags &= ~several
    at = 0
    for grp, p, w in rows:
        found = w[flags[at : at + len(p)]]
        at += len(p)
        if len(found):
            yield grp, found.tobytes()


def _shared(batches):
    """Rows of MARKS in order of their buckets, with who naming each document once for each n-gram that it shares."""

    def settled(rows):
        found = list(_of_several(rows))
        for some in (found[k : k + 256] for k in range(0, len(found), 256)):
            yield _batch(len(some), _MARKS, grp=[g for g, _ in some], who=[w for _, w in some])

    rows, last = [], None
    for batch in batches:
        marks = batch.column(2).is_valid()
        docs = batch.filter(pc.invert(marks))
        if docs.num_rows:
            yield docs
        batch = batch.filter(marks)
        for bucket, grp, prints, who in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if bucket != last and rows:
                yield from settled(rows)
                rows = []
            last = bucket
            rows.append((grp, np.frombuffer(prints.as_py(), np.uint32), np.frombuffer(who.as_py(), np.uint16)))
    if rows:
        yield from settled(rows)


PROFILE = "id long, doc long, n long, digest binary, maybe boolean"


def _judged(percent: int):
    """Rows of _shared, group by group and marks before documents, as the profile of the documents."""

    def run(batches):
        grp, counts = None, np.zeros(SEVERAL, np.int64)
        for batch in batches:
            groups = np.asarray(batch.column(1))
            edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]])) if len(groups) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if groups[a] != grp:
                    grp, counts = groups[a], np.zeros(SEVERAL, np.int64)
                part = batch.slice(a, b - a)
                marks = part.column(3).is_valid()
                for who in part.column(3).filter(marks).to_pylist():
                    counts += np.bincount(np.frombuffer(who, np.uint16), minlength=SEVERAL)
                docs = part.filter(pc.invert(marks))
                if docs.num_rows:
                    n = np.asarray(docs.column(6))
                    shared = np.asarray(docs.column(9)) + counts[np.asarray(docs.column(8))]
                    maybe = (n > 0) & (100 * shared >= percent * n) & np.asarray(docs.column(5).is_valid())
                    yield pa.RecordBatch.from_arrays([docs.column(k) for k in (4, 5, 6, 7)] + [pa.array(maybe)], ["id", "doc", "n", "digest", "maybe"])

    return run


def _ceil(a, b: int):
    return -(-a // b)


SETS = f"id long, n long, {', '.join(f'{w} long' for w in BITMAP)}, s binary"


def _sets(n: int):
    """Rows of SETS of texts (id, text)."""

    def run(batches):
        ids, sets, held = [], [], 0

        def rows():
            words = np.array([_parities(s) for s in sets], np.int64).reshape(-1, len(BITMAP)).T
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array(np.ascontiguousarray(w)) for w in words), pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["id", "n", *BITMAP, "s"],
            )

        for i, s in _texts(batches, n):
            ids.append(i)
            sets.append(s)
            held += len(s)
            if held >= BATCH_ROWS:
                yield rows()
                ids, sets, held = [], [], 0
        yield rows()

    return run


def _ngrams(batches):
    """(h, id, n) of each n-gram of sets (id, n, s)."""
    for batch in batches:
        out, held = [], 0
        for i, n, s in zip(*(batch.column(k).to_pylist() for k in range(3))):
            out.append((np.frombuffer(s, np.int64), np.full(n, i, np.int64), np.full(n, n, np.int32)))
            held += n
            if held >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h", "id", "n"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h", "id", "n"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int, pivots: np.ndarray) -> bool:
    both = len(a) + len(b)
    need = _ceil(percent * both, 100 + percent)
    # suffix filter: what differs is at least the sum of the differences between pivots
    if np.abs(np.diff(np.searchsorted(a, pivots)) - np.diff(np.searchsorted(b, pivots))).sum() > both - 2 * need:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return (100 + percent) * int((b[at] == a).sum()) >= percent * both


def _verify(percent: int):
    pivots = (np.arange(SUFFIX_PIVOTS + 1, dtype=np.float64) * (2.0**64 / SUFFIX_PIVOTS)).clip(0, 2.0**64 - 4096).astype(np.uint64)
    pivots[-1] = np.uint64(0xFFFFFFFFFFFFFFFF)

    def run(batches):
        for batch in batches:
            keep = [
                _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent, pivots)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _key(salt: int, id_col: str, text_col: str) -> Column:
    """The key of a row, in 64 bits."""
    return F.xxhash64(F.lit(salt), F.col(id_col).cast("long"), F.col(text_col))


class NgramJoin:
    """Links of one table; see the module. ``percent`` and ``n`` are the contract's 75 and 5."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT):
        self.rows = lambda salt: docs.select(_key(salt, id_col, text_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc"))
        self.n, self.percent, self.scratch = n, percent, Scratch(docs.sparkSession, "ngrams")
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
        self.buckets = LEAST_BUCKETS + size // BUCKET_BYTES

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(profile of every row: key, id, n, digest as id, doc, n, digest), (key of a class's row, component: such a key)."""
        self.salt = 0
        while True:
            profile = self._profile()
            other = F.xxhash64("doc", "digest")
            if profile.groupBy("id").agg(F.min(other).alias("x"), F.max(other).alias("y")).where("x <> y").isEmpty():
                break
            self.salt += 1
        self.scratch.tidy()
        self._classes(profile.where("maybe"))
        lists = self._lists()
        self.scratch.tidy()
        self.found = None
        for k in range(ROUNDS):
            self._connect(self._anchored(lists, k), k)
            lists, left = self._mixed(lists, k)
            if not left:
                return profile, self.found
        self._connect(self._rest(lists), ROUNDS)
        return profile, self.found

    def _profile(self) -> DataFrame:
        """Rows of PROFILE, one of each document; maybe: enough of its n-grams stand in other documents too."""
        marks = self.rows(self.salt).mapInArrow(_marks(self.n, self.buckets), MARKS)
        shared = marks.repartition(self.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, MARKS)
        shared = shared.repartition(self.buckets, "grp").sortWithinPartitions("grp", F.col("who").isNull())
        return self.scratch.write(shared.mapInArrow(_judged(self.percent), PROFILE), f"profile-{self.salt}")

    def _connect(self, pairs: DataFrame, k: int) -> None:
        """Verify pairs and join what their links connect; each node's link to its least one stands for earlier links."""
        links = self.scratch.write(self._verified(pairs, k), f"links-{k}")
        self.scratch.forget(f"pairs-{k}")
        if self.found is not None:
            links = links.unionByName(self.found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.found = components(links, self.scratch, f"cc-{k}")
        self.scratch.tidy()

    def _classes(self, found: DataFrame) -> None:
        """The set of each class, by the key that stands for it."""
        reps = found.groupBy("digest").agg(F.min(F.struct("doc", "id")).alias("rep")).select("rep.id")
        reps = self.scratch.write(reps, "classes")
        docs, count = self.rows(self.salt).select("id", "text"), reps.count()
        if 8 * count <= MOST_FILTER_BITS:  # beyond that the filter would let too many pass, and texts are shuffled
            bits = filter_bits(4 * count)  # 32 a class while they last: what passes in vain has its set shuffled
            docs = maybe_member(docs, "id", membership(reps, "id", bits), bits).where("maybe").select("id", "text")
            sets = docs.mapInArrow(_sets(self.n), SETS).join(reps, "id", "left_semi")
        else:
            sets = docs.join(reps, "id", "left_semi").mapInArrow(_sets(self.n), SETS)
        self.sets = self.scratch.write(sets.dropDuplicates(["id"]), "sets")
        self.scratch.tidy()

    def _lists(self) -> DataFrame:
        """Prefix postings of the n-grams that stand in the prefixes of two classes or more."""
        p = self.percent
        ngrams = self.sets.select("id", "n", "s").mapInArrow(_ngrams, "h long, id long, n int")
        often = self.scratch.write(ngrams.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "often")
        self.scratch.tidy()  # the shuffles of each step go before the next one's come
        shared = ngrams.join(often, "h")
        of = Window.partitionBy("id")
        ranked = shared.withColumn("nth", F.row_number().over(of.orderBy("c", "h"))).withColumn("all", F.count("*").over(of))
        ranked = ranked.where(f"100L * all >= {p}L * n").withColumn("pos", F.expr("cast(n - all + nth as int)"))
        prefix = ranked.where(f"pos <= n - ceil({p} * n / 100) + 1").select("h", "id", "n", "pos")
        prefix = self.scratch.write(prefix, "prefix")
        self.scratch.forget("often")
        self.scratch.tidy()
        several = prefix.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
        listed = prefix.join(several, "h").join(self.sets.select("id", *BITMAP), "id")
        listed = listed.withColumn("early", F.expr(f"pos <= n - ceil({2 * p} * n / {100 + p}) + 1"))
        listed = self.scratch.write(listed.withColumn("comp", F.col("id")), "lists")
        self.scratch.forget("prefix")
        return listed

    def _close(self) -> F.Column:
        """Length, positional and bitmap filters on the columns of two lists, those of the second ending in 2."""
        p = self.percent
        return F.expr(
            f"100 * least(n, n2) >= {p} * greatest(n, n2)"
            f" and {100 + p} * (1L + least(n - pos, n2 - pos2)) >= {p} * (n + n2)"
            " and ((early and n <= n2) or (early2 and n2 <= n))"
            f" and {' + '.join(f'bit_count({w} ^ {w}2)' for w in BITMAP)} <= n + n2 - 2 * ceil({p} * (n + n2) / {100 + p})"
        )

    def _band(self) -> Column:
        """Sizes that the length filter lets meet lie in one band or in neighbouring ones."""
        width = math.log(100 / self.percent) * 1.000001 if self.percent < 100 else math.log(2)
        return F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")

    @staticmethod
    def _other(lists: DataFrame, *more: str) -> DataFrame:
        return lists.select("h", *more, *(F.col(c).alias(f"{c}2") for c in ("id", "n", "pos", "early", "comp", *BITMAP)))

    @staticmethod
    def _pairs(joined: DataFrame) -> DataFrame:
        return joined.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()

    def _anchored(self, lists: DataFrame, k: int) -> DataFrame:
        """Each class of a list with the list's anchor; later those outside its largest component with an anchor of that."""
        rank = F.xxhash64("id", F.lit(k), *(["h"] if k else []))
        one = F.min(F.struct(rank.alias("r"), "id", "n", "pos", "early", "comp", *BITMAP)).alias("one")
        if k:
            anchors, lists = lists.where("comp = top").groupBy("h").agg(one), lists.where("comp <> top")
        else:
            anchors = lists.groupBy("h").agg(one)
        anchors = self._other(anchors.select("h", "one.*"))
        return self._pairs(lists.join(anchors, "h").where((F.col("comp") != F.col("comp2")) & self._close()))

    def _mixed(self, lists: DataFrame, k: int) -> tuple[DataFrame, bool]:
        """The lists that still meet several components, with the largest one of each (top), and whether there are any."""
        found = self.found.select(F.col("node").alias("id"), F.col("component"))
        lists = lists.drop("comp", "top")

        def now(rows: DataFrame) -> DataFrame:
            return rows.join(found, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

        by = now(lists.select("h", "id")).groupBy("h", "comp").agg(F.count("*").alias("c"))
        by = by.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
        tops = self.scratch.write(by.select("h", F.col("top.comp").alias("top")), f"tops-{k}")
        left = not tops.isEmpty()
        mixed = self.scratch.write(now(lists.join(tops, "h")), f"lists-{k}")
        self.scratch.forget(f"tops-{k}", f"lists-{k - 1}" if k else "lists")
        self.scratch.tidy()
        return mixed, left

    def _rest(self, lists: DataFrame) -> DataFrame:
        """All pairs of different components; one of each is outside its list's largest component.

        A pair meets in every list of an n-gram that both prefixes hold, up to the last one that
        the positional filter lets pass; what follows that one is at most the shorter remainder.
        """
        lists = lists.withColumn("band", self._band())
        few = lists.where("comp <> top")
        few = few.withColumn("band", F.explode(F.expr("array(band - 1, band, band + 1)")))
        met = few.join(self._other(lists, "band"), ["h", "band"]).where(
            (F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("top")) | (F.col("id") < F.col("id2"))) & self._close()
        )
        pairs = met.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).agg(
            F.count("*").alias("met"), F.min(F.expr("least(n - pos, n2 - pos2)")).alias("more"), F.min(F.expr("n + n2")).alias("both")
        )
        return pairs.where(f"{100 + self.percent} * (met + more) >= {self.percent} * both").select("a", "b")

    def _verified(self, pairs: DataFrame, k: int) -> DataFrame:
        pairs, sets = self.scratch.write(pairs, f"pairs-{k}"), self.sets.select("id", "s")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s1")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s2")), "b")
        return both.select("a", "b", "s1", "s2").mapInArrow(_verify(self.percent), "a long, b long")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the least id that links reach)."""
    profile, found = NgramJoin(docs, id_col, text_col, n, percent).run()
    return _labelled(profile, found).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _labelled(profile: DataFrame, found: DataFrame) -> DataFrame:
    """The profile with the component's least id, and whether the row is of the class and id that stand for the component."""
    reps = profile.where("digest is not null and doc is not null").groupBy("digest").agg(F.min(F.struct("doc", "id")).alias("rep"))
    reps = reps.select("digest", F.col("rep.doc").alias("least"), F.col("rep.id").alias("node"))
    linked = found.join(reps, "node")
    heads = linked.groupBy("component").agg(F.min(F.struct("least", "node")).alias("head"))
    linked = linked.join(heads, "component").select("node", "head")
    known = reps.join(linked, "node", "left").select("digest", F.coalesce("head.least", "least").alias("c"), F.coalesce(F.col("head.node") == F.col("node"), F.lit(True)).alias("first"))
    return profile.join(known, "digest", "left").select(
        "id", "doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("c", "doc")).alias("component"),
        F.expr("doc is null or c is null or (first and doc = c)").alias("stands"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the least id. Rows without an id stay.

    Rows are dropped by class: another text of the least id goes if it is a near copy, and stays if it isn't.
    """
    join = NgramJoin(docs, id_col, text_col, n, percent)
    key = "_key"
    while key in docs.columns:
        key += "_"
    dropped = _labelled(*join.run()).where("not stands").select(F.col("id").alias(key)).distinct()
    return docs.withColumn(key, _key(join.salt, id_col, text_col)).join(dropped, key, "left_anti").select(*(_named(c) for c in docs.columns))
