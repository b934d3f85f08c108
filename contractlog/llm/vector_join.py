"""Embedding near-dedup: epsilon grid order join of vectors by cosine.

Vectors are scaled to length one, where ``cosine >= c`` means a distance of at most
``eps = sqrt(2 - 2c)``. The join (after Boehm et al., "Epsilon Grid Order", 2001):

1. equal vectors of a label become one *point* with a multiplicity, so that thousands of
   copies are compared once;
2. the points of a label are sorted by the grid cells (width eps) of their leading
   principal dimensions, and cut into *blocks* of BLOCK points that follow each other;
3. blocks and, above them, intervals of FAN blocks carry the bounds of their points in the
   principal dimensions. Pairs of intervals are refined from the top; a pair whose bounds
   are further apart than eps in those dimensions is skipped with all below it (a
   projection never lengthens a distance, so nothing is lost);
4. each remaining pair of blocks is one matrix product in double precision; a cosine within
   1e-9 of the threshold is computed again as ``a.b / (|a| |b|)`` from the stored values.

A pair of blocks yields, for each point, how many vectors it is linked to there, and a
spanning forest of its links: at most as many rows as points, whatever the links. The
components of all forests are those of all links.

Vectors link only within equal, non-null labels (and equal lengths). A null or zero vector,
or one with null or non-finite components, links with nothing; so does a row with a null
id, whose component is null. There is one row for each row: points have keys of their own, so
rows that repeat an id count as vectors of their own in n_links, and share a component if they
are linked; a component's name is its least id. Other columns are ignored.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlog.llm.common import Scratch
from contractlog.llm.components import components

COSINE = 0.93
BLOCK = 512
FAN = 8
#: Leading principal dimensions: of the sort order, and of the bounds.
SORT_DIMS, BOUND_DIMS = 4, 16
#: Top intervals of a label that are all paired; more levels are laid on until no label has more.
TOP = 32
#: Distances are compared with this much room, for rounding in the projection.
SLACK = 1e-6


def _usable(vec, dtype=np.float64):
    """The vector as doubles, or None if it links with nothing."""
    if vec is None or not len(vec):
        return None
    x = np.array([np.nan if v is None else v for v in vec], dtype)
    return x if np.isfinite(x).all() and x.any() else None


def _points(batches):
    """(id, label, dim, raw) of every row; raw: the components as doubles, null where nothing can link."""
    for batch in (b.slice(k, 2048) for b in batches for k in range(0, b.num_rows, 2048)):
        ids, labels, dims, raws = [], [], [], []
        for i, vec, label in zip(*(c.to_pylist() for c in batch.columns[:3])):
            x = None if i is None or label is None else _usable(vec)
            ids.append(i)
            labels.append(label)
            dims.append(None if x is None else len(x))
            raws.append(None if x is None else (x + 0.0).tobytes())  # -0.0 becomes 0.0
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())],
            ["id", "label", "dim", "raw"],
        )


def _unit(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.float64)
    x = x / np.abs(x).max()
    return x / sqrt(float(x @ x))


def _moments(batches):
    """Of each length: count, sum and second moments of the unit vectors of one task."""
    held: dict[int, list] = {}
    for batch in batches:
        by: dict[int, list] = {}
        for dim, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(dim, []).append(_unit(raw))
        for dim, rows in by.items():
            x = np.array(rows)
            h = held.setdefault(dim, [0, np.zeros(dim), np.zeros((dim, dim))])
            h[0] += len(x)
            h[1] += x.sum(0)
            h[2] += x.T @ x
    yield _moment_rows(held)


def _moment_rows(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.int32()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1].tobytes() for h in held.values()], pa.binary()), pa.array([h[2].tobytes() for h in held.values()], pa.binary())],
        ["dim", "n", "s", "m"],
    )


def _summed_moments(batches):
    held: dict[int, list] = {}
    for batch in batches:
        for dim, n, s, m in zip(*(c.to_pylist() for c in batch.columns)):
            h = held.setdefault(dim, [0, np.zeros(dim), np.zeros((dim, dim))])
            h[0] += n
            h[1] += np.frombuffer(s)
            h[2] += np.frombuffer(m).reshape(dim, dim)
    yield _moment_rows(held)


def principal(points: DataFrame) -> dict[int, np.ndarray]:
    """Of each vector length the leading principal directions (rows) of all its unit vectors."""
    schema = "dim int, n long, s binary, m binary"
    parts = points.select("dim", "raw").mapInArrow(_moments, schema).repartition(4, "dim").mapInArrow(_summed_moments, schema)
    axes = {}
    for r in parts.collect():  # one row for each length: length ** 2 doubles
        mean = np.frombuffer(r.s) / r.n
        cov = np.frombuffer(r.m).reshape(r.dim, r.dim) / r.n - np.outer(mean, mean)
        axes[r.dim] = np.linalg.eigh(cov)[1][:, ::-1][:, :BOUND_DIMS].T.copy()
    return axes


def _cells(axes, eps: float):
    def run(batches):
        for batch in batches:
            cells, proj = [], []
            for dim, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p = axes.value[dim] @ _unit(raw)
                cells.append(np.floor(np.pad(p, (0, SORT_DIMS))[:SORT_DIMS] / eps).astype(np.int32))
                proj.append(p.tobytes())
            cells = np.array(cells, np.int32).reshape(-1, SORT_DIMS)
            cols = [pa.array(np.ascontiguousarray(cells[:, k])) for k in range(SORT_DIMS)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(proj, pa.binary()), *cols], [*batch.schema.names, "proj", *(f"c{k}" for k in range(SORT_DIMS))]
            )

    return run


BLOCKS = "label string, dim int, block long, ids array<long>, counts array<long>, raws binary, low binary, high binary"


def _blocked(block: int):
    """Sorted points of one partition as blocks; each holds points of one label and length."""

    def pack(rows, number):
        proj = np.array([np.frombuffer(r[5]) for r in rows])
        return (rows[0][1], rows[0][2], number, [r[0] for r in rows], [r[4] for r in rows], b"".join(r[3] for r in rows), proj.min(0).tobytes(), proj.max(0).tobytes())

    def batch_of(blocks):
        types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        cols = zip(*blocks) if blocks else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["label", "dim", "block", "ids", "counts", "raws", "low", "high"])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        rows, out = [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (len(rows) == block or rows[0][1:3] != r[1:3]):
                    out.append(pack(rows, number))
                    number += 1
                    rows = []
                rows.append(r)
            if len(out) >= 8:
                yield batch_of(out)
                out = []
        if rows:
            out.append(pack(rows, number))
        yield batch_of(out)

    return run


def _compare(cosine: float):
    def matrix(raws, dim):
        x = np.frombuffer(raws).reshape(-1, dim)
        y = x / np.abs(x).max(1, keepdims=True)
        return x, y / np.sqrt((y * y).sum(1, keepdims=True))

    def exact(a, b):
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return float(a @ b) / (sqrt(float(a @ a)) * sqrt(float(b @ b)))

    def run(batches):
        for batch in batches:
            nodes, links, least = [], [], []
            for dim, same, ids1, n1, r1, ids2, n2, r2 in zip(*(c.to_pylist() for c in batch.columns)):
                x, ux = matrix(r1, dim)
                y, uy = (x, ux) if same else matrix(r2, dim)
                cos = ux @ uy.T
                hit = cos >= cosine
                for i, j in zip(*np.nonzero(np.abs(cos - cosine) < 1e-9)):
                    hit[i, j] = exact(x[i], y[j]) >= cosine
                if same:
                    np.fill_diagonal(hit, False)
                    hit |= hit.T
                a, b, n1, n2 = np.array(ids1), np.array(ids2), np.array(n1), np.array(n2)
                by1 = hit @ n2
                by2 = [] if same else n1 @ hit
                for ids, by in ((a, by1), (b, by2)):
                    for i, n in zip(ids.tolist(), np.asarray(by).tolist()):
                        if n:
                            nodes.append(i)
                            links.append(n)
                            least.append(None)
                for i, j in _forest(hit, same):
                    nodes.append(int(a[i]))
                    links.append(0)
                    least.append(int(b[j]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(least, pa.int64())], ["id", "links", "to"])

    return run


def _forest(hit: np.ndarray, same: bool):
    """Links (row, column) that connect what all links of one pair of blocks connect."""
    offset = 0 if same else hit.shape[0]
    up = list(range(offset + hit.shape[1]))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(hit.shape[0]):
        for j in np.nonzero(hit[i])[0].tolist():
            p, q = root(i), root(offset + j)
            if p != q:
                up[max(p, q)] = min(p, q)
                yield i, j


def _far(eps: float):
    """Whether two bounds (low, high, low2, high2: doubles in binary) are over eps apart."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            keep = np.zeros(n, bool)
            for k, bounds in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:6]))):
                low, high, low2, high2 = (np.frombuffer(x) for x in bounds)
                gap = np.maximum(0, np.maximum(low2 - high, low - high2))
                keep[k] = gap @ gap <= (eps + SLACK) ** 2
            yield pa.RecordBatch.from_arrays(batch.columns[:2], batch.schema.names[:2]).filter(pa.array(keep))

    return run


def _lifted(batches):
    """Bounds of intervals from those of their parts; parts of one interval follow each other."""
    held = None
    names = ["label", "dim", "node", "low", "high"]

    def row(h):
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0]], pa.string()), pa.array([h[1]], pa.int32()), pa.array([h[2]], pa.int64()), pa.array([h[3].tobytes()], pa.binary()), pa.array([h[4].tobytes()], pa.binary())], names
        )

    for batch in batches:
        for label, dim, node, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            low, high = np.frombuffer(low), np.frombuffer(high)
            if held and held[2] == node:
                held = (*held[:3], np.minimum(held[3], low), np.maximum(held[4], high))
            else:
                if held:
                    yield row(held)
                held = (label, dim, node, low, high)
    if held:
        yield row(held)


class GridJoin:
    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, label_col: str, cosine: float, block: int = BLOCK):
        self.rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
        self.cosine, self.block, self.eps = cosine, block, sqrt(max(0.0, 2 - 2 * cosine))
        self.scratch = Scratch(vectors.sparkSession, "grid")

    def blocks(self) -> DataFrame:
        write, sc = self.scratch.write, self.rows.sparkSession.sparkContext
        every = write(self.rows.mapInArrow(_points, "id long, label string, dim int, raw binary"), "every")
        keys = ["label", "dim", "raw"]
        self.alone = every.where("raw is null").select("id")
        every = every.where("raw is not null")
        points = every.groupBy(*keys).agg(F.min("id").alias("least"), F.count("*").alias("n"))
        # the key of a point is settled by writing it: ids can stand on several points
        points = write(points.select(F.monotonically_increasing_id().alias("id"), *keys, "n", "least"), "points")
        self.members = every.join(points.withColumnRenamed("id", "rep"), keys).select("id", "rep", "n", "least")
        self.points, points = points.select("id", "least"), points.drop("least")
        axes = sc.broadcast(principal(points))
        cells = [f"c{k}" for k in range(SORT_DIMS)]
        placed = points.mapInArrow(_cells(axes, self.eps), f"id long, label string, dim int, raw binary, n long, proj binary, {', '.join(f'{c} int' for c in cells)}")
        order = ["label", "dim", *cells, "id"]
        ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*cells)
        return write(ranged.mapInArrow(_blocked(self.block), BLOCKS), "blocks")

    def pairs(self, blocks: DataFrame) -> DataFrame:
        """(block, block2) with block <= block2 that may hold links, found from the top."""
        write = self.scratch.write
        number = blocks.select("label", "dim", "block", "low", "high")
        per = number.groupBy("label", "dim", F.expr("shiftright(block, 40)").alias("part")).agg(F.count("*").alias("c"))
        # numbers that follow each other within a label: as many rows here as labels meet partitions
        from pyspark.sql import Window

        w = Window.partitionBy("label", "dim").orderBy("part")
        base = per.withColumn("base", F.sum("c").over(w) - F.col("c"))
        first = number.groupBy("label", "dim", F.expr("shiftright(block, 40)").alias("part")).agg(F.min("block").alias("first"))
        base = base.join(first, ["label", "dim", "part"]).drop("c")
        seq = number.withColumn("part", F.expr("shiftright(block, 40)")).join(base, ["label", "dim", "part"])
        level = write(
            seq.select("label", "dim", (F.col("block") - F.col("first") + F.col("base")).alias("node"), "low", "high", "block"), "level-0"
        )
        self.numbered = level.select("label", "dim", "node", "block")
        levels = [level.drop("block")]
        while (levels[-1].groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0) > TOP:
            parts = levels[-1].select("label", "dim", F.expr(f"node div {FAN}").alias("node"), "low", "high")
            # FAN rows an interval; one label's intervals go to many partitions
            parts = parts.repartition("label", "dim", "node").sortWithinPartitions("label", "dim", "node")
            levels.append(write(parts.mapInArrow(_lifted_by_label, "label string, dim int, node long, low binary, high binary"), f"level-{len(levels)}"))
        found = None
        for k in range(len(levels) - 1, -1, -1):
            left = levels[k].select("label", "dim", F.col("node").alias("p"), "low", "high")
            right = levels[k].select("label", "dim", F.col("node").alias("q"), F.col("low").alias("low2"), F.col("high").alias("high2"))
            if found is None:  # at most TOP intervals a label
                both = left.join(right, ["label", "dim"]).where("p <= q")
            else:
                steps = F.expr(f"sequence(0, {FAN - 1})")
                below = found.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
                below = below.select("label", "dim", (F.col("p") * FAN + F.col("i")).alias("p"), (F.col("q") * FAN + F.col("j")).alias("q")).where("p <= q")
                both = below.join(left, ["label", "dim", "p"]).join(right, ["label", "dim", "q"])
            both = both.select(F.struct("label", "dim").alias("of"), F.struct("p", "q").alias("pq"), "low", "high", "low2", "high2")
            near = both.mapInArrow(_far(self.eps), "of struct<label:string,dim:int>, pq struct<p:long,q:long>")
            found = write(near.select("of.label", "of.dim", "pq.p", "pq.q"), f"near-{k}")
        one = self.numbered.select("label", "dim", F.col("node").alias("p"), "block")
        two = self.numbered.select("label", "dim", F.col("node").alias("q"), F.col("block").alias("block2"))
        return found.join(one, ["label", "dim", "p"]).join(two, ["label", "dim", "q"]).select("block", "block2")

    def run(self) -> DataFrame:
        """(id, n_links, component) of every row."""
        blocks = self.blocks()
        pairs = self.scratch.write(self.pairs(blocks), "pairs")
        data = blocks.select("block", "dim", "ids", "counts", "raws")
        other = data.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("counts").alias("counts2"), F.col("raws").alias("raws2"))
        both = pairs.join(data, "block").join(other, "block2")
        both = both.select("dim", F.expr("block = block2").alias("same"), "ids", "counts", "raws", "ids2", "counts2", "raws2")
        made = self.scratch.write(both.mapInArrow(_compare(self.cosine), "id long, links long, to long"), "made")
        counts = made.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
        found = components(made.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")), self.scratch)
        # a component of points is named by the least id of their rows
        names = found.join(self.points.withColumnRenamed("id", "node"), "node").groupBy("component").agg(F.min("least").alias("name"))
        named = found.join(names, "component").select(F.col("node").alias("rep"), "name")
        known = (
            self.members.join(counts.withColumnRenamed("id", "rep"), "rep", "left")
            .join(named, "rep", "left")
            .select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("name", "least").alias("component"))
        )
        return known.unionByName(self.alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def _lifted_by_label(batches):
    """_lifted() where several labels share a partition: a number alone doesn't name an interval."""

    def split():
        for batch in batches:
            start, keys = 0, list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    yield keys[start], batch.slice(start, k - start)
                    start = k

    from itertools import groupby

    for _, group in groupby(split(), key=lambda x: x[0]):
        yield from _lifted(b for _, b in group)


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept."""
    found = GridJoin(vectors, id_col, vec_col, label_col, cosine, block).run()
    return found.select(
        F.col("id").alias(id_col),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
