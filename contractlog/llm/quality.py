"""Quality: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a bag of terms: its words and its runs of four bytes, lower case and hashed into
WORDS and RUNS buckets; pairs of character kinds (each ASCII mark is a kind of its own; letters
are kinds by case), runs of coarser kinds in fours, and graded terms for how much of the text
repeats itself (words, word triples, lines, neighbours). Term weights are square roots of
relative counts, times a rarity weight; a truncated singular value decomposition of the
labelled sample's bags gives the latent directions. Every text, whole, is projected on them,
scaled to length one, and compared with *all* labelled vectors by exact cosine products in
blocks; the NEIGHBOURS nearest vote with weights that rise with their similarity, corrected for
the labels' shares (the sample holds equally many of each).

The labelled vectors are broadcast: 2 * SAMPLE rows of DIMS numbers, whatever the corpus. The fit
reads SAMPLE rows of each label at most and SAMPLE_BYTES of text (see sampling.labelled_sample).
Nothing but the text enters a score; columns of any name are ignored by ``scores`` and stay as
they are in ``keep``. An empty table gives an empty result; a very long text is scored whole. A null text is an empty text; empty texts have no
terms and get the share of label 1. Without labels of both classes every score is that
share (0 if there are no labels). Null ids are scored and not held out; rows that repeat
are scored each; of neighbours that are equally near the edge takes the first in the sample's order by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlog.llm.common import small_batches
from contractlog.llm.sampling import class_shares, held_out, labelled_sample

#: Labelled rows of each label at most; latent dimensions; neighbours that vote; power of a similarity in its vote.
SAMPLE, DIMS, NEIGHBOURS, POWER = 1500, 40, 25, 8
THRESHOLD = 0.7
#: Texts that are compared at once with all labelled vectors.
BLOCK = 256
SLICE_BYTES = 1 << 21

_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
KINDS = 6 + len(_MARKS)  # lower, upper, digit, blank, newline, beyond ASCII
COARSE = 7  # the six and any mark
GRADES = 8
REPEATS = ("words", "triples", "lines", "next")
#: Buckets of words and of runs of bytes, and what a count there weighs beside the others.
WORDS, RUNS, LEXICAL = 1 << 11, 1 << 11, 0.15
_AT = (KINDS * KINDS, KINDS * KINDS + COARSE**4, KINDS * KINDS + COARSE**4 + GRADES * len(REPEATS))
TERMS = _AT[2] + WORDS + RUNS


def _kinds() -> np.ndarray:
    t = np.full(256, 3, np.int64)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1], t[10], t[128:] = 0, 1, 2, 4, 5
    for k, b in enumerate(_MARKS):
        t[b] = 6 + k
    return t


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _lexical(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of each run of four bytes) of a text in bytes, A-Z as a-z."""
    low = _LOWER[x]
    blank = _BLANK[low]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # the place of each byte in its word; what lies before the first word is blank
    word = np.maximum(0, np.cumsum(np.bincount(start, minlength=len(low))) - 1)
    at = (np.arange(len(low)) - start[word]).astype(np.uint64)
    # a word's hash is a sum over its bytes and their places
    h = (low.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= (at + np.uint64(1)) * _STEP
    h *= _STEP
    h ^= h >> np.uint64(29)
    h[blank] = 0
    words = (np.add.reduceat(h, start) * _MIX) >> np.uint64(64 - 11)
    four = np.lib.stride_tricks.sliding_window_view(low, 4).astype(np.uint64) if len(low) > 3 else np.empty((0, 4), np.uint64)
    runs = ((four[:, 0] | four[:, 1] << np.uint64(8) | four[:, 2] << np.uint64(16) | four[:, 3] << np.uint64(24)) * _MIX) >> np.uint64(64 - 11)
    return words.astype(np.int64), runs.astype(np.int64)


def _repeats(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(REPEATS)
    triples = max(1, n - 2)
    lines = [x for x in text.split(b"\n") if x.strip()]
    size, seen, again = 0, set(), 0
    for x in lines:
        size += len(x)
        again += len(x) if x in seen else 0
        seen.add(x)
    # longer texts repeat words by chance: the square root takes most of that out
    common = 1 - min(1.0, len(set(words)) / (n**0.9))
    return (
        common,
        1 - min(1.0, len(set(zip(words, words[1:], words[2:]))) / triples) if n > 2 else 0.0,
        again / max(1, size),
        sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1),
    )


def bags(texts: list[str | None]) -> np.ndarray:
    """Square roots of relative term counts: one row of TERMS numbers each; empty texts: zeros."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), TERMS), np.float32)
    for k, x in enumerate(raw):
        if not x.strip():
            continue
        code = np.frombuffer(x, np.uint8)
        kind = _KIND[code]
        coarse = np.minimum(kind, COARSE - 1)
        if len(kind) > 1:
            pairs = np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
            out[k, : _AT[0]] = pairs / (len(kind) - 1)
        # runs of one coarse kind count once: the text's shape
        shape = coarse[np.concatenate([[True], coarse[1:] != coarse[:-1]])]
        if len(shape) > 3:
            at = ((shape[:-3] * COARSE + shape[1:-2]) * COARSE + shape[2:-1]) * COARSE + shape[3:]
            out[k, _AT[0] : _AT[1]] = np.bincount(at, minlength=COARSE**4) / (len(shape) - 3)
        for j, v in enumerate(_repeats(x)):
            # a graded value is shared by its two nearest grades
            g = min(v, 1.0) ** 0.5 * (GRADES - 1)
            low = min(int(g), GRADES - 2)
            base = _AT[1] + j * GRADES + low
            out[k, base], out[k, base + 1] = (1 - (g - low)) * 0.25, (g - low) * 0.25
        for found, base, size in zip(_lexical(code), (_AT[2], _AT[2] + WORDS), (WORDS, RUNS)):
            if len(found):
                out[k, base : base + size] = np.bincount(found, minlength=size) * (LEXICAL / len(found))
    return np.sqrt(out)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Of each row the columns of its k greatest numbers; of equal ones at the edge the first columns."""
    near = np.argpartition(-cos, k - 1, 1)[:, :k]
    edge = np.take_along_axis(cos, near, 1).min(1, keepdims=True)
    for row in np.flatnonzero((cos >= edge).sum(1) > k):
        near[row] = np.argsort(-cos[row], kind="stable")[:k]
    return near


class Model:
    def __init__(self, idf, mean, axes, vectors, labels, shares):
        self.idf, self.mean, self.axes, self.vectors, self.labels, self.shares = idf, mean, axes, vectors, labels, shares

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf - self.mean) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        share = float(self.shares.get(1, 0.0))
        out = np.full(len(texts), share)
        if self.axes is None:
            return out
        weight = np.array([self.shares.get(k, 0.0) / max(1, (self.labels == k).sum()) for k in (0, 1)])[self.labels]
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            x = bags(texts[a : a + BLOCK])
            some = x.any(1)
            cos = self.project(x) @ self.vectors.T
            near = nearest(cos, k)
            v = np.maximum(np.take_along_axis(cos, near, 1), 1e-3) ** POWER * weight[near]
            p = (v * self.labels[near]).sum(1) / v.sum(1)
            out[a : a + BLOCK] = np.where(some, np.clip(p, 0, 1), share)
        return out


def fit(texts: list[str], labels: list[int], shares: dict[int, float]) -> Model:
    """The model of at most 2 * SAMPLE labelled texts; shares: of the labels among all labelled rows."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(None, None, None, None, None, shares)
    x = bags(texts)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) * 0.3 + 1
    x *= idf
    mean = x.mean(0)
    x -= mean
    # the directions of the sample's bags: a randomised decomposition, with two power steps
    rng = np.random.default_rng(7)
    dims = min(DIMS, *x.shape)
    q = np.linalg.qr(x @ rng.normal(size=(x.shape[1], min(dims + 16, len(x)))).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dims].T.astype(np.float32)
    model = Model(idf, mean, axes, None, y, shares)
    v = x @ axes
    model.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return model


def _scored(model: Model, texts: list[str | None]) -> np.ndarray:
    """Scores of a batch, by slices of whole texts with about SLICE_BYTES characters."""
    scores, start, size = [np.empty(0)], 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_BYTES or k == len(texts) - 1:
            scores.append(model.score(texts[start : k + 1]))
            start, size = k + 1, 0
    return np.concatenate(scores)


def _scorer(model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(model.value, batch.column(1).to_pylist()))], ["id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_label: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    small_batches(docs.sparkSession)
    rows = sorted(labelled_sample(docs, labels, label_col, per_label, id_col, text_col).collect(), key=lambda r: (r.id, r.label, r.text))
    return fit([r.text for r in rows], [r.label for r in rows], class_shares(labels, label_col, id_col))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(_scorer(sent), f"id {dict(docs.dtypes)[id_col]}, score double")
    return made.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _filterer(model, text_col: str, threshold: float):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(_scored(model.value, texts) >= threshold))

    return run


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text the classifier accepts, all columns as they were."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_filterer(sent, text_col, threshold), docs.schema)
