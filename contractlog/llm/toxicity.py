"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased and cut into words at white space and sentence marks. The character
n-grams of a word (3 to 5 code points, with the word's edges) are hashed into BUCKETS
embeddings of DIM numbers. A bag is a window of WINDOW words; windows overlap and
cover the whole text. A bag's vector is the average of its n-grams' embeddings, and a linear
softmax gives its two classes; embeddings and softmax are trained together by Adagrad, MEMBERS
times from different beginnings, and the logits are averaged. So a misspelling that no text of the sample has still shares most of its n-grams' embeddings.

Labels belong to texts, not to windows: training runs in rounds, and from the second round on
a toxic text lends its label only to its highest windows. A text's score is that of its
highest window, which one logistic curve, fitted to texts that the rounds didn't see, turns
into the probability of the label among all texts.

The fit reads at most SAMPLE texts of each label (and sampling.SAMPLE_BYTES of them), on the driver; scoring reads every text
whole, in Arrow batches; an empty table gives an empty result, and columns of any name are
ignored. A null or empty text is scored as a text without n-grams: by the
label's share. Without labels of both classes every score is the share of label 1 (0 if
there are no labels). Null ids are scored and not held out; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlog.llm.common import small_batches
from contractlog.llm.sampling import class_shares, held_out, labelled_sample

#: Labelled texts of each label that the fit reads at most.
SAMPLE = 1200
BUCKETS, DIM = 1 << 15, 16
LENGTHS = (3, 4, 5)
WINDOW, STEP = 3, 1
ROUNDS, STEPS, BAGS = 3, 160, 512
RATE = 0.4
#: Share of a bag's n-grams that a training step sees: what a word is must not hang on few of them.
SEEN = 0.7
#: Trainings from different beginnings whose logits are averaged.
MEMBERS = 5
THRESHOLD = 0.3
#: Characters that are scored at once.
SLICE_CHARS = 1 << 20

_MARKS = str.maketrans({c: " " for c in ".,;:?!\"()\t\n\r\x0b\x0c "})
_PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def ngrams(texts: list[str | None]):
    """(bucket, word, words before each text): n-grams' buckets and the words that they are of."""
    lowered = [(t or "").lower().translate(_MARKS) for t in texts]
    c = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = c == 32
    start = np.zeros(len(c), bool)
    start[1:] = space[:-1] & ~space[1:]
    word = np.cumsum(start) - 1
    ends = np.cumsum([len(t) + 1 for t in lowered])
    first = np.concatenate([[0], word[np.minimum(ends, len(c) - 1)] + 1])
    buckets, words = [], []
    for n in LENGTHS:
        count = len(c) - n + 1
        if count < 1:
            continue
        ok = np.ones(count, bool)
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h += c[k : k + count] * _PRIMES[k]
            if 0 < k < n - 1:
                ok &= ~space[k : k + count]
        at = np.nonzero(ok)[0]
        h = h[at]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((h >> np.uint64(64 - 15)).astype(np.int32))
        words.append(word[at + 1].astype(np.int32))
    return np.concatenate([np.empty(0, np.int32), *buckets]), np.concatenate([np.empty(0, np.int32), *words]), first


def windows(first: np.ndarray):
    """(first word, end word, text) of every window; a text without words has none."""
    starts, ends, texts = [], [], []
    for t in range(len(first) - 1):
        a, b = int(first[t]), int(first[t + 1])
        if b > a:
            s = np.arange(a, max(a + 1, b - WINDOW + STEP), STEP)
            starts.append(s)
            ends.append(np.minimum(s + WINDOW, b))
            texts.append(np.full(len(s), t))
    none = np.empty(0, np.int64)
    return (np.concatenate(x) if x else none for x in (starts, ends, texts))


class Model:
    """weight: each bucket's part in the difference of the two classes' logits (embedding times softmax); curve: of facts().

    reach: the least and the greatest logarithm of windows that the curve has seen; beyond it counts as at its end.
    """

    def __init__(self, weight: np.ndarray, bias: float, curve: np.ndarray, share: float, reach: tuple[float, float] = (0.0, np.inf)):
        self.weight, self.bias, self.curve, self.share, self.reach = weight, bias, curve, share, reach

    def facts(self, texts: list[str | None]) -> np.ndarray:
        """Of each text its highest window's logit, logarithms of the sum of those above 0 and of their number, and 1; nan without words."""
        bucket, word, first = ngrams(texts)
        total = np.bincount(word, self.weight[bucket], first[-1]) if len(word) else np.zeros(first[-1])
        count = np.bincount(word, minlength=first[-1])
        total, count = (np.concatenate([[0], np.cumsum(x)]) for x in (total, count))
        s, e, t = windows(first)
        logit = (total[e] - total[s]) / np.maximum(1, count[e] - count[s]) + self.bias
        high = np.full(len(texts), -np.inf)
        np.maximum.at(high, t, logit)
        above = np.log1p(np.bincount(t, np.maximum(0, logit), len(texts)))
        many = np.clip(np.log(np.maximum(1, np.bincount(t, minlength=len(texts)))), *self.reach)
        out = np.stack([high, above, many, np.ones(len(texts))], 1)
        out[np.isinf(high)] = np.nan
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weight is None:
            return np.full(len(texts), self.share)
        x = self.facts(texts)
        return np.where(np.isnan(x[:, 0]), self.share, 1 / (1 + np.exp(-np.clip(np.nan_to_num(x) @ self.curve, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Coefficients of P(y) over x, whose last column is 1, by weighted Newton steps with a little shrinkage."""
    mean = np.average(x, axis=0, weights=w)
    dev = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    mean[-1], dev[-1] = 0.0, 1.0
    same = dev < 1e-9  # a column that doesn't vary says nothing
    dev[same] = 1.0
    z = np.where(same & (np.arange(x.shape[1]) < x.shape[1] - 1), 0.0, (x - mean) / dev)
    b, shrink = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, 1e-3), 1e-9)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (p - y)) + shrink * b
        h = (z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(shrink)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    b = b / dev
    b[-1] -= b[:-1] @ mean[:-1]
    return b


def _trained(bucket: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray, toxic: np.ndarray, texts: int, rng) -> tuple[np.ndarray, float]:
    """Weight of each bucket and bias, from windows (n-grams a to b of a text t) and whether their text is toxic."""
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sq = [np.full(x.shape, 1e-6, np.float32) for x in (emb, soft, bias)]
    chosen = np.nonzero(toxic)[0]
    others = np.nonzero(~toxic)[0]
    hard = others
    for k in range(ROUNDS):
        for _ in range(STEPS):
            rows = np.concatenate([rng.choice(chosen, BAGS // 2), rng.choice(others, BAGS // 4), rng.choice(hard, BAGS // 4)])
            target = np.zeros((len(rows), 2), np.float32)
            target[: BAGS // 2, 1] = 1
            target[BAGS // 2 :, 0] = 1
            size = b[rows] - a[rows]
            flat = np.repeat(a[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            ids, of = bucket[flat], np.repeat(np.arange(len(rows)), size)
            seen = rng.random(len(ids)) < SEEN
            seen[np.cumsum(size) - 1] = True
            ids, of = ids[seen], of[seen]
            size = np.bincount(of, minlength=len(rows))
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            bag = np.add.reduceat(emb[ids], starts, 0) / size[:, None]
            logit = bag @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target) / len(rows)
            pulled = ((d @ soft.T) / size[:, None]).astype(np.float32)
            used, where = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(where, pulled[of, j], len(used)) for j in range(DIM)], 1).astype(np.float32)
            for x, gx, sx, rows_of in ((emb, g, sq[0], used), (soft, bag.T @ d, sq[1], slice(None)), (bias, d.sum(0), sq[2], slice(None))):
                sx[rows_of] += gx * gx
                x[rows_of] -= RATE * gx / np.sqrt(sx[rows_of])
        weight = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
        total = np.concatenate([[0], np.cumsum(weight[bucket])])
        value = (total[b] - total[a]) / (b - a)
        best = np.full(texts, -np.inf)
        np.maximum.at(best, t, value)
        chosen = np.nonzero(toxic & (value >= best[t] - 1e-12))[0]
        level = np.sort(value[others])[-max(1, len(others) // 50)]
        hard = others[value[others] >= level]
    return weight, float(bias[1] - bias[0])


def fit(texts: list[str], labels: list[int], shares: dict[int, float], seed: int = 1) -> Model:
    """The model of at most 2 * SAMPLE labelled texts; shares: of the labels among all texts."""
    y = np.array(labels)
    share = float(shares.get(1, 0.0))
    if len(set(labels)) < 2:
        return Model(None, 0.0, None, share)
    rng = np.random.default_rng(seed)
    judge = rng.random(len(y)) < 0.3  # these texts only fit the curve
    if len(set(y[judge])) < 2 or len(set(y[~judge])) < 2:
        judge = np.zeros(len(y), bool)
    learn = np.nonzero(~judge)[0]
    bucket, word, first = ngrams([texts[k] for k in learn])
    order = np.argsort(word, kind="stable")
    bucket = bucket[order]
    at = np.searchsorted(word[order], np.arange(first[-1] + 1))  # n-grams before each word
    s, e, t = windows(first)
    a, b = at[s], at[e]
    full = b > a
    a, b, t = a[full], b[full], t[full]
    toxic = y[learn][t] == 1
    members = [_trained(bucket, a, b, t, toxic, len(learn), np.random.default_rng((seed, k))) for k in range(MEMBERS)]
    weight, bias = np.mean([w for w, _ in members], 0), float(np.mean([x for _, x in members]))
    model = Model(weight, bias, np.array([1.0, 0.0, 0.0, 0.0]), share)
    curve = np.nonzero(judge)[0] if judge.any() else learn
    x = model.facts([texts[k] for k in curve])
    ok = ~np.isnan(x[:, 0])
    if len(set(y[curve][ok])) < 2:
        return model
    w = np.where(y == 1, shares.get(1, 0.5) / max(1, (y[curve] == 1).sum()), shares.get(0, 0.5) / max(1, (y[curve] == 0).sum()))[curve] * len(curve)
    model.curve = _logistic(x[ok], y[curve][ok].astype(float), w[ok])
    model.reach = (float(x[ok][:, 2].min()), float(x[ok][:, 2].max()))
    return model


def _scorer(model):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores, start, size = [], 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= SLICE_CHARS or k == len(texts) - 1:
                    scores.append(model.value.score(texts[start : k + 1]))
                    start, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_label: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    small_batches(docs.sparkSession)
    rows = sorted(labelled_sample(docs, labels, label_col, per_label, id_col, text_col).collect(), key=lambda r: (r.id, r.label, r.text))
    return fit([r.text for r in rows], [r.label for r in rows], class_shares(labels, label_col, id_col))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles: 256 KB
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(_scorer(sent), f"id {dict(docs.dtypes)[id_col]}, score double")
    return made.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
