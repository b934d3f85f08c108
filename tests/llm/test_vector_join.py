"""The vector join against brute force, with ties, repeated ids and rows that link with nothing."""

from collections import Counter
from math import sqrt

import numpy as np
import pytest
from test_dedup_and_join import least_reachable

from contractlog.llm import vector_join

VECTORS = "vec_id long, embedding array<double>, label string"


def brute_vectors(rows, cosine):
    """(id, n_links, component_id, kept) of every row; nodes are rows."""
    units = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v) / np.abs(v).max() if ok else None)
    links = []
    for a, x in enumerate(units):
        for b in range(a):
            y = units[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y):
                if float(x @ y) / (sqrt(float(x @ x)) * sqrt(float(y @ y))) >= cosine:
                    links.append((a, b))
    count = Counter(k for pair in links for k in pair)
    group = least_reachable(range(len(rows)), links)
    least = {}
    for k, g in group.items():
        least[g] = min((x for x in (least.get(g), rows[k][0]) if x is not None), default=None)
    named = [(r[0], count[k], least[group[k]]) for k, r in enumerate(rows)]
    return Counter((i, n, c, i is not None and i == c) for i, n, c in named)


def found(spark, rows, cosine, block=512):
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", vector_join.F.lit(1)).repartition(3)
    return Counter(map(tuple, vector_join.links(df, cosine=cosine, block=block).collect()))


def test_each_row_is_judged_by_itself(spark):
    up, right, far = [0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, up, "a"), (2, up, "a"), (2, None, "a"), (2, [0.0, -0.0, 0.0], "a"), (2, [float("nan"), 1.0, 0.0], "a"), (2, up, None)]
    rows += [(3, right, "a"), (3, far, "a"), (4, right, "a"), (0, far, "a"), (None, up, "a"), (2, [None, 1.0, 0.0], "a"), (5, [], "a")]
    got = found(spark, rows, 0.9)
    assert sum(got.values()) == len(rows) and got == brute_vectors(rows, 0.9)
    assert got[(3, 1, 3, True)] == 1 and got[(3, 1, 0, False)] == 1 and got[(2, 0, 2, True)] == 5


@pytest.mark.parametrize("block", [2, 16])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows, ids = [], iter(range(10, 10**6))
    for k in range(620):
        centre = rng.normal(size=12)
        for _ in range(1 + (k % 10 == 0) * int(rng.integers(1, 6))):
            rows.append((next(ids), (centre + rng.normal(size=12) * rng.choice([0.1, 0.25])).tolist(), "big"))
    rows += [(next(ids), [3.0, 4.0], "big"), (next(ids), [1.0, 0.0], "big"), (next(ids), [2.0, 0.0], "big")]  # cosine 0.6: below
    rows += [(next(ids), rng.normal(size=4).tolist(), "small") for _ in range(60)]
    rows += [(next(ids), rows[7][1], "big") for _ in range(30)] + [(next(ids), [2 * x for x in rows[7][1]], "big"), (next(ids), rows[7][1], "other")]
    rows += [(rows[k][0], rows[k + 300][1], "big") for k in range(40)] + [(rows[k][0], None, "big") for k in range(5)]
    assert len(rows) / 2 > vector_join.TOP * vector_join.FAN  # block 2: two levels of intervals above the blocks
    assert found(spark, rows, 0.93, block) == brute_vectors(rows, 0.93)


def test_a_tie_is_a_link(spark):
    rows = [(1, [3.0, 4.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "a"), (4, [-3.0, 4.0], "a")]
    assert found(spark, rows, 0.6) == brute_vectors(rows, 0.6) == Counter([(1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 1, 1, False)])


def test_no_vectors(spark):
    assert found(spark, [], 0.93) == Counter() and found(spark, [(1, None, "a")], 0.93) == Counter([(1, 0, 1, True)])
