import hashlib
import math
import random

import pytest

from tests.llm.conftest import rows_of
from tidemark.llm.centroids import LARGEST, LONG, Lloyd, assign, fit, nearest


def by_hand(rows, p):
    kept = [(i, [max(-LARGEST, min(LARGEST, math.floor(p.scale * v))) for v in x]) for i, x in rows if x is not None and len(x) == p.dims and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted((hashlib.sha256(f"{p.salt}{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[: p.k]
    centroids = [x for _, x in first]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(p.rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[1], []).append(x)
        centroids = [[sum(v) // len(own[j]) for v in zip(*own[j])] if j in own else c for j, c in enumerate(centroids)]
    found = [(i, *near(x)) for i, x in kept]
    per = {j: sum(d for _, d, c in found if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, j, min(LONG, d), min(LONG, per[j]), min(LONG, sum(per.values())), digest[j]) for i, d, j in found], key=str)


@pytest.mark.parametrize("huge", [False, True])
def test_equals_plain_integers(spark, huge):
    rng, p = random.Random(1), Lloyd(k=5, dims=4, rounds=3, rows=7)
    rows = [(i, [rng.gauss(rng.choice([-2, 0, 2]), 0.5) for _ in range(4)]) for i in range(200)]
    rows += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [math.nan, 0.0, 0.0, 0.0]), (204, [math.inf, 0.0, 0.0, 0.0]), (205, [1.0] * 5)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5]), rows[3], rows[3], (7, [9.0, 9.0, 9.0, 9.0]), (300, [-0.001, 0.0, -0.0, 1.0])]
    if huge:
        rows += [(400, [1e30, -1e30, 3e7, 0.0]), (401, [1e9, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1, "clash") for i, x in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(4)
    assert rows_of(assign(df, fit(df, p), p)) == by_hand(rows, p)


def test_few_and_no_vectors(spark):
    p = Lloyd(k=16, dims=2, rounds=3)
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(assign(df, fit(df, p), p)) == by_hand(rows, p)
    none = df.limit(0)
    assert fit(none, p) == [] and rows_of(assign(none, [], p)) == []


def test_ties_go_to_the_smaller_number():
    import numpy as np

    cluster, d = nearest(np.array([[0, 0], [2, 0]]), [[1, 0], [-1, 0], [1, 0]])
    assert cluster.tolist() == [0, 0] and d.tolist() == [1, 1]
