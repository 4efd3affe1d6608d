import hashlib
import math
import random

import numpy as np
import pytest

from grainflow.llm import kmeans
from tests.llm.helpers import SF


def brute(rows, dim=64, k=8, rounds=10, scale=1024):
    """The definition in Python's integers, without any bound."""
    ok = []
    for i, v in rows:
        if v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(scale * float(c)) if math.isfinite(scale * float(c)) else 2**63 for c in v]
        if all(-(2**63) <= c < 2**63 for c in x):
            ok.append((i, x))
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in ok if i is not None)[:k]
    if not starts:
        return []
    centroids = [x for _, x in starts]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j)) for _, x in ok]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), o in zip(ok, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = assign()
    d = [far(x, centroids[o]) for (_, x), o in zip(ok, own, strict=True)]
    inertia = {j: sum(a for a, o in zip(d, own, strict=True) if o == j) for j in set(own)}
    long = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, o, long(a), long(inertia[o]), long(sum(d)), digest[o])) for (i, _), o, a in zip(ok, own, d, strict=True))


def found(spark, rows, dim=64, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, block int, ids string").repartition(3)
    return sorted(repr(tuple(r)) for r in kmeans.cluster(df, dim=dim, **more).collect())


def blobs(rng, n, dim, spread=0.2):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    return list(enumerate([[c + rng.gauss(0, spread) for c in rng.choice(centres)] for _ in range(n)]))


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = kmeans.query(spark, SF)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_blocks_of_any_size(spark, monkeypatch):
    rows = blobs(random.Random(2), 300, 5)
    want = brute(rows, 5)
    for size in (7, 2048):
        monkeypatch.setattr(kmeans, "BLOCK", size)
        assert found(spark, rows, 5) == want


def test_ties_copies_and_empty_clusters(spark):
    """Vectors on a small grid: many are as near to two centroids; a third are one vector, so that centroids coincide and stay empty."""
    rng = random.Random(5)
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [rng.randrange(4) / 1024, rng.randrange(4) / 1024]) for i in range(240)]
    assert found(spark, rows, 2) == brute(rows, 2)
    assert found(spark, [(i, [0.5, 0.5]) for i in range(40)], 2) == brute([(i, [0.5, 0.5]) for i in range(40)], 2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1e300, 0.0]), (8, [0.0, 9.1e15]), (8, [-9.0e15, 3.0]), (None, [0.25, 0.25]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (10, [1e10, -1e10]), (11, [-0.0, 0.001])]
    assert found(spark, odd, 2) == brute(odd, 2)
    assert found(spark, [(None, [0.25, 0.25])], 2) == brute([(None, [0.25, 0.25])], 2) == []
    assert found(spark, [], 2) == []
    assert found(spark, [(3, [1.0, 2.0])], 2) == brute([(3, [1.0, 2.0])], 2)


def test_ids_of_any_type_keep_their_name(spark):
    df = spark.createDataFrame([("a", [0.5, 1.0]), ("b", [0.25, 1.0])], "cluster string, `v.v` array<float>")
    got = kmeans.cluster(df, "cluster", "v.v", dim=2)
    assert got.columns == ["cluster", "cluster_", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert {r[0] for r in got.collect()} == {"a", "b"}


@pytest.mark.parametrize("top", [50, 2**20, 2**40, 2**62])
def test_bounds_hold_and_spare_distances(top):
    rng = np.random.default_rng(top % 1000)
    centres = rng.integers(-top, top, (6, 4))
    x = np.clip(centres[rng.integers(0, 6, 500)] + rng.integers(-top // 20 - 1, top // 20 + 2, (500, 4)), -top, top)
    now = x[:6].copy()
    bounds, before = kmeans.Bounds.none(500, 6), None
    for _ in range(12):
        exact, to = kmeans.exact_type(x, now)
        if before is not None:
            bounds.moved(kmeans._up(kmeans._root(kmeans._exact(*kmeans.exact_type(now, before)))))
        bounds.assign(exact, to, kmeans.between(now.astype(object)))
        far = ((x[:, None, :].astype(object) - now[None, :, :].astype(object)) ** 2).sum(2)
        assert (bounds.own == np.array([min(range(6), key=lambda j: (far[i, j], j)) for i in range(500)])).all()
        near = far[np.arange(500), bounds.own]
        assert all(math.isqrt(int(d)) <= u for d, u in zip(near, bounds.upper, strict=True))
        assert all(low**2 <= int(d) * (1 + 1e-9) for row, lows in zip(far, bounds.lower, strict=True) for d, low in zip(row, lows, strict=True))
        before = now.copy()
        for c in range(6):
            mine = x[bounds.own == c].astype(object)
            if len(mine):
                now[c] = [int(s) // len(mine) for s in mine.sum(0)]
    assert bounds.computed < 12 * 500 * 6 / 3
