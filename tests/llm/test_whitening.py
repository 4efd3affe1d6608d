import math
import random
from fractions import Fraction

import numpy as np
import pytest

from grainflow.llm import whitening
from tests.llm.helpers import SF


def brute(rows, dim, components=4, scale=256):
    """The definition with exact means and products: [(id, component, n, deviation, whitened, explained)]."""
    ok = []
    for i, v in rows:
        if v is None or len(v) != dim or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(scale * float(c)) if math.isfinite(scale * float(c)) else 2**63 for c in v]
        if all(-(2**63) <= c < 2**63 for c in x):
            ok.append((i, x))
    fit = sorted({tuple(x) for _, x in ok})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(n * c - s, n) for c, s in zip(x, sums, strict=True)] for x in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(dim)] for i in range(dim)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = []
    for i, x in ok:
        far = [n * c - s for c, s in zip(x, sums, strict=True)]
        for k in range(len(e)):
            out.append((i, k + 1, n, sum(f * f for f in far), float(np.dot([f / n for f in far], u[:, k]) / np.sqrt(e[k])), e[k] / np.trace(v)))
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, x int, n string").repartition(3)
    return whitening.whiten(df, **more).collect()


def same(got, want, components):
    got = sorted((tuple(r) for r in got), key=lambda r: repr(r[:4]))
    want = sorted(want, key=lambda r: repr((r[0], r[1], r[2], r[3] if r[3] < 2**63 else None)))
    assert len(got) == len(want)
    for k in range(1, components + 1):
        a, b = [r for r in got if r[1] == k], [r for r in want if r[1] == k]
        assert [r[:3] for r in a] == [r[:3] for r in b]
        assert [r[3] for r in a] == [r[3] if r[3] < 2**63 else None for r in b]
        assert np.allclose([r[5] for r in a], [r[5] for r in b], rtol=1e-9)
        x, y = np.array([r[4] for r in a]), np.array([r[4] for r in b])
        assert min(abs(x - y).max(), abs(x + y).max()) < 1e-6  # either sign
    assert got[0][6] < 1e-9 and len({r[6] for r in got}) == 1


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = whitening.query(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(got.collect(), brute(rows, 64), 4)


@pytest.mark.parametrize(("scale", "shift"), [(1, 0), (30, 1e6), (1e4, -1e12), (1e9, 0)])
def test_scales_and_offsets(spark, scale, shift):
    rng = random.Random(scale)
    rows = [(i, [shift + scale * rng.gauss(0, s) for s in (5, 1, 3, 2, 0.5)]) for i in range(200)] + [(1000 + i, [float(shift)] * 5) for i in range(100)]
    same(found(spark, rows), brute(rows, 5), 4)


def test_copies_count_once_in_the_fit_and_lengths_nulls_drop_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i % 40, [float(i % 7), float(i % 5), 0.001 * (i % 3)]) for i in range(90)]
    rows += [(1, None), (2, []), (3, [1.0]), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 1.0]), (6, [inf, 0.0, 1.0]), (7, [1e300, 0.0, 0.0]), (None, [0.5, -0.0, 0.25])]
    same(found(spark, rows, components=2), brute(rows, 3, 2), 2)
    assert {r["n"] for r in found(spark, rows, components=2)} == {36}


def test_without_variance_or_rows(spark):
    got = found(spark, [(i, [0.5, 0.25]) for i in range(3)])
    assert len(got) == 6 and {tuple(r[1:]) for r in got} == {(k, 1, 0, None, None, None) for k in (1, 2)}
    got = found(spark, [(0, [1.0, 2.0, 0.0]), (1, [2.0, 4.0, 0.0])])
    assert len(got) == 6 and {(r["component"], r["whitened"], r["explained"]) for r in got if r["component"] > 1} == {(2, None, 0.0), (3, None, 0.0)}
    assert sorted(round(r["whitened"], 9) for r in got if r["component"] == 1) == [-1, 1] and abs(got[0]["explained"]) <= 1
    assert found(spark, []) == [] and found(spark, [(1, None), (2, [])]) == []


def test_names_and_types(spark):
    df = spark.createDataFrame([("a", [0.5, 1.0]), ("b", [0.25, 3.0])], "n string, `v.v` array<float>")
    got = whitening.whiten(df, "n", "v.v")
    assert got.columns == ["n", "component", "n_", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 4


@pytest.mark.parametrize("top", [3, 2**20, 2**40, 2**62])
def test_residues_give_the_exact_scatter(spark, top):
    rng = np.random.default_rng(1)
    x = rng.integers(-top, top, (5000, 3))
    centre = [top // 7, -1, 0]
    moduli = whitening.primes(2 * 5000 * (2 * top) ** 2)
    assert len(set(moduli)) == len(moduli) and all(p < 2**21 for p in moduli)
    parts = [sum(whitening.residue_products(x[a : a + 4096], np.array(centre), p) for a in (0, 4096)) for p in moduli]
    y = np.concatenate([np.ones((5000, 1), int), x], 1).astype(object)
    y[:, 1:] -= np.array(centre, object)
    want = y.T @ y
    for i in range(4):
        for j in range(4):
            assert whitening.remainder([int(m[i, j]) for m in parts], moduli) == want[i, j]
