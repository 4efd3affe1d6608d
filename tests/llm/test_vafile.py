import math
import random

import numpy as np
import pytest

from grainflow.llm import vafile


def brute(rows, k, mod):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % mod == 0}:
        mine = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(mine))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def found(spark, rows, k=5, mod=10, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score int").repartition(3)
    v = vafile.to_integers(df, "vec_id", "embedding")
    return {tuple(r) for r in vafile.top_k(v, v.where(f"vec_id % {mod} = 0"), k, **more).collect()}


@pytest.mark.parametrize("scale", [0.2, 3.0, 1e5])
def test_equals_brute_force(spark, scale):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, scale) for _ in range(8)]) for i in range(300)]
    assert found(spark, rows) == brute(rows, 5, 10)
    assert found(spark, rows, block=7) == brute(rows, 5, 10)


def test_ties_nulls_lengths_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, 0.25]) for i in range(12)] + [(20, [0.1, 0.1, 0.1]), (30, None), (31, [0.1, None]), (40, [nan, 1.0]), (50, [1.0, inf]), (None, [1.0, 1.0]), (60, []), (61, [])]
    assert found(spark, rows) == brute(rows, 5, 10)
    assert found(spark, []) == set()
    assert found(spark, [(10, [1.0])]) == set()


def packed(x, bits=8):
    low = x.min(0)
    step = (x.max(0) - low) // 2**bits + 1
    return low, step, ((x - low) // step).astype(np.uint8)


@pytest.mark.parametrize("scale", [1, 256, 1e9, 1e15])
def test_bounds_hold_and_spare_exact_reads(scale):
    """Every exact score lies in its bounds, and few candidates are left to be read; the cells take an eighth of the exact vectors' bytes."""
    rng = np.random.default_rng(0)
    x = np.floor(scale * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    found = vafile.Candidates(20, 5)
    cells = packed(x)
    vafile.scan(found, np.arange(20), x[:20] // int(max(1, scale / 1e6)), np.arange(4000), np.arange(4000), *cells)
    q, ids, _, lower, upper = found.open()
    exact = (x[:20] // int(max(1, scale / 1e6))).astype(object) @ x.T.astype(object)
    score = exact[q, ids].astype(float)
    assert (lower <= score + 1e-9 * abs(score)).all() and (score <= upper + 1e-9 * abs(score)).all()
    for i in range(20):
        best = sorted((-s, j) for j, s in enumerate(exact[i]) if j != i)[:5]
        assert {j for _, j in best} <= set(ids[q == i].tolist())
    if scale > 1:
        assert len(q) < 0.02 * exact.size
    assert cells[2].nbytes * 8 == x.nbytes


def test_one_vector_many_times(spark):
    """A third of all rows hold the same vector, the best of every query: the smallest ids win and a task sends no more than them."""
    rng = random.Random(4)
    rows = [(i, [4.0] * 8 if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    assert found(spark, rows) == brute(rows, 5, 10)
    x = np.tile(np.arange(8) + 300, (5000, 1))
    held = vafile.Candidates(3, 5)
    vafile.scan(held, np.arange(3), np.ones((3, 8), np.int64), np.arange(5000), np.full(5000, 7), *packed(x))
    assert len(held.open()[0]) == 15


def test_small_budgets_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([4, 5, 6]))]) for i in range(400)] + [(7, [0.5] * 4), (7, [0.75] * 4), (10, [0.1] * 5)]
    want = brute(rows, 5, 10)
    c = vafile.Candidates(4, 2)
    monkeypatch.setattr(vafile, "HELD", 10)
    c.add(np.array([0, 0, 0, 1, 1, 2] * 3), np.arange(18), np.arange(18), np.arange(18.0), np.arange(18.0) + 0.5)
    assert set(zip(*(x.tolist() for x in c.open()[:2]), strict=True)) == {(0, 14), (0, 13), (1, 16), (1, 15), (2, 17), (2, 11)}
    assert found(spark, rows) == want and found(spark, rows, bits=2, block=9) == want


def test_ids_must_be_whole_numbers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 2.0],)] * 2, "v array<double>")
    assert vafile.to_integers(df.withColumn("i", F.lit(3).cast("decimal(10,0)")), "i", "v").count() == 2
    for kind in ("string", "double"):
        with pytest.raises(TypeError):
            vafile.to_integers(df.withColumn("i", F.lit(3).cast(kind)), "i", "v")


def test_large_components_are_exact_or_left_out(spark):
    """Scores beyond 63 bits rank by all their digits and come out null; components of 2**53 or more take no part."""
    rows = [(10, [1e10, 1e10]), (1, [1e10, 1e10]), (2, [1e10, 1e10 + 1]), (3, [-1e10, 3e10]), (4, [1.0, 2.0]), (5, [3.6e13, 0.0]), (6, [1e300, 0.0]), (7, [3.5e13, -3.5e13])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = vafile.to_integers(df, "vec_id", "embedding")
    got = {tuple(r) for r in vafile.top_k(v, v.where("vec_id = 10"), 5).collect()}
    kept = [(i, [math.floor(256 * x) for x in w]) for i, w in rows if all(abs(256 * x) < 2**53 for x in w)]
    q = dict(kept)[10]
    best = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), i) for i, w in kept if i != 10)[:5]
    assert got == {(10, n + 1, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(best)} and {i for _, i in best} == {1, 2, 3, 4, 7}


def test_stored_cells_and_extra_columns(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    df = spark.createDataFrame([(i, v, "x", 2, 3.0) for i, v in rows], "vec_id long, embedding array<double>, v string, rank int, hash double")
    v = vafile.to_integers(df, "vec_id", "embedding")
    vafile.write(v, str(tmp_path / "cells"))
    got = vafile.top_k(v, v.where("vec_id % 10 = 0"), 5, cells=vafile.open_file(spark, str(tmp_path / "cells")))
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 10)


def test_prefixes_grow_until_nothing_can_reach(spark, monkeypatch):
    """With coarse cells, many bounds stay open and several prefixes are read."""
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(400)]
    monkeypatch.setattr(vafile, "GROWTH", 2)
    assert found(spark, rows, k=2, bits=1) == brute(rows, 2, 10)
