import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.llm import covertree
from tests.llm.helpers import SF


def brute(rows, cosine=0.95):
    """{position: (links, least id)} by all pairs in plain Python."""

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        top = max(abs(x) for x in v)
        v = [x / top for x in v]
        size = math.sqrt(math.fsum(x * x for x in v))
        return [x / size for x in v]

    units = [unit(v) for _, v in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if units[i] and units[j] and len(units[i]) == len(units[j]) and sum(a * b for a, b in zip(units[i], units[j], strict=True)) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted(repr((k, links[i], least[find(i)], k == least[find(i)])) for i, (k, _) in enumerate(rows))


def found(spark, rows, **more):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, number string, key int").repartition(3)
    return sorted(repr(tuple(r)) for r in covertree.groups(df, **more).collect())


def clustered(rng, n, dim, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [[c + rng.gauss(0, spread) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize(("dim", "spread"), [(2, 0.5), (8, 0.2), (16, 0.23), (64, 0.16)])
def test_equals_brute_force(spark, dim, spread):
    rows = list(enumerate(clustered(random.Random(dim), 240, dim, spread)))
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, block=40) == want


def test_nulls_zeros_lengths_scales_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, None), (8, []), (7, [0.0, -0.0]), (6, [1.0, None]), (5, [nan, 1.0]), (4, [inf, 1.0]), (None, [0.3, 0.4]), (20, [0.3, 0.4]), (21, [6e300, 8e300]), (22, [3e-310, 4e-310])]
    rows += [(23, [0.3, 0.4, 0.0]), (24, [0.3]), (25, [-2.0]), (25, [1.0]), (26, [0.0, 1.0]), (26, [0.0, 1.0]), (27, [-0.0, 1.0]), (27, [-1.0, 0.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, block=1) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == brute([(1, None)])


def test_a_third_are_copies_and_a_third_are_close(spark):
    rng = random.Random(3)
    near = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, [1.0] * 16 if i % 3 == 0 else [x + rng.gauss(0, 0.02) for x in near] if i % 3 == 1 else [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    assert found(spark, rows, block=30) == brute(rows)


def test_hot_classes_by_broadcast_or_not(spark, monkeypatch):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(100 + i, [-1.0, i / 10]) for i in range(6)]
    want = brute(rows)
    for hot in (1, 10, 10_000):
        monkeypatch.setattr(covertree, "HOT", hot)
        assert found(spark, rows) == want
    monkeypatch.setattr(covertree, "small", lambda df: df)
    assert found(spark, rows) == want


def test_pairs_are_all_pairs(spark):
    rows = list(enumerate(clustered(random.Random(1), 150, 8, 0.2))) + [(900, [1.0] * 8), (901, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs, member = covertree.threshold_pairs(df, block=40)
    x = np.array([v for _, v in rows[:-1]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = [k for k, _ in rows]
    of = {r["id"]: r["class"] for r in member.collect()}
    assert of[900] == of[901]
    got = {(r["a"], r["b"]): r["cosine"] for r in pairs.collect()}
    want = {(min(a, b), max(a, b)): x[i] @ x[j] for i in range(len(x)) for j in range(i) if x[i] @ x[j] >= 0.95 for a, b in [(of[ids[i]], of[ids[j]])]}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_tree_is_a_cover_tree():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 6)), rng.normal(0, 0.05, (200, 6)) + rng.normal(0, 1, 6)])
    tree = covertree.build(x, np.arange(400), np.ones(400, int))
    far = lambda a, b: np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))
    assert sorted(tree.number.tolist()) == list(range(400))
    for i, level in enumerate(tree.levels[:-1]):
        centres, below = tree.unit[level.centre], tree.levels[i + 1]
        apart = far(centres, centres)
        np.fill_diagonal(apart, 9)
        assert apart.min() > 2.0 ** (1 - i) - 1e-3  # centres of a level lie apart
        for n in range(len(level.low)):
            assert below.low[level.first[n]] == level.low[n] and below.high[level.last[n] - 1] == level.high[n]  # children share out what is below
            kids = below.centre[level.first[n] : level.last[n]]
            assert level.centre[n] in kids  # nested
            assert far(centres[n : n + 1], tree.unit[kids]).max() <= 2.0 ** (1 - i) + 1e-3  # covered
            assert far(centres[n : n + 1], tree.unit[level.low[n] : level.high[n]]).max() <= level.radius[n] + 1e-6
    assert len(tree.levels[-1].low) == 400


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (20, 32))
    x = centres[rng.integers(0, 20, 4000)] + rng.normal(0, 0.01, (4000, 32))
    tree = covertree.build(x, np.arange(4000), np.ones(4000, int))
    walk = covertree.Dual(tree, None, 0.95).run()
    assert walk.computed < 4000 * 4000 / 2 / 100
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert (walk.links == want[tree.number]).all()
    other = covertree.build(x[:500] * 3, np.arange(500), np.full(500, 2))
    both = covertree.Dual(tree, other, 0.95).run()
    want = u @ u[:500].T >= 0.95
    assert (both.links[:4000] == 2 * want.sum(1)[tree.number]).all() and (both.links[4000:] == want.sum(0)[other.number]).all()


def test_text_ids_and_clashing_names(spark):
    rows = [("b", [1.0, 0.0], 1, 2), ("a", [2.0, 0.1], 1, 2), ("c", [0.0, 1.0], 1, 2)]
    df = spark.createDataFrame(rows, "component_id string, `a.b` array<float>, n_links int, least int")
    got = covertree.groups(df, "component_id", "a.b")
    assert got.columns == ["component_id", "n_links", "component_id_", "kept"]
    assert {tuple(r) for r in got.collect()} == {("b", 1, "a", False), ("a", 1, "a", True), ("c", 0, "c", True)}


@pytest.mark.parametrize("cosine", [0.95, 0.3])
def test_query_equals_brute_force(spark, cosine):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r["vec_id"], list(r["embedding"])) for r in df.collect())
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in (covertree.query(spark, SF) if cosine == 0.95 else covertree.groups(df, cosine=cosine, block=100)).collect()}
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    assert {k: (r["n_links"], r["component_id"], r["kept"]) for k, r in got.items()} == {k: (int(near[i].sum()), rows[label[i]][0], rows[label[i]][0] == k) for i, (k, _) in enumerate(rows)}


def test_only_the_cosine_of_single_vectors_decides(spark):
    """Vectors at the limit, a few last places apart."""
    rows = [(0, [1.0, 0.0])] + [(i, [0.95 + (i - 4) * 1e-16, math.sqrt(1 - 0.95**2)]) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"] for r in covertree.groups(df).where(F.col("n_links") == 7).collect()}
    x = np.array([v for _, v in rows])
    cos = np.einsum("ij,j->i", x, x[0]) / np.sqrt(np.einsum("ij,ij->i", x, x))
    assert got >= {i for i in range(1, 8) if cos[i] >= 0.95 + 1e-12} and got - {0} <= {i for i in range(1, 8) if cos[i] >= 0.95 - 1e-12}


def test_trees_are_sent_small_and_come_back_whole():
    import pickle

    rng = np.random.default_rng(5)
    for kind in (np.float32, np.float64):
        tree = covertree.build(rng.normal(size=(500, 64)).astype(kind), np.arange(500), np.ones(500, np.int64))
        state = pickle.dumps(covertree._packed(tree), protocol=5)
        plain = pickle.dumps((tree.x, tree.length, tree.number, tree.weight, tree.levels), protocol=5)
        assert len(state) < (0.6 if kind == np.float32 else 0.95) * len(plain)
        back = covertree._unpacked(state)
        assert np.array_equal(back.x, tree.x) and back.x.dtype == np.float64
        for a, b in zip(back.levels, tree.levels, strict=True):
            assert all(np.array_equal(getattr(a, f), getattr(b, f)) and getattr(a, f).dtype == getattr(b, f).dtype for f in (*covertree._NUMBERS, "radius"))


def test_disk_grows_with_the_vectors_and_not_with_the_pairs(spark, monkeypatch):
    """Independent directions, where all blocks meet: no tree is shuffled to its partners, and a task sums up what its pairs find."""
    rng = random.Random(7)
    rows = list(enumerate([rng.gauss(0, 1) for _ in range(16)] for _ in range(200))) + [(500 + i, [1.0 + i / 1000] + [1.0] * 15) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, classes = covertree.classes(df, "vec_id", "embedding")
    met = covertree._traverse(classes, 0.95, 10, False)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    want = brute(rows)
    for held, parts in ((500_000, 32), (1, 3)):
        monkeypatch.setattr(covertree, "SUMMED", held)
        monkeypatch.setattr(covertree, "PARTS", parts)
        assert found(spark, rows, block=10) == want
    monkeypatch.setattr(covertree, "SENT", 10**6)
    assert found(spark, rows, block=10) == want
