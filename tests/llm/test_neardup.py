import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.llm import neardup
from tests.llm.helpers import documents, groups, shingles


def grouped(spark, rows, percent=85):
    df = documents(spark, rows).withColumn("component", F.lit(3)).withColumn("n", F.lit(1)).repartition(3)
    return neardup.near_duplicates(df, "doc_id", "text", percent).collect()


def check(spark, rows, percent):
    sets = {i: shingles(t) for i, t, *_ in rows}
    want = groups(sets, percent)
    got = {tuple(r) for r in grouped(spark, rows, percent)}
    assert got == {(i, len(sets[i]), want[i], want[i] == i) for i in sets}
    return want


def noisy(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_brute_force(spark, percent):
    rng = random.Random(percent)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (60, 150, 300, 12)]
    rows = [(i, noisy(rng, base[i % 4], rng.choice((0, 0, 1, 2, 3, 4, 6))), "en", "s") for i in range(120)]
    # A chain whose ends are far apart, and random texts.
    chain = [f"c{i}" for i in range(200)]
    rows += [(200 + i, " ".join(chain[6 * i : 6 * i + 140]), "en", "s") for i in range(9)]
    rows += [(300 + i, " ".join(f"r{rng.randrange(10**6)}" for _ in range(40)), "en", "s") for i in range(40)]
    want = check(spark, rows, percent)
    assert want[208] == 200


def test_small_sets_ties_and_case(spark):
    rows = [(9, "A b", "en", "s"), (3, "a  B\n", "en", "s"), (4, "a b c", "en", "s"), (5, "", "en", "s"), (6, None, "en", "s"), (7, " \n", "en", "s"), (8, "É b", "en", "s"), (2, "é b", "en", "s"), (10, "x y z u v", "en", "s"), (11, "X y z u v", "en", "s"), (12, "a\u00a0b", "en", "s")]
    want = check(spark, rows, 85)
    assert want[9] == 3 and want[8] == 8 and want[11] == 10 and want[6] == 6


def test_null_keys_repeats_and_long_texts(spark):
    long_ = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (2, long_, "en", "s"), (3, long_ + " tail", "en", "s"), (None, None, None, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component"], r["kept"]) for r in grouped(spark, rows)), key=repr)
    assert got == sorted([(None, 2, None, False), (None, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 29_996, 2, True), (3, 29_997, 2, False)], key=repr)
    assert grouped(spark, []) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    errors = []
    for i in range(60):
        other = np.unique(np.concatenate([a[: 400 - 3 * i], rng.integers(0, 2**63, 100).astype(np.uint64)]))
        x, y = neardup.superminhash([a, other])
        true = len(np.intersect1d(a, other)) / len(np.union1d(a, other))
        errors.append((x == y).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signature_of_one_element_is_a_permutation():
    sign = neardup.superminhash([np.array([12345], np.uint64), np.zeros(0, np.uint64)])
    assert sorted(sign[0] >> 24) == list(range(neardup.SLOTS)) and (sign[1] == 2**32 - 1).all()


def test_star_contraction_over_many_parts(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionByName(spark.createDataFrame([(1001, 1000)], "a long, b long"))
    got = {r["node"]: r["component"] for r in neardup.components(edges, part=20).collect()}
    assert got == {**{i: 0 for i in range(300)}, 1000: 1000, 1001: 1000}


def test_blocks_find_links_across_them(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, noisy(rng, base, rng.choice((2, 3, 4))), "en", "s") for i in range(40)]
    check(spark, rows, 80)


def test_meetings_may_span_batches(spark, monkeypatch):
    from grainflow.llm import common

    monkeypatch.setattr(common, "ARROW_ROWS", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    check(spark, [(i, noisy(rng, base, rng.choice((2, 3, 4))), "en", "s") for i in range(40)], 80)


def test_a_pair_is_compared_in_its_first_shared_key_only():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, neardup.SLOTS).astype(np.uint32)
    b = a.copy()
    b[: neardup.ROWS * 3] += 1  # the first three keys differ
    import pyarrow as pa

    def pairs(slot):
        t = {"part": [2, 2], "component": [1, 2], "n": [9, 9], "slot": [slot, slot]}
        return list(neardup._hopeful_pairs({k: pa.array(v) for k, v in t.items()} | {"sign": pa.array([a.tobytes(), b.tobytes()], pa.binary())}, 85))

    assert [s for s in range(neardup.BANDS) if pairs(s)] == [3]


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "smallint"])
def test_keys_of_any_type(spark, kind):
    rows = [(7, "a b c d e f", "en", "s"), (5, "a b c d e f", "en", "s"), (9, "", "en", "s"), (5, "a b c d e f", "en", "s"), (None, "a b c d e f", "en", "s"), (8, "q r s t u v", "en", "s")]
    df = documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = sorted((None if r["doc_id"] is None else int(r["doc_id"]), r["n_shingles"], None if r["component"] is None else int(r["component"]), r["kept"]) for r in neardup.near_duplicates(df, "doc_id", "text").collect() if r["doc_id"] is not None)
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 2, 8, True), (9, 0, 9, True)]
    assert neardup.near_duplicates(df, "doc_id", "text").where("doc_id is null and component is null and not kept").count() == 1
