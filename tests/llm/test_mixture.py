import pytest
from pyspark.sql import functions as F

from grainflow.llm import mixture
from tests.llm.helpers import WORD, documents


def rows(n=400):
    return [(i, "w " * (i % 7 + i % 40), "en", ["a", "b", "Z", None][(i % 8) % 4 if i % 3 else 0]) for i in range(n)] + [(n, None, "en", "a"), (n + 1, "", "en", "b"), (5, "w " * 10, "en", "b"), (5, "w " * 10, "en", "b")]


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1e-12, sum(weight[s] for s in sizes if s not in capped))
        more = {s for s in sizes if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in sizes}
        capped |= more


def test_targets_and_words_taken(spark):
    data = rows()
    got = mixture.mix_summary(documents(spark, data).withColumn("mix", F.lit(1)).withColumn("taken", F.lit(2)), "doc_id", "text", "source").collect()
    assert len(got) == len(data)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(WORD.findall(t or ""))) for i, t, *_ in data)
    sizes: dict = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = expected_targets(sizes)
    by_source: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = next(k for k in sizes if sizes[k] == r["source_size"])
        assert r["target"] == pytest.approx(want[s])
        by_source[s] = by_source.get(s, 0) + r["taken"]
    for s, taken in by_source.items():
        assert abs(taken - want[s]) <= max(3, 0.01 * want[s])
    positions = [r["first_position"] for r in got if r["first_position"] is not None]
    assert positions == sorted(positions) and [r["first_position"] for r in got[len(positions) :]] == [None] * (len(got) - len(positions))
    assert all((r["copies"] > 0) == (r["taken"] > 0) == (r["first_position"] is not None) and r["copies"] * r["size"] == r["taken"] for r in got)
    again = mixture.mix_summary(documents(spark, data).repartition(7), "doc_id", "text", "source").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_positions_follow_the_schedules(spark):
    docs = documents(spark, [(i, "w " * 5, "en", "ab"[i % 2]) for i in range(600)]).withColumn("copy", F.lit("mine"))
    out = mixture.mixture(docs, "doc_id", "text", "source", schedules=(((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (0.5, 0.0), (1.0, 4.0))))
    assert out.columns[:6] == docs.columns and out.columns[6:] == ["copy_", "position"]
    got = out.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got) and 0 <= got[0]["position"] and got[-1]["position"] <= 1
    a = [r["position"] for r in got if r["source"] == "a"]
    b = [r["position"] for r in got if r["source"] == "b"]
    assert len(a) + len(b) == 600 and min(b) > 0.5  # source b is not wanted in the first half
    early = sum(p < 0.5 for p in a) / len(a)
    assert early == pytest.approx(0.75, abs=0.02)  # of a weight that falls from 2 to 0, three quarters
    counts = {}
    for r in got:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 3


def test_empty_and_wordless(spark):
    assert mixture.mix_summary(documents(spark, []), "doc_id", "text", "source").count() == 0
    one = mixture.mix_summary(documents(spark, [(1, "", "en", "a"), (None, None, None, None)]), "doc_id", "text", "source").collect()
    assert [(r["size"], r["target"], r["taken"]) for r in one] == [(0, 0.0, 0)] * 2
    assert mixture.mixture(documents(spark, [(1, "", "en", "a")]), "doc_id", "text", "source").count() == 0


def test_summary_and_mixture_agree(spark):
    data = documents(spark, rows(150))
    first, last, count = {}, {}, {}
    for r in mixture.mixture(data, "doc_id", "text", "source").collect():
        k = (r["doc_id"], len(r["text"]), r["source"])
        first[k], last[k], count[k] = min(first.get(k, 2), r["position"]), max(last.get(k, -1), r["position"]), count.get(k, 0) + 1
    taken = [r for r in mixture.mix_summary(data, "doc_id", "text", "source").collect() if r["taken"] and r["doc_id"] != 5]
    assert sorted((r["first_position"], r["last_position"], r["copies"]) for r in taken) == sorted((first[k], last[k], count[k]) for k in count if k[0] != 5)


def test_one_key_for_many_rows_and_a_very_long_text(spark):
    """Rows that share a key or have none are spread over the order by their texts."""
    data = [(None if i % 2 else 7, f"w{i} " * (1 + i % 9), "en", "a" if i % 3 else "b") for i in range(900)] + [(8, "x " * 400_000, "en", "b")]
    sized = mixture._sized(documents(spark, data), "doc_id", "text", "source").select("mix.order", "mix.size")
    assert sized.distinct().count() == 901 and sized.agg(F.max("size")).first()[0] == 400_000
    got = mixture.mix_summary(documents(spark, data), "doc_id", "text", "source").collect()
    assert len(got) == 901 and all(r["taken"] <= 3 * r["size"] for r in got)
