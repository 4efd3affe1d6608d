import itertools

import numpy as np
from pyspark.sql import functions as F

from grainflow.llm import crf
from tests.llm.helpers import documents


def brute(scores, transition, start):
    """Posteriors of every word by summing over all label sequences."""
    n, k = scores.shape
    out, total = np.zeros((n, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(start[path[0]] + sum(scores[i, p] for i, p in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i, p in enumerate(path):
            out[i, p] += w
    return out / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 5])
    scores, transition, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, _ = crf.forward_backward(scores, counts, transition, start)
    at = 0
    for c in counts:
        assert np.allclose(got[at : at + c], brute(scores[at : at + c], transition, start), atol=1e-5)
        at += c


def test_long_chains_keep_their_precision():
    got, _ = crf.forward_backward(np.full((60_000, 2), [30.0, -30.0]), np.array([60_000]), np.zeros((2, 2)), np.zeros(2))
    assert np.isfinite(got).all() and got[:, 0].min() > 0.99


SAMPLE = [("en", "the thing and that were with this thought " * 5), ("de", "der und nicht schön über straße dass können " * 5), ("fr", "être déjà où leçon très après vous même " * 5)] * 20


def test_labels_code_switched_words():
    model = crf.fit(SAMPLE)
    got = crf.label_words(model, "the thought and that, nicht über straße können!")
    assert [k for _, k, _ in got] == ["en"] * 4 + ["de"] * 4 and got[1][0] == "thought"
    assert crf.label_words(model, "123 !!") == []


def test_documents(spark):
    model = crf.fit(SAMPLE)
    rows = [(1, "The thing were WITH this", "xx", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (4, "12 -- 34", "en", "s"), (5, "où être déjà " * 20_000, None, "s"), (None, "der und nicht", None, None), (1, "The thing were WITH this", "xx", "s")]
    docs = documents(spark, rows).withColumn("score", F.lit(9)).repartition(2)
    got = crf.identify(docs, model, "text", ["doc_id"]).collect()
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == 7 and found == {1: "en", 2: "und", 3: "und", 4: "und", 5: "fr", None: "de"}
    assert all(0 <= r["score"] <= 1 for r in got) and {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0}
    assert crf.identify(docs.limit(0), model, "text", ["doc_id"]).count() == 0


def test_training_without_labels(spark):
    docs = documents(spark, [(1, "a b c", None, "s"), (2, None, "en", "s")])
    model = crf.train(docs, "doc_id", "text", "lang")
    assert model.languages == () and crf.predict(model, ["abc"]) [0] == ["und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = crf.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.99


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(crf, "STEPS", 4)
    rows = [(3 * k + i, f"abc{chr(97 + k % 26)}{chr(97 + k // 26)} " * 3, f"l{k:03}", "s") for k in range(104) for i in range(3)]
    model = crf.train(documents(spark, rows), "doc_id", "text", "lang")
    assert model.languages == tuple(f"l{k:03}" for k in range(104))


def test_whole_texts_are_learned_and_repeats_count_once(spark, monkeypatch):
    """Words at the very end of long texts are known; a row repeated any number of times is one of the sample."""
    seen = {}
    monkeypatch.setattr(crf, "fit", lambda sample: seen.setdefault("sample", sample))
    long_ = "abc " * 50_000 + "zzz"
    rows = [(1, long_, "a", "s")] * 50 + [(i, f"xyz {i}", "b", "s") for i in range(2, 30)] + [(None, "q", "a", "s")]
    crf.train(documents(spark, rows), "doc_id", "text", "lang", sample=10)
    assert [x for x in seen["sample"] if x[0] == "a"] == [("a", long_)] and sum(x[0] == "b" for x in seen["sample"]) == 10


def test_features_in_parts_are_the_same(monkeypatch):
    codes, starts, ends, _ = crf.words(["Some words über été and more of them " * 9])
    whole = crf._all_features(codes, starts, ends)
    monkeypatch.setattr(crf, "_CHARS", 11)
    assert all((a == b).all() for a, b in zip(whole, crf._all_features(codes, starts, ends), strict=True))


def test_repeated_rows_above_the_sample_lose_no_language(spark):
    rows = [(i, f"the small house number {i} stands by the river", "en") for i in range(300)] + [(1000 + i, f"das kleine haus nummer {i} steht am fluss", "de") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, text string, lang string")
    copies = spark.range(30_000).selectExpr("7L AS k", "'la petite maison est pres du fleuve' AS text", "'fr' AS lang")
    model = crf.train(df.unionByName(copies), "k", "text", "lang", sample=50)
    assert sorted(model.languages) == ["de", "en", "fr"]
