from pyspark.sql import functions as F

from grainflow.llm import compression
from tests.llm.helpers import documents

GOOD = "the quiet river runs along the old stone wall and the children play there {} "
BAD = "BUY!! NOW!! $$$ click### here%%% win*** cash&&& {} "


def test_separates_and_handles_odd_texts(spark):
    rows = [(i, (GOOD if i % 4 else BAD).format(i) * 20, "en", "s") for i in range(400)]
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, BAD * 5000, "en", "s"), (None, GOOD * 3, "en", "s"), (1002, BAD * 5000, "en", "s"), (1003, "\n", "en", "s")]
    docs = documents(spark, rows + odd).withColumn("score", F.lit("mine")).withColumn("quality", F.lit(7))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(1000, 1, 0), (9999, 0, 0), (None, 1, 0), (5, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = compression.train(docs, labels, "doc_id", "text", "quality")
    got = compression.score(docs, model, "doc_id", "text").collect()
    assert len(got) == 406 and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["doc_id"] % 4 > 0) == bool(r["predicted"]) for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    assert sum(held) / len(held) > 0.98
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1000] == by[1001] and by[1002] < 0.3 < by[None]
    assert compression.score(docs.limit(0), model, "doc_id", "text").count() == 0


def test_one_class_or_none(spark):
    docs = documents(spark, [(1, "a b", "en", "s")])
    for labels in ([], [(1, 1)]):
        model = compression.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id", "text", "quality")
        assert 0 <= compression.score(docs, model, "doc_id", "text").first()["score"] <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = compression.query(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97


def test_few_and_short_labelled_texts(spark):
    """With too little text for a dictionary every score is the share of good labels; with some more it is learned by the same method."""
    docs = documents(spark, [(i, "ab" if i % 2 else "cd", "en", "s") for i in range(8)])
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(8)], "doc_id long, quality int")
    model = compression.train(docs, labels, "doc_id", "text", "quality")
    assert {round(r["score"], 9) for r in compression.score(docs, model, "doc_id", "text").collect()} == {0.75}
    few = compression.fit([(k, (GOOD if k else BAD).format(i) * 3) for i in range(24) for k in (0, 1)][: 40], 0.5)
    assert few.good and few.bad


def test_query_equals_brute_force(spark):
    """Every score of the query, anew from its dictionaries and weights."""
    import math
    import zlib

    import zstandard
    from tests.llm.helpers import SF

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = compression.train(spark.read.parquet(f"{SF}/documents.parquet"), seen, "doc_id", "text", "quality")
    sizes = [zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    rows = compression.query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        good, bad = (sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for c in sizes)
        d, ratio, some = ((bad - good) / (good + bad), min(good, bad) / len(data), 1.0) if data else (0.0, 0.0, 0.0)
        d, ratio = 10 * d, min(ratio, 1.5)
        x = sum(w * v for w, v in zip(model.weights, (1.0, d, ratio, ratio**2, d * ratio, 1 - some), strict=True))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), rel_tol=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_keys_of_any_type_and_repeated(spark):
    """Documents that repeat a labelled key are one text of the sample."""
    for kind in ("smallint", "decimal(10,0)", "string"):
        docs = documents(spark, [(i % 9, f"text {i} " * 30, "en", "s") for i in range(90)]).withColumn("doc_id", F.col("doc_id").cast(kind))
        labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int").withColumn("doc_id", F.col("doc_id").cast(kind))
        model = compression.train(docs, labels, "doc_id", "text", "quality")
        assert compression.score(docs, model, "doc_id", "text").count() == 90
