import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grainflow.llm import decontamination, neardup
from tests.llm.helpers import documents, groups, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("stages")
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(out / name))
        before, docs = docs, spark.read.parquet(str(out / name))
        kept.append((name, before, docs))
    return {n: (a, b) for n, a, b in kept}


def test_order_and_columns(stages):
    assert list(stages) == ["language", "lines", "near_duplicates", "benchmark", "mix"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_rejects_only_odd_texts(stages):
    before, after = stages["language"]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert len(gone) <= 0.02 * before.count()
    assert after.where(~F.col("text").rlike(r"\p{L}")).count() == 0


def test_lines_keep_every_document(stages):
    before, after = stages["lines"]
    assert sorted(r["doc_id"] for r in before.collect()) == sorted(r["doc_id"] for r in after.collect())
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    want = groups({r["doc_id"]: shingles(r["text"]) for r in before.collect()}, corpus_pipeline.SIMILARITY)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(want.values()))


def test_benchmark_passages_go(stages):
    before, after = stages["benchmark"]
    items = [x for (x,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    holds = {r["doc_id"] for r in before.collect() if any(x.lower() in r["text"].lower() for x in items)}
    left = {r["doc_id"] for r in after.collect()}
    assert not holds & left
    index = decontamination.build(list(enumerate(items)))
    assert left == {r["doc_id"] for r in before.collect() if not decontamination.find(index, r["text"])}


def test_mix_is_ordered(stages):
    before, after = stages["mix"]
    got = after.orderBy("position").collect()
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in before.collect()} and max(r["copy"] for r in got) <= 2


def test_stages_take_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None), (None, "", "en", "a"), (2, "the thing and that " * 4, "en", "a"), (2, "the thing and that " * 4, "en", "a"), (3, "der und nicht " * 5, "de", None)]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() >= 1
        if name != "mix":
            assert got.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    # Of a row that is there twice, one stays.
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == ["1", "2", "3", "None"]


def test_stages_keep_columns_with_their_own_names(spark):
    names = ["score", "lang_pred", "row", "mix", "__host", "__kept", "copy", "position", "gone", "rank", "n_lines", "component", "item_id", "key", "id", "size"]
    docs = documents(spark, [(i, "the thing and that " * 3 + str(i), "en", "a") for i in range(3)] + [(9, "der und nicht " * 5, "de", None)])
    for n in names:
        docs = docs.withColumn(n, F.lit(f"my {n}"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.columns[: len(docs.columns)] == docs.columns and got.count() >= 1, name
        assert all(got.first()[n] == f"my {n}" for n in names), name
    assert neardup.WORDS == 5


def test_benchmark_drops_rows_not_keys(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text")), "item_id").first()["text"]
    rows = [(None, f"before {item} after", "en", "a"), (None, "clean without a key", "en", "a"), (7, f"{item} again", "en", "a"), (7, "clean with that key", "en", "a"), (8, None, "en", "a")]
    got = corpus_pipeline.benchmark(spark, documents(spark, rows), SF).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(map(str, [(None, "clean without a key"), (7, "clean with that key"), (8, None)]))


def test_every_stage_runs_once(spark, monkeypatch):
    """Each stage's rows are written and read again: every document is scored once, whatever the later stages do."""
    seen = spark.sparkContext.accumulator(0)
    plain = corpus_pipeline.language

    def counted(spark, docs, sf_dir):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return plain(spark, docs, sf_dir).mapInArrow(run, docs.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("language", counted), *corpus_pipeline.STAGES[1:]])
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert 0 < seen.value <= spark.read.parquet(f"{SF}/documents.parquet").count()
