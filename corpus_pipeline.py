"""A training-data pipeline of five of the operators, from documents to an ordered mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.llm import boilerplate, crf, decontamination, mixture, neardup
from grainflow.llm.common import fresh, materialise, small, table
from grainflow.session import checkpoint_folder

#: Language identification: documents whose words share less than this in their language go.
LEAST_SHARE = 0.4
#: Near-duplicates: similarity of shingle sets in percent.
SIMILARITY = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones teach."""
    model = crf.train(docs, "doc_id", "text", "lang")
    scored = crf.identify(docs, model, "text", list(docs.columns))
    found, score = scored.columns[-2:]
    return scored.where((F.col(found) != crf.UNKNOWN) & (F.col(score) >= LEAST_SHARE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the boilerplate lines of each source out of the texts; every document stays."""
    cleaned = boilerplate.drop_lines(docs, "source", "text").select(*docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, and all without a key or words; of rows that repeat both key and text, one."""
    found = materialise(neardup.near_duplicates(docs, "doc_id", "text", SIMILARITY))
    left = _without(docs, found.where(~F.col("kept") & F.col("component").isNotNull()).select("doc_id"))
    again = found.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = materialise(again)
    if again.isEmpty():
        return left
    repeated = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(left, again).unionByName(repeated.select(*left.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents, with or without a key, that hold passages of the benchmark; others with the same key stay."""
    row = fresh("text_hash", docs.columns)
    hashed = docs.withColumn(row, F.xxhash64("text"))  # the text alone decides
    found = decontamination.contaminated(hashed, row, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return _without(hashed, found.select(row), row).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as its source's target asks for."""
    return mixture.mixture(docs, "doc_id", "text", "source")


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    ids = materialise(ids.where(F.col(key).isNotNull()).select(F.col(key).alias(fresh("gone", docs.columns))).distinct())
    gone = ids.columns[0]
    return docs.join(small(ids), docs[key] == F.col(gone), "left_anti")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix)]
#: Learned labels and alignments have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Each one's rows are written as Parquet to the folder of checkpoints and read again, so that no
    stage runs twice and a lost executor costs no more than the stage at work; a stage's files go once the next one is written. The last one's rows are left to
    the caller, and with them the files that they come from."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            _delete(spark, last)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
