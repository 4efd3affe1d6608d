"""Sinks: result tables in text and Parquet, and a mesh store that knows what it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str) -> None:
    """Results with a `method` column, a folder for each method."""
    results.write.mode("overwrite").partitionBy("method").parquet(path)


def matrix_lines(matrix: DataFrame, order: str = "i", cells: str = "row") -> DataFrame:
    """(order, value): a matrix's rows (arrays of doubles) as aligned text."""
    cell = F.transform(cells, lambda x: F.format_string("%15.6e", x))
    return matrix.select(order, F.array_join(cell, " ").alias("value"))


def log_lines(estimates: DataFrame) -> DataFrame:
    """(method, line, value): a readable summary of each method's stiffness (six rows) and thermal expansion (one), line by line."""
    number = lambda x: F.format_string("%12.4f", x)
    rows = [F.array_join(F.transform(F.slice("stiffness", 6 * i + 1, 6), number), " ") for i in range(6)]
    lines = [F.concat(F.lit("method "), F.col("method")), F.lit("stiffness"), *rows, F.lit("thermal expansion"), F.array_join(F.transform("alpha", number), " ")]
    return estimates.select("method", F.posexplode(F.array(*lines)).alias("line", "value"))


def checksum(spark: SparkSession, paths: list[str]) -> list[str]:
    """SHA-256 of each file, computed where the file is read."""
    rows = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sum")).collect()  # a row for each path
    return [r["sum"] for r in sorted(rows, key=lambda r: r["path"])]


def save_mesh(path: str, tables: dict[str, DataFrame], made_from: dict[str, str]) -> None:
    """Mesh tables, and a last table of what they were made from, which makes the store valid."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(sorted(made_from.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/made_from")


def load_mesh(spark: SparkSession, path: str, names: list[str], made_from: dict[str, str]) -> dict[str, DataFrame] | None:
    """The tables, or None if there is no store made from the very same."""
    try:
        stored = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/made_from").collect()}
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    return {n: spark.read.parquet(f"{path}/{n}") for n in names} if stored == made_from else None
