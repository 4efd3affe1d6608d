"""Reader of phase property files: blocks that start with a keyword line.

Keywords: *phase, *density, *stiffness_matrix, *thermal_expansion, *thermal_conductivity (any case). Text after #
is a comment; a matrix may stand on one line, and short rows are filled up with 0. What a file leaves out gets a default: the file's stem as name, density 1, unit stiffness,
no expansion, unit conductivity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.sources.maps import NUMBER

#: Block, result column, rows and columns that it holds, default.
BLOCKS = (
    ("density", "density", 1, 1, [1.0]),
    ("stiffness_matrix", "stiffness", 6, 6, [float(i % 7 == 0) for i in range(36)]),
    ("thermal_expansion", "alpha", 6, 1, [0.0] * 6),
    ("thermal_conductivity", "kappa", 3, 3, [float(i % 4 == 0) for i in range(9)]),
)
SYMMETRY = 1e-6


def read_properties(spark: SparkSession, paths: list[str]) -> DataFrame:
    """phases(phase, name, density, stiffness array[36], alpha array[6], kappa array[9]); `phase` counts the paths from 1."""
    out = None
    for number, path in enumerate(paths, 1):
        part = _one(spark, path).withColumn("phase", F.lit(number))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no property files")
    return out.select("phase", "name", *(b[1] for b in BLOCKS))


def _one(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"#[^\n]*", "").alias("text"))
    block = lambda k: F.regexp_extract("text", rf"(?is)\*{k}\b([^*]*)", 1)
    columns = []
    for keyword, name, rows, width, default in BLOCKS:
        lines = F.filter(F.transform(F.split(block(keyword), "\n"), lambda x: F.transform(F.regexp_extract_all(x, F.lit(NUMBER), 0), lambda y: y.cast("double"))), lambda r: F.size(r) > 0)
        flat = F.flatten(lines)
        padded = F.flatten(F.transform(lines, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(0.0), width)), 1, width)))  # noqa: B023
        short = (F.size(lines) == rows) & F.forall(lines, lambda r: F.size(r) <= width)  # noqa: B023
        wrong = F.raise_error(F.lit(f"{path}: *{keyword} needs {rows * width} numbers")).cast("array<double>")
        value = F.when(F.size(flat) == rows * width, flat).when(F.size(flat) == 0, F.array(*map(F.lit, default))).when(short, padded).otherwise(wrong)
        columns.append((value[0] if rows * width == 1 else value).alias(name))
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    name = F.trim(F.regexp_replace(block("phase"), r"\s+", " "))
    return whole.select(F.when(name == "", stem).otherwise(name).alias("name"), *columns)


def asymmetric(phases: DataFrame) -> DataFrame:
    """Phases whose stiffness is not symmetric within a millionth of its largest entry."""
    pairs = [F.abs(F.col("stiffness")[6 * i + j] - F.col("stiffness")[6 * j + i]) for i in range(6) for j in range(i)]
    return phases.where(F.greatest(*pairs) > SYMMETRY * F.array_max(F.transform("stiffness", F.abs)))


def isotropic(young: float | Column, poisson: float | Column) -> list:
    """Row-major stiffness of an isotropic solid, of numbers or columns."""
    lame = young * poisson / ((1 + poisson) * (1 - 2 * poisson))
    shear = young / (2 * (1 + poisson))
    return [(lame + 2 * shear * int(i == j) if max(i, j) < 3 else shear * int(i == j)) if (i < 3) == (j < 3) else 0.0 * shear for i in range(6) for j in range(6)]
