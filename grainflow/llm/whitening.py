"""Whitening of integer vectors from an exact scatter matrix, by residue numbers.

Products of centred components are summed modulo several primes: residues are so small that a product of matrices in doubles is exact, at the
speed of doubles. Each task keeps a matrix of residues for every prime; Spark adds them up, and the sums are put
together by the Chinese remainder theorem. The primes' product exceeds every sum that the counted rows could give, so the scatter matrix is exact
whatever the order of the rows. Its mean terms are taken off in whole numbers, and only the covariance, rounded once, goes to the eigensolver.

A column of ones stands before the components, so that the same products give the number of vectors and their sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType

from grainflow.llm.common import as_schema, fresh, materialise, table
from grainflow.llm.kmeans import matrix, to_integers

#: Vectors of a product, and the primes' limit: 4096 products of two residues of at most half of it stay within 53 bits.
CHUNK, BELOW = 4096, 2**21
WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def primes(least: int) -> list[int]:
    """The greatest primes below the limit, as many as their product needs to exceed `least`."""
    out, product = [], 1
    sound = (p for p in count(BELOW - 1, -2) if all(p % q for q in range(3, int(p**0.5) + 1, 2)))
    while product <= least:
        out.append(next(sound))
        product *= out[-1]
    return out


def remainder(residues: list[int], moduli: list[int]) -> int:
    """The whole number nearest to zero with these residues."""
    product = reduce(lambda a, b: a * b, moduli, 1)
    total = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % product
    return total - product if 2 * total > product else total


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) as (id, x): the components in as few bytes as the vector's largest needs, the same for equal vectors."""
    for batch in batches:
        v = matrix(batch.column(1))
        low, high = v.min(1), v.max(1)
        cells = []
        for i in range(len(v)):
            kind = next(t for t in WIDTHS if np.iinfo(t).min <= low[i] and high[i] <= np.iinfo(t).max)
            cells.append(v[i].astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["id", "x"])


def _spread(cells: pa.Array, dim: int) -> np.ndarray:
    """The vectors of compact rows, as long."""
    values = cells.to_pylist()
    sizes = np.array([len(c) for c in values])
    out = np.empty((len(values), dim), np.int64)
    for kind in WIDTHS:
        some = np.flatnonzero(sizes == dim * np.dtype(kind).itemsize)
        if len(some):
            out[some] = np.frombuffer(b"".join(values[i] for i in some), kind).reshape(len(some), dim)
    return out


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, n, low, high, total as decimal text) of each dimension of a task's rows (v)."""
    n, low, high, total = 0, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        v = matrix(batch.column(0))
        # Sums of halves of 32 bits can't overflow.
        sums = (v >> 32).sum(0).astype(object) * 2**32 + (v & 0xFFFFFFFF).sum(0).astype(object)
        low, high, total = (v.min(0), v.max(0), sums) if low is None else (np.minimum(low, v.min(0)), np.maximum(high, v.max(0)), total + sums)
        n += len(v)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(np.full(len(low), n)), pa.array(low), pa.array(high), pa.array([str(s) for s in total])], names=["at", "n", "low", "high", "total"])


def residue_products(x: np.ndarray, centre: np.ndarray, prime: int) -> np.ndarray:
    """The products of (1, x - centre) with itself, summed over the rows, modulo `prime`."""
    half = prime // 2
    y = np.ones((len(x), x.shape[1] + 1))
    y[:, 1:] = (x % prime - centre % prime + half) % prime - half
    return (y.T @ y).astype(np.int64) % prime


def _products(dim: int, centre: list[int], moduli: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(prime, at, values): the rows of a task's matrices of residues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, total = np.array(centre, np.int64), np.zeros((len(moduli), dim + 1, dim + 1), np.int64)
        for batch in batches:
            x = _spread(batch.column(0), dim)
            for at in range(0, len(x), CHUNK):
                for i, p in enumerate(moduli):
                    total[i] = (total[i] + residue_products(x[at : at + CHUNK], middle, p)) % p
        for i, p in enumerate(moduli):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1, p)), pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(total[i].tolist(), pa.list_(pa.int64()))], names=["prime", "at", "row"])

    return run


def scatter(fit: DataFrame, dim: int, centre: list[int], bound: int, rows: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, products), exact: the number of compact rows (x), and the sums and summed products of their components less `centre`,
    none of which exceeds `bound`; there are `rows` rows at most."""
    moduli = primes(2 * rows * max(1, bound) ** 2)
    each = fit.select("x").mapInArrow(_products(dim, centre, moduli), "prime long, at int, row array<long>").select("prime", "at", F.posexplode("row").alias("to", "r"))
    told = {(r["at"], r["to"], r["prime"]): r["r"] for r in each.where("at <= to").groupBy("prime", "at", "to").agg(F.sum("r").alias("r")).collect()}
    whole = lambda i, j: remainder([told.get((min(i, j), max(i, j), p), 0) for p in moduli], moduli)
    return whole(0, 0), [whole(0, j) for j in range(1, dim + 1)], [[whole(i, j) for j in range(1, dim + 1)] for i in range(1, dim + 1)]


class Whitening:
    """The components of a fit: n vectors with sums S, the first eigenvalues and unit eigenvectors of their covariance, its trace."""

    def __init__(self, n: int, sums: list[int], centre: list[int], products: list[list[int]], components: int) -> None:
        d = len(sums)
        self.n, self.sums = n, [s + n * c for s, c in zip(sums, centre, strict=True)]
        # n squared times the covariance, a whole number; its quotient is rounded once.
        scaled = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        covariance = np.array([[v / (n * n) for v in row] for row in scaled])
        self.trace = sum(scaled[i][i] for i in range(d)) / (n * n)
        value, vector = np.linalg.eigh(covariance)
        self.value, self.vector = value[::-1][:components], vector[:, ::-1][:, :components]
        largest = np.abs(self.vector).argmax(0)
        self.vector = self.vector * np.where(self.vector[largest, np.arange(len(largest))] < 0, -1.0, 1.0)
        #: Components with any variance beyond rounding.
        self.sound = self.value > d * 2.0**-52 * max(value[-1], 0)
        self.explained = [float(e) / self.trace if self.trace and s else 0.0 if self.trace else None for e, s in zip(self.value, self.sound, strict=True)]

    def apply(self, x: np.ndarray) -> tuple[list[int | None] | np.ndarray, np.ndarray]:
        """(deviations, whitened) of the rows of `x`; a deviation that doesn't fit a long is None, an unsound component NaN."""
        top = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums))
        if top**2 * x.shape[1] < 2**63:
            far = self.n * x - np.array(self.sums, np.int64)
            deviation = np.einsum("ij,ij->i", far, far)
            centred = far / self.n
        else:
            far = self.n * x.astype(object) - np.array(self.sums, object)
            deviation = [s if s < 2**63 else None for s in (far * far).sum(1).tolist()]
            centred = np.array([[v / self.n for v in row] for row in far.tolist()]).reshape(x.shape)
        with np.errstate(invalid="ignore", divide="ignore"):
            return deviation, np.where(self.sound, centred @ self.vector / np.sqrt(np.where(self.sound, self.value, 1)), np.nan)


def _whitened(fit: Whitening, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The components of compact rows (x), a column each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white = fit.apply(_spread(batch.column(0), dim))[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in white.T], names=[f"w{k}" for k in range(white.shape[1])])

    return run


def identity_error(fit: DataFrame, white: Whitening, dim: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over its sound components; None without one."""
    sound = np.flatnonzero(white.sound).tolist()
    if not sound:
        return None
    rows = fit.select("x").mapInArrow(_whitened(white, dim), ", ".join(f"w{k} double" for k in range(len(white.value))))
    pairs = [(i, j) for i in sound for j in sound if i <= j]
    told = rows.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"{i}/{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(told, pairs, strict=True))


def _result(white: Whitening, dim: int, error: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (id, v): a row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(white.value)
        for batch in batches:
            x = matrix(batch.column(1))
            deviation, w = white.apply(x)
            m = len(x)
            row = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, white.n)), pa.array(deviation, pa.int64()).take(row)]
            columns += [pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(white.explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, dim: int | None = None) -> DataFrame:
    """(id, component int, n long, deviation long, whitened, explained, identity_error double) of every row that takes part and each of the first components.

    Components c of a vector become x = floor(scale * c). The fit list has each different x once: n vectors with sums S. `deviation` is the
    sum of (n x - S)^2, exact; `whitened` is x - S/n, projected on the component and divided by the root of its eigenvalue e; `explained` is e
    over the trace; `identity_error` is the largest absolute entry of the whitened fit list's covariance less the identity. The largest entry of an eigenvector is positive.

    Rows with a null, NaN or infinite component, or one whose floor doesn't fit a long, drop out, as do vectors whose length isn't `dim`; if that isn't given, it is the length that most
    vectors have, the longer of two. Where the fit list has no variance along a component (beyond rounding), `whitened` is null and `explained` 0, or
    null if there is none at all; `identity_error` is over the others, null without any. A deviation that doesn't fit a long is null. With fewer dimensions there are
    fewer components, with empty vectors or without rows none. Repeated rows and null ids are rows like all. The id column keeps its name and type; other columns aren't read.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    names = [id_col, *(fresh(n, [id_col]) for n in ("component", "n", "deviation", "whitened", "explained", "identity_error"))]
    kinds = (kind, IntegerType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType())
    vectors = to_integers(df, id_col, vector_col, scale, dim)
    if dim is None:
        first = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        dim = first["dim"] if first else 0
        vectors = vectors.where(F.size("v") == dim)
    extent = vectors.select("v").mapInArrow(_extent, "at int, n long, low long, high long, total string") if dim else None
    told = extent.groupBy("at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("at").collect() if dim else []
    if not told:
        return spark.createDataFrame([], as_schema(*zip(names, kinds, strict=True))[0])
    rows, centre = told[0]["n"], [int(r["total"]) // r["n"] for r in told]
    bound = max(max(abs(r["low"] - c), abs(r["high"] - c)) for r, c in zip(told, centre, strict=True))
    compact, _ = as_schema(("id", kind), ("x", BinaryType()))
    fit = materialise(vectors.mapInArrow(_compact, compact).select("x").distinct())
    n, sums, products = scatter(fit, dim, centre, bound, rows)
    white = Whitening(n, sums, centre, products, components)
    shape, _ = as_schema(*zip(("id", "component", "n", "deviation", "whitened", "explained", "identity_error"), kinds, strict=True))
    return vectors.mapInArrow(_result(white, dim, identity_error(fit, white, dim)), shape).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
