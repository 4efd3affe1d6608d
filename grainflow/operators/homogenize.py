"""Estimates of a polycrystal's effective properties: Voigt, Reuss, Hill and geometric means.

Orientations are constant within grains, so points are counted by phase and orientation first; tensor work is then done
once for each kind, and its sums are weighted by the counts. Conductivity stays in column expressions. The 6 x 6 work is
done in Arrow batches that return one partial sum each, added up by an ordinary aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.functions import kernels as K
from grainflow.functions import tensors as T

ANGLES = ("phi1", "phi", "phi2")
METHODS = ("voigt", "reuss", "hill", "geometric")


def orientation_counts(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., phase, phi1, phi, phi2, points): how often each phase and orientation occurs."""
    return points.groupBy(*by, "phase", *ANGLES).agg(F.count("*").alias("points"))


def volume_fractions(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., phase, points, fraction)."""
    from pyspark.sql import Window

    counted = points.groupBy(*by, "phase").agg(F.count("*").alias("points"))  # a few phases for each map
    return counted.withColumn("fraction", F.col("points") / F.sum("points").over(Window.partitionBy(*(by or (F.lit(0),)))))


def homogenised_density(points: DataFrame, phases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    parts = volume_fractions(points, by).join(F.broadcast(phases), "phase")  # at most eight phases
    return parts.groupBy(*by).agg(F.sum(F.col("fraction") * F.col("density")).alias("density"))


def rotated_conductivity(points: DataFrame, phases: DataFrame, frame_deg: float = 0.0, prefix: str = "k") -> DataFrame:
    """Points with the conductivity of their phase in sample axes: k11 ... k33."""
    both = points.join(F.broadcast(phases.select("phase", "kappa")), "phase")
    a = T.rotation(F.col("phi1"), F.col("phi"), F.col("phi2"), frame_deg)
    return both.select(*points.columns, *T.named(T.congruence(a, T.of_array("kappa")), prefix))


def conductivity_estimates(points: DataFrame, phases: DataFrame, by: tuple[str, ...] = (), frame_deg: float = 0.0) -> DataFrame:
    """(by..., method, k11 ... k33): voigt, reuss and hill, a row for each."""
    kinds = rotated_conductivity(orientation_counts(points, by), phases, frame_deg)
    matrix = [[F.col(f"k{i}{j}") for j in (1, 2, 3)] for i in (1, 2, 3)]
    weight = F.col("points")
    mean = lambda c, name: (F.sum(c * weight) / F.sum(weight)).alias(name)
    inverted = T.inverse(matrix)
    means = kinds.groupBy(*by).agg(*(mean(matrix[i][j], f"v{i}{j}") for i in range(3) for j in range(3)), *(mean(inverted[i][j], f"r{i}{j}") for i in range(3) for j in range(3)))
    both = lambda p: [[(F.col(f"{p}{i}{j}") + F.col(f"{p}{j}{i}")) / 2 for j in range(3)] for i in range(3)]
    voigt, reuss = both("v"), T.inverse(both("r"))
    hill = [[(voigt[i][j] + reuss[i][j]) / 2 for j in range(3)] for i in range(3)]
    rows = [F.struct(F.lit(name).alias("method"), *T.named(m, "k")) for name, m in (("voigt", voigt), ("reuss", reuss), ("hill", hill))]
    return means.select(*by, F.explode(F.array(*rows)).alias("row")).select(*by, "row.*")


_SIZES = {"c": 36, "s": 36, "logc": 36, "alpha": 6, "beta": 6, "logbeta": 9, "logk": 9}
_SUMS = ", ".join(f"{n} array<double>" for n in _SIZES)


def _partial_sums(frame: np.ndarray, by: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
            tensor = lambda n, k: np.array(batch.column(n).to_pylist(), float).reshape((-1, *k))
            a = frame @ K.rotations(np.stack([column(n) for n in ANGLES], 1))
            w = column("points").astype(float)
            c = tensor("stiffness", (6, 6))
            stiff, comply = K.rotated_stiffness(a, c), K.rotated_compliance(a, np.linalg.inv(c))
            alpha = K.rotated_expansion(a, tensor("alpha", (6,)))
            beta = np.einsum("nij,nj->ni", stiff, alpha)
            kappa = a @ tensor("kappa", (3, 3)) @ a.transpose(0, 2, 1)
            terms = {
                "c": stiff, "s": comply, "logc": K.symmetric_function((stiff + stiff.transpose(0, 2, 1)) / 2, lambda v: np.log(np.maximum(v, K.TINY))), "alpha": alpha, "beta": beta,
                # Stress-like, but averaged with its shear halved: a convention of this estimate.
                "logbeta": K.symmetric_function(K.to_tensor(beta, 2.0), K.safe_log), "logk": K.symmetric_function((kappa + kappa.transpose(0, 2, 1)) / 2, lambda v: np.log(np.maximum(v, K.TINY))),
            }
            groups = batch.select(list(by)).to_pylist() if by else [{}] * batch.num_rows
            keys = [tuple(g.values()) for g in groups]
            for key in dict.fromkeys(keys):
                rows = np.array([k == key for k in keys])
                weighted = {n: np.tensordot(w[rows], t[rows], 1).ravel() for n, t in terms.items()}
                yield pa.RecordBatch.from_pylist([dict(zip(by, key, strict=True)) | {"weight": float(w[rows].sum())} | {n: v.tolist() for n, v in weighted.items()}])

    return run


def property_estimates(points: DataFrame, phases: DataFrame, by: tuple[str, ...] = (), frame_deg: float = 0.0) -> DataFrame:
    """(by..., method, stiffness array[36], alpha array[6], beta array[6], kappa_geometric array[9]) for
    voigt, reuss, hill and geometric; the last column is set for geometric alone.

    alpha: Reuss is the mean, Voigt the stiffness-weighted mean, Hill their mean; geometric from the mean logarithm of
    the stress-temperature moduli. beta = C alpha, but for Hill, whose beta is the mean of the two.
    """
    t = np.radians(frame_deg)
    frame = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1.0]])
    kinds = orientation_counts(points, by).join(F.broadcast(phases.select("phase", "stiffness", "alpha", "kappa")), "phase")
    kind = {f.name: f.dataType.simpleString() for f in points.schema}
    parts = kinds.mapInArrow(_partial_sums(frame, by), ", ".join([*(f"`{b}` {kind[b]}" for b in by), "weight double", _SUMS]))
    sums = parts.groupBy(*by).agg(F.sum("weight").alias("weight"), *(F.array(*(F.sum(F.col(n)[i]) for i in range(size))).alias(n) for n, size in _SIZES.items()))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not r["weight"]:
                    continue
                mean = {n: np.array(r[n]) / r["weight"] for n in _SIZES}
                sym = lambda m: (m + m.T) / 2
                voigt, reuss = sym(mean["c"].reshape(6, 6)), sym(np.linalg.inv(mean["s"].reshape(6, 6)))
                stiff = {"voigt": voigt, "reuss": reuss, "hill": (voigt + reuss) / 2, "geometric": K.symmetric_function(mean["logc"].reshape(6, 6), np.exp)}
                log_beta = K.symmetric_function(mean["logbeta"].reshape(1, 3, 3), np.exp)
                alpha = {"voigt": np.linalg.solve(voigt, mean["beta"]), "reuss": mean["alpha"], "geometric": np.linalg.solve(stiff["geometric"], K.to_voigt(log_beta, 2.0)[0])}
                alpha["hill"] = (alpha["voigt"] + alpha["reuss"]) / 2
                beta = {m: stiff[m] @ alpha[m] for m in ("voigt", "reuss", "geometric")}
                beta["hill"] = (beta["voigt"] + beta["reuss"]) / 2
                kappa = K.symmetric_function(mean["logk"].reshape(3, 3), np.exp).ravel().tolist()
                out += [{b: r[b] for b in by} | {"method": m, "stiffness": stiff[m].ravel().tolist(), "alpha": alpha[m].tolist(), "beta": beta[m].tolist(), "kappa_geometric": kappa if m == "geometric" else None} for m in METHODS]
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return sums.mapInArrow(finish, ", ".join([*(f"`{b}` {kind[b]}" for b in by), "method string", "stiffness array<double>", "alpha array<double>", "beta array<double>", "kappa_geometric array<double>"]))


def engineering_properties(estimates: DataFrame) -> DataFrame:
    """(method, name, value): moduli and Poisson's ratios of each method's stiffness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"method": r["method"], "name": n, "value": float(v)} for r in batch.to_pylist() for n, v in K.engineering_constants(np.array(r["stiffness"]).reshape(6, 6)).items()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return estimates.select("method", "stiffness").mapInArrow(run, "method string, name string, value double")


def cleaned(df: DataFrame, column: str, size: int, ratio: float = 1e-6) -> DataFrame:
    """`df` with the square matrix in an array column made symmetric and its entries under `ratio` of the largest set to zero."""
    entries = [(F.col(column)[size * i + j] + F.col(column)[size * j + i]) / 2 for i in range(size) for j in range(size)]
    whole = df.withColumn(column, F.array(*entries))
    limit = ratio * F.array_max(F.transform(column, F.abs))
    return whole.withColumn("__limit", limit).withColumn(column, F.transform(column, lambda x: F.when(F.abs(x) < F.col("__limit"), F.lit(0.0)).otherwise(x))).drop("__limit")
