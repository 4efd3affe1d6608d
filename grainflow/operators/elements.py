"""Material of mesh elements, from the map's points that lie in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.functions import kernels as K
from grainflow.operators import mesh, spatial
from grainflow.operators.components import checkpointed
from grainflow.operators.homogenize import ANGLES

METHODS = ("nearest", "voigt", "reuss", "hill", "geometric")


def points_of_elements(points: DataFrame, elements: DataFrame, nodes: DataFrame, cell: float = 1.0) -> DataFrame:
    """(elem_id, point_id): the points in each element, and for an element with none, the point nearest to its centre."""
    placed = mesh.corners(elements, nodes)
    at = points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    # Buckets twice as wide as triangles: few copies of a triangle, few triangles for a point.
    wide = [F.avg(F.greatest(*(F.col(f"{v}{i}") for i in (1, 2, 3))) - F.least(*(F.col(f"{v}{i}") for i in (1, 2, 3)))) for v in "xy"]
    inside = checkpointed(spatial.points_in_triangles(at, placed, max(cell, *(2 * (w or 0.0) for w in placed.agg(*wide).first()))).select("elem_id", "point_id"))
    centres = checkpointed(mesh.quality(placed).join(inside, "elem_id", "left_anti").select(F.col("elem_id").alias("query_id"), F.col("cx").alias("x"), F.col("cy").alias("y")))
    if centres.isEmpty():
        return inside
    return inside.unionByName(spatial.nearest(centres, at, 1, cell).select(F.col("query_id").alias("elem_id"), "point_id"))


def material(points: DataFrame, phases: DataFrame, elements: DataFrame, nodes: DataFrame, method: str = "nearest", frame_deg: float = 0.0, cell: float = 1.0) -> DataFrame:
    """(elem_id, phase, stiffness array[36], alpha array[6], kappa array[9]) of every element, in sample axes.

    nearest takes the point closest to the centre; the others average over the points in the element. `phase` is the most frequent one.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method == "nearest":
        at = points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        centres = mesh.quality(mesh.corners(elements, nodes)).select(F.col("elem_id").alias("query_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
        pairs = spatial.nearest(centres, at, 1, cell).select(F.col("query_id").alias("elem_id"), "point_id")
    else:
        pairs = points_of_elements(points, elements, nodes, cell)
    t = np.radians(frame_deg)
    frame = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1.0]])
    known = {r["phase"]: r for r in phases.select("phase", "stiffness", "alpha", "kappa").collect()}  # at most eight
    # Points of one phase and orientation in an element count as one with a weight, and an element is one row.
    kinds = pairs.join(points.select("point_id", "phase", *ANGLES), "point_id").where(F.col("phase").isin(*known) if known else F.lit(False)).repartition("elem_id").groupBy("elem_id", "phase", *ANGLES).agg(F.count("*").cast("double").alias("n"))
    rows = kinds.groupBy("elem_id").agg(F.array_sort(F.collect_list(F.struct("phase", *ANGLES, "n"))).alias("kinds"))

    ids = np.array(sorted(known), np.int64)
    table = {n: np.array([known[x][n] for x in ids.tolist()], float).reshape(len(ids), *shape) for n, shape in (("stiffness", (6, 6)), ("alpha", (6,)), ("kappa", (3, 3)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column("kinds")
            size = np.diff(column.offsets.to_numpy())
            start = np.cumsum(size) - size
            flat = column.flatten()
            own, w = flat.field("phase").to_numpy().astype(np.int64), flat.field("n").to_numpy()
            total = np.add.reduceat(w, start)
            mean = lambda m: np.add.reduceat(m * w.reshape(-1, *[1] * (m.ndim - 1)), start) / total.reshape(-1, *[1] * (m.ndim - 1))  # noqa: E731, B023
            of = lambda n: table[n][np.searchsorted(ids, own)]  # noqa: E731, B023
            a = frame @ K.rotations(np.stack([flat.field(x).to_numpy(zero_copy_only=False).astype(float) for x in ANGLES], 1))
            c = of("stiffness")
            stiff, comply = K.rotated_stiffness(a, c), K.rotated_compliance(a, np.linalg.inv(c))
            alpha = K.rotated_expansion(a, of("alpha"))
            kappa = a @ of("kappa") @ a.transpose(0, 2, 1)
            voigt, reuss = (mean(stiff), mean(kappa)), (np.linalg.inv(mean(comply)), np.linalg.inv(mean(np.linalg.inv(kappa))))
            log = lambda m: K.symmetric_function(mean(K.symmetric_function((m + m.transpose(0, 2, 1)) / 2, K.safe_log)), np.exp)
            av, ar = np.linalg.solve(voigt[0], mean(np.einsum("nij,nj->ni", stiff, alpha))[:, :, None])[:, :, 0], mean(alpha)
            if method == "geometric":
                found = (log(stiff), log(kappa), ar)
            else:
                found = {"nearest": (*voigt, ar), "voigt": (*voigt, av), "reuss": (*reuss, ar), "hill": ((voigt[0] + reuss[0]) / 2, (voigt[1] + reuss[1]) / 2, (av + ar) / 2)}[method]
            # Kinds of a phase stand together; of each element the phase with most points, the smaller one of equals.
            element = np.repeat(np.arange(len(size)), size)
            runs = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(element) != 0)]))
            count, of_run, phase = np.add.reduceat(w, runs), element[runs], own[runs]
            order = np.lexsort((phase, -count, of_run))
            most = phase[order[np.concatenate([[True], np.diff(of_run[order]) != 0])]]
            lists = lambda m, n: pa.ListArray.from_arrays(np.arange(0, n * len(size) + 1, n, dtype=np.int32), np.ascontiguousarray(m, float).ravel())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("elem_id").cast(pa.int64()), pa.array(most.astype(np.int32)), lists(found[0], 36), lists(found[2], 6), lists(found[1], 9)], names=["elem_id", "phase", "stiffness", "alpha", "kappa"])

    return rows.mapInArrow(run, "elem_id long, phase int, stiffness array<double>, alpha array<double>, kappa array<double>")


def grain_of_elements(elements: DataFrame, nodes: DataFrame, vertices: DataFrame, grain: str, cell: float = 1.0) -> DataFrame:
    """(elem_id, grain): the first ring that holds the element's centre; elements in none get the grain with the nearest vertex."""
    centres = mesh.quality(mesh.corners(elements, nodes)).select(F.col("elem_id").alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    inside = spatial.points_in_polygons(centres, vertices, grain, cell).groupBy("point_id").agg(F.min(grain).alias(grain))
    rest = centres.join(inside, "point_id", "left_anti").withColumnRenamed("point_id", "query_id")
    numbered = vertices.select(F.xxhash64(grain, "seq").alias("point_id"), grain, "x", "y")
    near = spatial.nearest(rest, numbered, 1, cell).join(numbered.select("point_id", grain), "point_id").select(F.col("query_id").alias("point_id"), grain)
    return inside.unionByName(near).select(F.col("point_id").alias("elem_id"), grain)


def deepest(distances: DataFrame, key: str) -> DataFrame:
    """(point_id, key): the ring that each point lies deepest in, from (point_id, key, distance), negative inside."""
    return distances.groupBy("point_id").agg(F.min_by(key, F.struct("distance", key)).alias(key))
