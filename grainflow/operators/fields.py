"""Statistics and interpolation of fields given at quadrature points: (elem_id, qp, weight, value...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def weighted_mean(field: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., mean): the integral of the field over its area; of each phase, say, with by = ("phase",)."""
    return field.groupBy(*by).agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("mean"))


def to_elements(field: DataFrame, value: str) -> DataFrame:
    """(elem_id, value): the plain mean over each element's points."""
    return field.groupBy("elem_id").agg(F.avg(value).alias(value))


def to_nodes(field: DataFrame, elements: DataFrame, value: str) -> DataFrame:
    """(node_id, value): the mean over the elements around each corner node."""
    each = to_elements(field, value).join(elements.select("elem_id", F.explode(F.array("n1", "n2", "n3")).alias("node_id")), "elem_id")
    return each.groupBy("node_id").agg(F.avg(value).alias(value))


#: Numbers of matrices that are solved together, and rows that wait for it, about.
TOGETHER, WAITING = 2_000_000, 100_000
#: Condition, by estimate, from which a matrix is solved by its singular values, those that are nothing but rounding left out.
CONDITION = 1e9


def _weights(a: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The solutions of symmetric matrices a (g, n, n) for right sides f (g, n, v)."""
    n = a.shape[1]
    probes = np.where(np.random.default_rng(0).integers(0, 2, (n, 3)), 1.0, -1.0)
    try:
        both = np.linalg.solve(a, np.concatenate([f, np.broadcast_to(probes, (len(a), n, 3))], 2))
    except np.linalg.LinAlgError:
        both = np.full((len(a), n, f.shape[2] + 3), np.nan)
    out = both[:, :, : f.shape[2]].copy()
    size = np.abs(a).sum(2).max(1) * np.abs(both[:, :, f.shape[2] :]).max((1, 2))
    for g in np.flatnonzero(~(size < CONDITION)):
        out[g] = np.linalg.lstsq(a[g], f[g], rcond=None)[0]
    return out


def _interpolated(rows: pa.Table, grain: str, values: list[str], kinds: pa.Schema) -> pa.Table:
    """Targets of whole grains that stand together, by the places of the same grain; grains with as many places and targets are solved at once."""
    ends = pc.run_end_encode(rows.column(grain).combine_chunks()).run_ends.to_numpy()
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    target = rows.column("__target").to_numpy()
    xy = np.stack([rows.column(c).to_numpy() for c in "xy"], 1) + 0.0  # no negative zeros
    at, to = np.flatnonzero(~target), np.flatnonzero(target)
    f = np.stack([rows.column(v).to_numpy() for v in values], 1)
    # Places that repeat are averaged.
    at = at[np.lexsort((xy[at, 1], xy[at, 0], own[at]))]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(own[at]) != 0) | (np.diff(xy[at], axis=0) != 0).any(1)])) if len(at) else np.zeros(0, int)
    f = np.add.reduceat(f[at], new) / np.diff(np.append(new, len(at)))[:, None] if len(at) else f[:0]
    at = at[new]
    known, asked = np.bincount(own[at], minlength=len(ends)), np.bincount(own[to], minlength=len(ends))
    first, start = np.cumsum(known) - known, np.cumsum(asked) - asked
    out = np.full((len(to), len(values)), np.nan)
    far = lambda p, q: np.sqrt(np.sqrt((p[:, :, None, 0] - q[:, None, :, 0]) ** 2 + (p[:, :, None, 1] - q[:, None, :, 1]) ** 2) + 1)
    for n, m in np.unique(np.stack([known, asked], 1)[(known > 0) & (asked > 0)], axis=0):
        same = np.flatnonzero((known == n) & (asked == m))
        step = max(1, TOGETHER // int(n * max(n, m)))
        for k in range(0, len(same), step):
            part = same[k : k + step]
            i, j = first[part][:, None] + np.arange(n), start[part][:, None] + np.arange(m)
            p = xy[at[i]]
            out[j] = far(xy[to[j]], p) @ _weights(far(p, p), f[i])
    have = np.flatnonzero(known[own[to]] > 0)
    found = rows.select([grain, "target_id", "x", "y"]).take(pa.array(to[have]))
    for c, v in enumerate(values):
        found = found.append_column(v, pa.array(out[have, c]))
    return found.cast(kinds)


def interpolate(field: DataFrame, targets: DataFrame, grain: str, values: list[str]) -> DataFrame:
    """(grain, target_id, x, y, values...): radial interpolation with sqrt(r + 1) inside each grain, so that fields may jump between grains.

    `field` has (grain, x, y, values...), `targets` (grain, target_id, x, y). All fields share one factorisation of a
    grain's matrix; a grain is one task's work and must fit it. Places that repeat are averaged first. Grains stream through a task in their
    order, after one shuffle, and small ones are solved together.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    known = field.select(grain, F.lit(None).cast("long").alias("target_id"), *map(number, ("x", "y", *values)), F.lit(False).alias("__target"))
    asked = targets.select(grain, F.col("target_id").cast("long").alias("target_id"), number("x"), number("y"), *(F.lit(None).cast("double").alias(v) for v in values), F.lit(True).alias("__target"))
    rows = known.unionByName(asked).repartition(grain).sortWithinPartitions(grain)
    shape = StructType([StructField(grain, field.schema[grain].dataType), StructField("target_id", LongType()), *(StructField(c, DoubleType()) for c in ("x", "y", *values))])
    kinds = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            if n >= WAITING:  # all but the last grain, which may go on, is whole
                ends = pc.run_end_encode(batch.column(grain)).run_ends.to_numpy()
                cut = 0 if batch.column(grain)[0] != last else int(ends[0])
                if cut < len(batch):
                    yield from _interpolated(pa.Table.from_batches([*held, batch.slice(0, cut)]), grain, values, kinds).to_batches()
                    held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n, last = n + len(batch), batch.column(grain)[-1]
        if held:
            yield from _interpolated(pa.Table.from_batches(held), grain, values, kinds).to_batches()

    return rows.mapInArrow(run, shape)


def statistics(field: DataFrame, values: list[str]) -> DataFrame:
    """(field, low, mean, high): of each of the fields its extremes and its mean over the area, one row each."""
    each = field.select("weight", F.explode(F.array(*(F.struct(F.lit(v).alias("field"), F.col(v).alias("value")) for v in values))).alias("f"))
    return each.groupBy("f.field").agg(F.min("f.value").alias("low"), (F.sum(F.col("f.value") * F.col("weight")) / F.sum("weight")).alias("mean"), F.max("f.value").alias("high"))


def regular_grid(field: DataFrame, columns: int = 25) -> DataFrame:
    """(target_id, x, y): the centres of square cells, `columns` of them across the field, for arrows and images."""
    box = field.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    step = (F.col("x1") - F.col("x0")) / columns
    rows = F.greatest(F.lit(1), F.ceil((F.col("y1") - F.col("y0")) / step).cast("int"))
    cells = box.withColumn("step", step).withColumn("j", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    return cells.select((F.col("j") * columns + F.col("i")).cast("long").alias("target_id"), (F.col("x0") + (F.col("i") + 0.5) * F.col("step")).alias("x"), (F.col("y0") + (F.col("j") + 0.5) * F.col("step")).alias("y"))
