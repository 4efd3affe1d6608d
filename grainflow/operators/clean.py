"""Cleaning of maps: phases numbered from 1, unit grid, crop, stray pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.operators.components import checkpointed

MOST_PHASES = 8


def renumber_phases(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Phases become 1, 2, ... in the order of their values, for each map. More than eight are an error."""
    kinds = points.select(*by, "phase").distinct()  # a few for each map
    number = F.row_number().over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("phase"))
    checked = F.when(number <= MOST_PHASES, number).otherwise(F.raise_error(F.lit(f"more than {MOST_PHASES} phases")).cast("int"))
    ranked = kinds.select(*by, F.col("phase").alias("was"), checked.alias("number"))
    same = F.col("phase").eqNullSafe(F.col("was"))
    left = points.alias("p").join(F.broadcast(ranked.select(*(F.col(b).alias(f"__{b}") for b in by), "was", "number")), same if not by else same & _all(F.col(f"p.{b}") == F.col(f"__{b}") for b in by))
    return left.select(*(F.col("number").alias("phase") if c == "phase" else F.col(f"p.{c}") for c in points.columns))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def unit_grid(points: DataFrame, by: tuple[str, ...] = (), flip: bool = True) -> DataFrame:
    """Coordinates in steps from the lower left corner; with `flip`, y points up. The step is the least distance between columns."""
    xs = points.select(*by, "x").distinct()
    gap = F.col("x") - F.lag("x").over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("x"))  # distinct columns of one map
    steps = xs.withColumn("gap", gap).groupBy(*by).agg(F.min("gap").alias("step"))
    ends = points.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    frame = ends.join(steps, list(by)) if by else ends.join(steps)
    both = points.join(F.broadcast(frame), list(by)) if by else points.join(F.broadcast(frame))  # a row for each map
    y = F.col("y1") - F.col("y") if flip else F.col("y") - F.col("y0")
    place = {"x": F.round((F.col("x") - F.col("x0")) / F.col("step")), "y": F.round(y / F.col("step"))}
    return both.select(*(place[c].cast("long").alias(c) if c in place else F.col(c) for c in points.columns))


def crop(points: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


#: The passes of `remove_strays`: the diagonal neighbour (dx, dy).
DIAGONALS = ((1, 1), (-1, 1), (1, -1), (-1, -1))


def remove_strays(points: DataFrame, same: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Four passes over a unit grid (integer x, y), one for each diagonal: an interior pixel that equals its diagonal neighbour in
    `same` but neither of the two pixels between them takes the values of the one above or below it.

    Each pass reads the neighbours along rows, and the neighbouring rows through a window over columns.
    """
    out = points
    value = F.struct(*same)
    row, column = Window.partitionBy(*by, "y").orderBy("x"), Window.partitionBy(*by, "x").orderBy("y")
    edge = points.groupBy(*by).agg(F.min("x").alias("__x0"), F.max("x").alias("__x1"), F.min("y").alias("__y0"), F.max("y").alias("__y1"))
    for dx, dy in DIAGONALS:
        at = lambda c, w, d: (F.lead(c) if d > 0 else F.lag(c)).over(w)
        beside = out.withColumn("__value", value).withColumn("__side", at("__value", row, dx))
        seen = beside.withColumn("__level", at("__value", column, dy)).withColumn("__corner", at("__side", column, dy))
        joined = seen.join(F.broadcast(edge), list(by)) if by else seen.join(F.broadcast(edge))
        inside = (F.col("x") > F.col("__x0")) & (F.col("x") < F.col("__x1")) & (F.col("y") > F.col("__y0")) & (F.col("y") < F.col("__y1"))
        stray = inside & (F.col("__value") == F.col("__corner")) & (F.col("__value") != F.col("__side")) & (F.col("__value") != F.col("__level"))
        new = joined.withColumn("__new", F.when(stray, F.col("__level")).otherwise(F.col("__value")))
        out = new.select(*(F.col(f"__new.{c}").alias(c) if c in same else F.col(c) for c in points.columns))
    return out


def robust_limits(values: DataFrame, value: str, by: tuple[str, ...] = (), width: float = 2.5) -> DataFrame:
    """(by..., low, high): mean less and plus `width` deviations, within the extremes."""
    mean, spread = F.avg(value), F.stddev_pop(value)
    return values.groupBy(*by).agg(F.greatest(mean - width * spread, F.min(value)).alias("low"), F.least(mean + width * spread, F.max(value)).alias("high"))


def majority_round(points: DataFrame, width: int, height: int, least: int, reach: int = 2) -> DataFrame:
    """Points (point_id, x, y, phase) of a periodic map of the phases 1 and 2; those with fewer than `least` points of their own phase
    in the square of 2 * reach + 1 points around them change phase. Counts are added up along x, then along y."""
    near = lambda c, n: F.explode(F.array(*(F.pmod(F.col(c) + k, F.lit(n)) for k in range(-reach, reach + 1))))
    two = (F.col("phase") == 2).cast("long")
    along = points.select(near("x", width).alias("x"), "y", two.alias("two")).groupBy("x", "y").agg(F.sum("two").alias("two"))
    around = along.select("x", near("y", height).alias("y"), "two").groupBy("x", "y").agg(F.sum("two").alias("__two"))
    own = F.when(F.col("phase") == 2, F.col("__two")).otherwise((2 * reach + 1) ** 2 - F.col("__two"))
    turned = F.when(own < least, 3 - F.col("phase")).otherwise(F.col("phase")).cast("int")
    return points.join(around, ["x", "y"]).select(*(turned.alias(c) if c == "phase" else F.col(c) for c in points.columns))


def remove_minorities(points: DataFrame, width: int, height: int, least: int, reach: int = 2, rounds: int = 20) -> DataFrame:
    """`majority_round` again and again until the number of points of phase 2 stays the same, at most `rounds` times."""
    before, now = None, checkpointed(points)
    for _ in range(rounds):
        count = now.where("phase = 2").count()
        if count == before:
            break
        before, now = count, checkpointed(majority_round(now, width, height, least, reach))
    return now
