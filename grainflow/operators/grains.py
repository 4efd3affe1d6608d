"""Grains of a map on a unit grid: points(map keys..., point_id, x, y, phase, phi1, phi, phi2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainflow.operators.components import checkpointed, connected_components
from grainflow.operators.homogenize import ANGLES
from grainflow.operators.ranking import numbered

#: Half of the eight neighbours; the other half are the same pairs.
STEPS = ((1, 0), (0, 1), (1, 1), (1, -1))


def neighbour_pairs(points: DataFrame, same: list[str], by: tuple[str, ...] = (), steps=STEPS) -> DataFrame:
    """(a, b): ids of neighbouring points that agree in `same`. Each point is looked up by its own place, an equi-join."""
    right = points.select(*(F.col(c).alias(f"__{c}") for c in (*by, "x", "y", *same)), F.col("point_id").alias("b"))
    shifted = points.select(*by, *same, F.col("point_id").alias("a"), F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps))).alias("to"))
    on = (F.col("to.x") == F.col("__x")) & (F.col("to.y") == F.col("__y"))
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return shifted.join(right, on).select("a", "b")


def grains(points: DataFrame, same: tuple[str, ...] = (*ANGLES, "phase"), by: tuple[str, ...] = ()) -> DataFrame:
    """Points with `grain_id`: the least point id of the connected points that agree in `same` (eight neighbours count)."""
    found = connected_components(neighbour_pairs(points, list(same), by))
    return points.join(found, points["point_id"] == found["node"], "left").select(*points.columns, F.coalesce("component", "point_id").alias("grain_id"))


def orientation_groups(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., phase, angles, points, first_point): points of one phase and orientation, connected or not."""
    return points.groupBy(*by, "phase", *ANGLES).agg(F.count("*").alias("points"), F.min("point_id").alias("first_point"))


def corners(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, x, y, touching): corners of the grain's pixels that lie on its boundary, in units of a pixel, with (x, y) the pixel's lower left one."""
    each = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in (0, 1) for dy in (0, 1))))
    out = grained.select(*by, "grain_id", each.alias("at")).groupBy(*by, "grain_id", F.col("at.x").alias("x"), F.col("at.y").alias("y")).agg(F.count("*").alias("touching"))
    return out.where(F.col("touching") < 4)


def boundary_edges(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, x, y, across): mid-points, doubled so as to be whole, of pixel edges on the boundary of the grain; `across` is h or v."""
    sides = [(1, 0, "h"), (1, 2, "h"), (0, 1, "v"), (2, 1, "v")]
    each = F.explode(F.array(*(F.struct((2 * F.col("x") + dx).alias("x"), (2 * F.col("y") + dy).alias("y"), F.lit(k).alias("across")) for dx, dy, k in sides)))
    return grained.select(*by, "grain_id", each.alias("at")).groupBy(*by, "grain_id", "at.x", "at.y", "at.across").count().where(F.col("count") == 1).drop("count")


def junctions(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., x, y, grains): corners that three grains share, or two on the edge of the map, and the map's own corners."""
    shared = corners(grained, by).groupBy(*by, "x", "y").agg(F.count("*").alias("grains"))
    size = grained.groupBy(*by).agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    both = shared.join(F.broadcast(size), list(by)) if by else shared.join(F.broadcast(size))
    on_x, on_y = F.col("x").isin(F.col("x0"), F.col("x1")), F.col("y").isin(F.col("y0"), F.col("y1"))
    return both.where((F.col("grains") >= 3) | ((F.col("grains") >= 2) & (on_x | on_y)) | (on_x & on_y)).select(*by, "x", "y", "grains")


def periodic_junctions(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., x, y): junctions and, for those on an edge of the map, their images on the opposite edge."""
    found = junctions(grained, by).select(*by, "x", "y")
    size = grained.groupBy(*by).agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    both = found.join(F.broadcast(size), list(by)) if by else found.join(F.broadcast(size))
    ends = lambda c: F.when(F.col(c).isin(F.col(f"{c}0"), F.col(f"{c}1")), F.array(f"{c}0", f"{c}1")).otherwise(F.array(c))
    return both.select(*by, F.explode(ends("x")).alias("x"), "y", "y0", "y1").select(*by, "x", F.explode(ends("y")).alias("y")).distinct()


def shades(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., phase, angles, number, shade): the different orientations of each phase, numbered in order, and their place among
    them from 0 to 1, by which they are coloured."""
    w = Window.partitionBy(*by, "phase").orderBy(*ANGLES)  # distinct orientations alone
    kinds = orientation_groups(points, by).select(*by, "phase", *ANGLES)
    return kinds.select("*", F.dense_rank().over(w).alias("number"), F.percent_rank().over(w).alias("shade"))


def adjacency(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, neighbour, edges): how many pixel edges two grains share, in both directions."""
    sides = boundary_edges(grained, by)
    a, b = sides.alias("a"), sides.alias("b")
    on = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.grain_id") != F.col("b.grain_id"))
    for c in by:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on).groupBy(*(F.col(f"a.{c}").alias(c) for c in by), F.col("a.grain_id").alias("grain_id"), F.col("b.grain_id").alias("neighbour")).agg(F.count("*").alias("edges"))


def colours(near: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, colour): the least colour, from 0, that no neighbour with a higher priority has, of grains with neighbours (by..., grain_id, neighbour, both ways).

    Priorities are digests of the ids, so reruns agree. In a round every grain whose uncoloured neighbours all have lower priorities gets its colour; such grains are
    never neighbours. It comes out as if grain after grain were coloured in the order of priorities: with at most one colour more than
    the most neighbours. Rounds grow with the longest chain of falling priorities, some logarithm of the number of grains.
    """
    rank = lambda c: F.struct(F.md5(F.col(c).cast("string")), F.col(c))
    links = checkpointed(near.select(*by, "grain_id", "neighbour").where("grain_id <> neighbour").distinct().where(rank("neighbour") > rank("grain_id")))
    every = near.select(*by, "grain_id").unionByName(near.select(*by, F.col("neighbour").alias("grain_id"))).distinct()
    # Each grain waits for its higher neighbours alone.
    waiting = links.groupBy(*by, "grain_id").agg(F.count("*").alias("n"))
    new = checkpointed(every.join(waiting, [*by, "grain_id"], "left_anti").withColumn("colour", F.lit(0)))
    done = new
    told = None
    while not new.isEmpty():
        # What the grains with a colour tell their lower neighbours, added to what these know.
        news = links.join(new.withColumnRenamed("grain_id", "neighbour"), [*by, "neighbour"]).groupBy(*by, "grain_id").agg(F.count("*").alias("heard"), F.collect_set("colour").alias("used"))
        told = news if told is None else told.unionByName(news).groupBy(*by, "grain_id").agg(F.sum("heard").alias("heard"), F.array_distinct(F.flatten(F.collect_set("used"))).alias("used"))
        told = checkpointed(told)
        ready = told.join(waiting.withColumnRenamed("n", "wanted"), [*by, "grain_id"]).where("heard = wanted")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
        new = checkpointed(ready.select(*by, "grain_id", free.alias("colour")))
        told = told.join(new, [*by, "grain_id"], "left_anti")
        done = done.unionByName(new)
    return done


def merge_small(grained: DataFrame, least: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Grains of at most `least` points take the phase, angles and id of their largest larger neighbour, if any: ties go to more shared edges, then the smaller id.
    A neighbour that is small itself moves on, and takes along what came to it."""
    sizes = grained.groupBy(*by, "grain_id").agg(F.count("*").alias("size"))
    near = adjacency(grained, by).join(sizes, [*by, "grain_id"]).join(sizes.select(*by, F.col("grain_id").alias("neighbour"), F.col("size").alias("other")), [*by, "neighbour"])
    small = near.where((F.col("size") <= least) & (F.col("other") > F.col("size")))
    best = small.groupBy(*by, "grain_id").agg(F.max_by("neighbour", F.struct("other", "edges", -F.col("neighbour"))).alias("into"))
    for _ in range(least.bit_length()):  # sizes grow along a chain, so it has at most `least` steps; each round doubles what is followed
        later = best.select(*by, F.col("grain_id").alias("into"), F.col("into").alias("__next"))
        best = best.join(later, [*by, "into"], "left").select(*by, "grain_id", F.coalesce("__next", "into").alias("into"))
    values = grained.groupBy(*by, "grain_id").agg(*(F.min_by(c, "point_id").alias(f"__{c}") for c in ("phase", *ANGLES)))
    moves = best.join(values.withColumnRenamed("grain_id", "into"), [*by, "into"])
    out = grained.join(moves, [*by, "grain_id"], "left")
    new = {c: F.coalesce(f"__{c}", c).alias(c) for c in ("phase", *ANGLES)} | {"grain_id": F.coalesce("into", "grain_id").alias("grain_id")}
    return out.select(*(new.get(c, F.col(c)) for c in grained.columns))


def rank_by_size(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, vertices, rank): grains from few boundary corners to many; ties by id."""
    counted = corners(grained, by).groupBy(*by, "grain_id").agg(F.count("*").alias("vertices"))
    return numbered(counted, ["vertices", "grain_id"], "rank", by).withColumn("rank", (F.col("rank") + 1).cast("int"))


def majority(grained: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, value): the most frequent value of each grain, the smallest of those that are equally frequent."""
    counted = grained.groupBy(*by, "grain_id", value).agg(F.count("*").alias("n"))
    return counted.groupBy(*by, "grain_id").agg(F.min(F.struct(-F.col("n"), F.col(value).alias("v"))).alias("m")).select(*by, "grain_id", F.col("m.v").alias(value))


def enclosed(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., outer_id, inner_id): grains whose only neighbour is one other grain and that do not touch the map's edge."""
    near = adjacency(grained, by).groupBy(*by, "grain_id").agg(F.count("*").alias("n"), F.min("neighbour").alias("outer_id"))
    size = grained.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = grained.groupBy(*by, "grain_id").agg(F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("b"), F.max("y").alias("t"))
    inner = near.where(F.col("n") == 1).join(box, [*by, "grain_id"])
    both = inner.join(F.broadcast(size), list(by)) if by else inner.join(F.broadcast(size))
    return both.where((F.col("l") > F.col("x0")) & (F.col("r") < F.col("x1")) & (F.col("b") > F.col("y0")) & (F.col("t") < F.col("y1"))).select(*by, "outer_id", F.col("grain_id").alias("inner_id"))


def phase_boundaries(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., x, y, across, phase_a, phase_b): pixel edges between different phases, the smaller phase first."""
    sides = boundary_edges(grained, by).join(grained.groupBy(*by, "grain_id").agg(F.min_by("phase", "point_id").alias("phase")), [*by, "grain_id"])
    return sides.groupBy(*by, "x", "y", "across").agg(F.min("phase").alias("phase_a"), F.max("phase").alias("phase_b"), F.count("*").alias("n")).where((F.col("n") == 2) & (F.col("phase_a") < F.col("phase_b"))).drop("n")


def summary(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., points, columns, rows, phases and the ranges of the angles)."""
    ends = [f(a).alias(f"{a}_{n}") for a in ANGLES for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy(*by).agg(F.count("*").alias("points"), F.count_distinct("x").alias("columns"), F.count_distinct("y").alias("rows"), F.count_distinct("phase").alias("phases"), *ends)


def centroids(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return grained.groupBy(*by, "grain_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("points"))
