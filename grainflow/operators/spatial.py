"""Joins by place: nearest neighbours, points in triangles and polygons. All are equi-joins on buckets of the plane."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from grainflow.operators.components import checkpointed

TOLERANCE = 1e-10


def _bucket(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


#: Cells along a side of a tile of `nearest`, and the queries or points that a tile may hold.
TILE, CROWD = 64, 500_000


def _near_in_tiles(k: int, cell: float, exclude_self: bool, shape: pa.Schema):
    """The k nearest points within `cell` of each query of a tile, from sorted buckets; queries that have fewer come out with rank 0."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (qid, qx, qy), (pid, px, py) = ([t.column(c).to_numpy() for c in (n, "x", "y")] for t, n in ((left, "query_id"), (right, "point_id")))
        if not len(qid):
            return shape.empty_table()
        bucket = lambda v: np.floor(v / cell).astype(np.int64)
        bx, by, cx, cy = bucket(px), bucket(py), bucket(qx), bucket(qy)
        every = np.concatenate([by, cy])
        low, tall = every.min(), np.ptp(every) + 3
        code = bx * tall + by - low + 1
        order = np.argsort(code, kind="stable")
        code, pid, px, py = code[order], pid[order], px[order], py[order]
        # The three buckets of a column stand together.
        own = (cx[:, None] + np.arange(-1, 2)) * tall + (cy - low + 1)[:, None]
        start, stop = np.searchsorted(code, own - 1, "left"), np.searchsorted(code, own + 1, "right")
        size = stop - start
        total = np.cumsum(size.sum(1))
        out, at = [], 0
        while at < len(qid):  # some two million pairs at once
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 2_000_000, "right")))
            n, first = size[at:end].ravel(), start[at:end].ravel()
            q = np.repeat(np.arange(at, end), size[at:end].sum(1))
            p = np.arange(len(q)) + np.repeat(first - (np.cumsum(n) - n), n)
            d2 = (qx[q] - px[p]) * (qx[q] - px[p]) + (qy[q] - py[p]) * (qy[q] - py[p])
            good = d2 <= cell * cell
            if exclude_self:
                good &= qid[q] != pid[p]
            q, p, d2 = q[good], p[good], d2[good]
            order = np.lexsort((pid[p], d2, q))
            q, p, d2 = q[order], p[order], d2[order]
            found = np.bincount(q - at, minlength=end - at)
            rank = np.arange(len(q)) - np.repeat(np.cumsum(found) - found, found) + 1
            good = (rank <= k) & (found >= k)[q - at]
            rest = np.flatnonzero(found < k) + at
            q, p, d2, rank = q[good], p[good], d2[good], rank[good]
            both, none = np.concatenate([q, rest]), np.arange(len(q) + len(rest)) >= len(q)
            pad = lambda v: pa.array(np.concatenate([v, np.zeros(len(rest), v.dtype)]), mask=none)  # noqa: E731, B023
            out.append(pa.table({"query_id": qid[both], "rank": np.concatenate([rank, np.zeros(len(rest), np.int64)]), "point_id": pad(pid[p]), "distance2": pad(d2), "x": qx[both], "y": qy[both]}).cast(shape))
            at = end
        return pa.concat_tables(out)

    return run


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, cell: float = 1.0, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, point_id, distance2): the k nearest points of each query, or all if fewer; ties go to the smaller id.

    Both sides are (query_id or point_id, x, y) with numbers for ids. A query looks at its own bucket of side `cell` and the eight around
    it; it is settled if it finds k points within `cell`. At first these stand together in tiles, so that a query is sent once. The others, and those of crowded tiles, go on by
    a join, with buckets twice as wide each time, so that few queries meet many points. Rounds grow with the logarithm of the map's width.
    """
    ends = queries.select("x", "y").unionByName(points.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    span = max(ends[0] or 0.0, ends[1] or 0.0)
    best = Window.partitionBy("query_id").orderBy("distance2", "point_id")
    open_, done = queries.select("query_id", "x", "y"), []
    if cell <= span:
        side = cell * TILE
        where_ = [F.col(c).cast("double").alias(c) for c in "xy"]
        around = lambda c: F.explode(F.sequence(_bucket(F.col(c) - cell * 1.001, side), _bucket(F.col(c) + cell * 1.001, side)))
        asked = open_.where("x is not null and y is not null").select(_bucket(F.col("x"), side).alias("u"), _bucket(F.col("y"), side).alias("v"), "query_id", *where_)
        held = points.select("point_id", *where_).withColumn("u", around("x")).withColumn("v", around("y"))
        crowd = [checkpointed(t.groupBy("u", "v").count().where(F.col("count") > CROWD).select("u", "v")) for t in (asked, held)]
        late = None
        if not (crowd[0].isEmpty() and crowd[1].isEmpty()):
            full = F.broadcast(crowd[0].unionByName(crowd[1]).distinct())  # a row for CROWD rows at least
            late = asked.join(full, ["u", "v"], "left_semi").select("query_id", "x", "y")
            asked, held = (t.join(full, ["u", "v"], "left_anti") for t in (asked, held))
        kinds = StructType([queries.schema["query_id"], StructField("rank", IntegerType()), points.schema["point_id"], *(StructField(c, DoubleType()) for c in ("distance2", "x", "y"))])
        kinds = StructType([StructField(f.name, f.dataType) for f in kinds])
        near = asked.groupBy("u", "v").cogroup(held.groupBy("u", "v")).applyInArrow(_near_in_tiles(k, cell, exclude_self, to_arrow_schema(kinds)), kinds)
        near = checkpointed(near)
        done.append(near.where("rank > 0").select("query_id", "rank", "point_id", "distance2"))
        open_ = near.where("rank = 0").select("query_id", "x", "y")
        if late is None:
            cell *= 2
        else:
            open_ = open_.unionByName(late)
        open_ = checkpointed(open_)
    while not done or not open_.isEmpty():
        around = lambda c: F.explode(F.sequence(_bucket(F.col(c), cell) - 1, _bucket(F.col(c), cell) + 1))  # noqa: E731,B023
        placed = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"), _bucket(F.col("x"), cell).alias("bx"), _bucket(F.col("y"), cell).alias("by"))
        near = open_.withColumn("bx", around("x")).withColumn("by", around("y")).join(placed, ["bx", "by"])
        near = near.where(F.col("query_id") != F.col("point_id")) if exclude_self else near
        d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
        ranked = near.select("query_id", "point_id", d2.alias("distance2")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked = checkpointed(ranked)
        if cell > span:  # the nine buckets hold every point
            done.append(ranked)
            break
        settled = ranked.where(F.col("distance2") <= cell * cell).groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        done.append(ranked.join(settled, "query_id", "left_semi"))
        open_ = checkpointed(open_.join(settled, "query_id", "left_anti"))
        cell *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "point_id", "distance2")


def points_in_triangles(points: DataFrame, triangles: DataFrame, cell: float = 1.0, tolerance: float = 1e-8) -> DataFrame:
    """(point_id, elem_id): the first triangle (elem_id, x1, y1, ..., x3, y3) that holds each point, by barycentric coordinates; points in none are left out."""
    xs, ys = [F.col(f"x{i}") for i in (1, 2, 3)], [F.col(f"y{i}") for i in (1, 2, 3)]
    boxed = triangles.select("elem_id", *xs, *ys, F.least(*xs).alias("x0_"), F.greatest(*xs).alias("x1_"), F.least(*ys).alias("y0_"), F.greatest(*ys).alias("y1_"))
    span = lambda a, b: F.explode(F.sequence(_bucket(F.col(a) - tolerance, cell), _bucket(F.col(b) + tolerance, cell)))
    cells = boxed.withColumn("bx", span("x0_", "x1_")).withColumn("by", span("y0_", "y1_")).drop("x0_", "x1_", "y0_", "y1_")
    placed = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"), _bucket(F.col("x"), cell).alias("bx"), _bucket(F.col("y"), cell).alias("by"))
    twice = (xs[1] - xs[0]) * (ys[2] - ys[0]) - (xs[2] - xs[0]) * (ys[1] - ys[0])
    px, py = F.col("px"), F.col("py")
    b = ((px - xs[0]) * (ys[2] - ys[0]) - (xs[2] - xs[0]) * (py - ys[0])) / twice
    c = ((xs[1] - xs[0]) * (py - ys[0]) - (px - xs[0]) * (ys[1] - ys[0])) / twice
    inside = (b >= -tolerance) & (c >= -tolerance) & (1 - b - c >= -tolerance)
    return placed.join(cells, ["bx", "by"]).where((twice != 0) & inside).groupBy("point_id").agg(F.min("elem_id").alias("elem_id"))


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / length, F.lit(0.0)), F.lit(1.0)))
    qx, qy = px - (ax + t * dx), py - (ay + t * dy)
    return qx * qx + qy * qy


def ring_edges(vertices: DataFrame, key: str) -> DataFrame:
    """(key, seq, ax, ay, bx, by): the edges of closed rings (key, seq, x, y); the last vertex joins the first."""
    w = Window.partitionBy(key).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return vertices.select(key, "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x").alias("bx"), nxt("y").alias("by"))


def points_in_polygons(points: DataFrame, vertices: DataFrame, key: str, cell: float = 1.0, tolerance: float = TOLERANCE) -> DataFrame:
    """(point_id, key) for every polygon that a point lies in or, within `tolerance`, on: an odd number of edges crosses the ray to the right. A point meets, of its strip
    of the height `cell`, the edges of those polygons alone that pass both its sides there or its square, whatever the number of polygons and the width of the map.
    """
    edges = ring_edges(vertices, key)
    px, py, ax, ay, bx, by = (F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by"))
    strip = lambda low, high: F.explode(F.sequence(_bucket(low - tolerance, cell), _bucket(high + tolerance, cell)))
    strips = checkpointed(edges.withColumn("strip", strip(F.least(ay, by), F.greatest(ay, by))))
    # An edge matters from the square where its polygon begins in the strip up to its own right end.
    begin = strips.groupBy(key, "strip").agg(F.min(F.least(ax, bx)).alias("__x"))
    squares = F.explode(F.sequence(_bucket(F.col("__x") - tolerance, cell), _bucket(F.greatest(ax, bx) + tolerance, cell)))
    placed = points.select("point_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).withColumns({"strip": _bucket(py, cell), "square": _bucket(px, cell)})
    met = placed.join(strips.join(begin, [key, "strip"]).withColumn("square", squares).drop("__x"), ["strip", "square"]).where(F.greatest(ax, bx) >= px - tolerance)
    crosses = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.when(by == ay, 1.0).otherwise(by - ay) + ax)
    on = segment_distance2(px, py, ax, ay, bx, by) <= tolerance * tolerance
    tested = met.where(crosses | on).groupBy("point_id", key).agg(F.sum(crosses.cast("int")).alias("n"), F.bool_or(on).alias("on"))
    return tested.where((F.col("n") % 2 == 1) | F.col("on")).select("point_id", key)


def near_edges(points: DataFrame, edges: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """(point_id, px, py, key, ax, ay, bx, by): for each point and key the edges (key, ax, ay, bx, by) that may be the nearest to the point, by squares that halve.

    A square of points keeps of a key the edges that may be nearer to one of its points than the edge that is nearest to all of them; a quarter of it starts from
    these. So a small square keeps the edges about the nearest place alone, and a point meets a few edges of each key, however many there are. Squares end at
    the side `cell`.
    """
    px, py, ax, ay, bx, by = (F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by"))
    placed = points.select("point_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    ends = placed.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if ends[0] is None:
        return placed.join(edges, F.lit(False)).select("point_id", "px", "py", key, "ax", "ay", "bx", "by")
    span, side = max(ends[1] - ends[0], ends[3] - ends[2]), cell
    levels = 0
    while side < span:
        side, levels = side * 4, levels + 1
    held = edges.select(key, "ax", "ay", "bx", "by").withColumn("__edge", F.monotonically_increasing_id())
    named = checkpointed(held)
    open_ = named.withColumns({"sx": F.lit(0).cast("long"), "sy": F.lit(0).cast("long")})
    square = lambda c, low, side: F.floor((F.col(c) - low) / side).cast("long")
    for level in range(levels):
        side /= 4
        full = placed.select(square("px", ends[0], side).alias("sx"), square("py", ends[2], side).alias("sy")).distinct()
        child = full.withColumns({"ux": F.floor(F.col("sx") / 4) if level else F.lit(0).cast("long"), "uy": F.floor(F.col("sy") / 4) if level else F.lit(0).cast("long")})
        met = open_.withColumnsRenamed({"sx": "ux", "sy": "uy"}).join(child, ["ux", "uy"])
        cx, cy = ends[0] + (F.col("sx") + 0.5) * side, ends[2] + (F.col("sy") + 0.5) * side
        # Distances from the centre are off by the half diagonal at most.
        met = checkpointed(met.withColumn("__d", F.sqrt(segment_distance2(cx, cy, ax, ay, bx, by))).drop("ux", "uy"))
        best = met.groupBy("sx", "sy", key).agg(F.min("__d").alias("__best"))
        open_ = met.join(best, ["sx", "sy", key]).where(F.col("__d") <= F.col("__best") + side * 1.4142136 * (1 + 1e-9) + 1e-9 * F.col("__best")).drop("__d", "__best")
    own = placed.withColumns({"sx": square("px", ends[0], side), "sy": square("py", ends[2], side)}) if levels else placed.withColumns({"sx": F.lit(0).cast("long"), "sy": F.lit(0).cast("long")})
    return own.join(open_, ["sx", "sy"]).select("point_id", "px", "py", key, "ax", "ay", "bx", "by")


def signed_distance(points: DataFrame, vertices: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """(point_id, key, distance): distance to every ring, negative inside. A row for each point and ring comes out, so it is for few rings.

    The nearest edge comes from `near_edges`, the side from the edges that a ray to the right crosses, which are looked for in the point's own strip of the height `cell` alone.
    """
    edges = checkpointed(ring_edges(vertices, key))
    px, py, ax, ay, bx, by = (F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by"))
    far = near_edges(points, edges, key, cell).groupBy("point_id", key).agg(F.sqrt(F.min(segment_distance2(px, py, ax, ay, bx, by))).alias("d"))
    strips = edges.where(ay != by).withColumn("strip", F.explode(F.sequence(_bucket(F.least(ay, by), cell), _bucket(F.greatest(ay, by), cell))))
    placed = points.select("point_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).withColumn("strip", _bucket(py, cell))
    met = placed.join(strips, "strip").where(((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.when(by == ay, 1.0).otherwise(by - ay) + ax))
    inside = met.groupBy("point_id", key).agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select("point_id", key, F.lit(True).alias("inside"))
    return far.join(inside, ["point_id", key], "left").select("point_id", key, F.when(F.col("inside"), -F.col("d")).otherwise(F.col("d")).alias("distance"))


def _exact_side(px, py, qx, qy, rx, ry) -> int:
    """On which side of the line from p to q the point r lies, in exact arithmetic: 1 left, -1 right, 0 on it."""
    a = (Fraction(qx) - Fraction(px)) * (Fraction(ry) - Fraction(py))
    b = (Fraction(qy) - Fraction(py)) * (Fraction(rx) - Fraction(px))
    return (a > b) - (a < b)


@F.pandas_udf(IntegerType())
def _exact_sides(px: pd.Series, py: pd.Series, qx: pd.Series, qy: pd.Series, rx: pd.Series, ry: pd.Series) -> pd.Series:
    return pd.Series([_exact_side(*v) for v in zip(px, py, qx, qy, rx, ry, strict=True)], dtype="int32")


def crossings(segments: DataFrame, cell: float) -> DataFrame:
    """(a1, b1, a2, b2): pairs of segments (a, b, ax, ay, bx, by), named by their ends, that cross or touch without sharing an end; the smaller pair of ends first.

    A segment stands in every bucket of side `cell` that it passes, strip by strip, and meets the others there, so that the pairs grow with the segments, if `cell` is about as long as
    they are. The side of an end is decided in doubles where rounding can't change it, else in exact arithmetic. Of segments on one line, those count that share more
    than nothing; a segment of no length counts as its point. Segments that have the same ends are one.
    """
    once = segments.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(F.when(F.col("a") <= F.col("b"), F.col(p)).otherwise(F.col(q)).cast("double").alias(p) for p, q in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))))
    once = checkpointed(once.dropDuplicates(["a", "b"]))
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    row = once.withColumn("j", F.explode(F.sequence(_bucket(F.least(ay, by), cell), _bucket(F.greatest(ay, by), cell))))
    # Where the segment is inside the strip, a little widened against rounding.
    low, high = F.greatest(F.least(ay, by), F.col("j") * cell), F.least(F.greatest(ay, by), (F.col("j") + 1) * cell)
    at = lambda y: F.when(by == ay, ax).otherwise(ax + (bx - ax) * F.least(F.greatest((y - ay) / F.when(by == ay, 1.0).otherwise(by - ay), F.lit(0.0)), F.lit(1.0)))
    x0, x1 = F.when(by == ay, F.least(ax, bx)).otherwise(F.least(at(low), at(high))), F.when(by == ay, F.greatest(ax, bx)).otherwise(F.greatest(at(low), at(high)))
    pad = 1e-9 * (F.abs(ax) + F.abs(bx) + cell)
    placed = row.withColumn("i", F.explode(F.sequence(_bucket(x0 - pad, cell), _bucket(x1 + pad, cell))))
    left = placed.select("i", "j", *(F.col(c).alias(f"{c}1") for c in ("a", "b", "ax", "ay", "bx", "by")))
    right = placed.select("i", "j", *(F.col(c).alias(f"{c}2") for c in ("a", "b", "ax", "ay", "bx", "by")))
    pairs = left.join(right, ["i", "j"]).where((F.struct("a1", "b1") < F.struct("a2", "b2")) & (F.col("a1") != F.col("a2")) & (F.col("a1") != F.col("b2")) & (F.col("b1") != F.col("a2")) & (F.col("b1") != F.col("b2")))
    c = {f"{n}{k}": F.col(f"{n}{k}") for n in ("ax", "ay", "bx", "by") for k in (1, 2)}
    boxes = (F.greatest(F.least(c["ax1"], c["bx1"]), F.least(c["ax2"], c["bx2"])) <= F.least(F.greatest(c["ax1"], c["bx1"]), F.greatest(c["ax2"], c["bx2"]))) & (F.greatest(F.least(c["ay1"], c["by1"]), F.least(c["ay2"], c["by2"])) <= F.least(F.greatest(c["ay1"], c["by1"]), F.greatest(c["ay2"], c["by2"])))
    pairs = pairs.where(boxes).drop("i", "j").distinct()

    def side(k: int, m: int, end: str) -> tuple[tuple[Column, ...], Column, Column]:
        p = tuple(c[n] for n in (f"ax{k}", f"ay{k}", f"bx{k}", f"by{k}", f"{end}x{m}", f"{end}y{m}"))
        a, b = (p[2] - p[0]) * (p[5] - p[1]), (p[3] - p[1]) * (p[4] - p[0])
        return p, F.signum(a - b).cast("int"), F.abs(a - b) > 2.0**-50 * (F.abs(a) + F.abs(b))

    names = {"s1": side(1, 2, "a"), "s2": side(1, 2, "b"), "s3": side(2, 1, "a"), "s4": side(2, 1, "b")}
    told = pairs.select("*", *(s.alias(n) for n, (_, s, _) in names.items()), reduce(lambda x, y: x & y, (sure for _, _, sure in names.values())).alias("sure"))
    # Only what rounding leaves open goes to exact arithmetic.
    open_ = told.where(~F.col("sure")).select(*pairs.columns, *(_exact_sides(*p).alias(n) for n, (p, _, _) in names.items()))
    both = told.where("sure").drop("sure").unionByName(open_)
    return both.where("s1 * s2 <= 0 AND s3 * s4 <= 0").select("a1", "b1", "a2", "b2")


def rectangle_distance(x: Column, y: Column, x1: float, x2: float, y1: float, y2: float) -> Column:
    """Signed distance to a rectangle's sides, negative inside."""
    return -F.least(x - x1, x2 - x, y - y1, y2 - y)


def difference_distance(a: Column, b: Column) -> Column:
    """Signed distance of one region without another."""
    return F.greatest(a, -b)
