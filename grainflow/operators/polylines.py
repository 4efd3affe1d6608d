"""Boundaries of grains as ordered lines, shared by the grains on both sides, without a task for each grain.

The corners of pixels have whole coordinates from 0. A boundary edge is directed, with a grain on its left, and has a number that says where it begins and which way it goes, so that the edge after it is found
by equality of places. Chains are put in order by list ranking: every edge looks up the edge that it points to and
takes over what that one points to, so that the rounds grow with the logarithm of the longest chain. The edges of a grain with a bounded number of them
are ranked where they stand together, many grains in a task; only longer ones take part in rounds between tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.operators import geometry
from grainflow.operators.components import checkpointed

#: Places of corners, x and y, in one number.
WIDE = 1 << 31
#: What a step east, north, west, south adds to a corner's number.
STEPS = (WIDE, 1, -WIDE, -1)
#: The sides of a pixel, counter-clockwise: the edge's own place and whether it stands upright, its start from the pixel's corner, its direction.
SIDES = ((0, 0, False, 0, 0, 0), (1, 0, True, 1, 0, 1), (0, 1, False, 1, 1, 2), (0, 0, True, 0, 1, 3))


#: Edges of a grain that are ranked within a task, at most, and about how many a task has in all.
WITHIN, PART = 500_000, 500_000


def _corner(at: Column) -> Column:
    return F.floor(at / 4).cast("long")


def _target(at: Column) -> Column:
    way = (at % 4).cast("int")
    return _corner(at) + F.when(way == 0, STEPS[0]).when(way == 1, STEPS[1]).when(way == 2, STEPS[2]).otherwise(STEPS[3])


def _bit(way: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), way.cast("int"))


def _place(corner: Column) -> list[Column]:
    return [F.floor(corner / WIDE).cast("long").alias("x"), (corner % WIDE).cast("long").alias("y")]


def sides(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., at, left, right): the boundary edges of every grain, which is on the left; right is null at the map's outline."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    each = F.array(*(F.struct((x + dx).alias("ex"), (y + dy).alias("ey"), F.lit(v).alias("up"), (((x + sx) * WIDE + y + sy) * 4 + d).alias("at")) for dx, dy, v, sx, sy, d in SIDES))
    met = grained.select(*by, "grain_id", F.explode(each).alias("e")).groupBy(*by, "e.ex", "e.ey", "e.up")
    end = F.struct(F.col("grain_id"), F.col("e.at"))
    met = met.agg(F.count("*").alias("n"), F.min(end).alias("a"), F.max(end).alias("b")).where((F.col("n") == 1) | (F.col("a.grain_id") != F.col("b.grain_id")))
    one = lambda a, b: F.struct(F.col(f"{a}.at").alias("at"), F.col(f"{a}.grain_id").alias("left"), F.when(F.col("n") == 2, F.col(f"{b}.grain_id")).alias("right"))
    both = F.when(F.col("n") == 2, F.array(one("a", "b"), one("b", "a"))).otherwise(F.array(one("a", "b")))
    return met.select(*by, F.explode(both).alias("e")).select(*by, "e.at", "e.left", "e.right")


def ranked(darts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., at, last, left, closed) of darts (by..., at, nxt): the last dart of the chain, and how many follow until there.

    nxt is the dart after this one, null at the end of a chain; no two darts have the same one after them. A chain that returns to itself is broken
    before its least dart.
    """
    first = checkpointed(darts.select(*by, "at", "nxt"))
    done = first.where("nxt IS NULL").select(*by, "at", F.col("at").alias("last"), F.lit(0).cast("long").alias("left"))
    # Where a dart points to, how far that is, and the least dart on the way.
    open_ = first.where("nxt IS NOT NULL").select(*by, "at", "nxt", F.lit(1).cast("long").alias("hops"), F.col("at").alias("low"))
    seen = None
    while True:
        state = open_.agg(F.count("*"), F.sum(F.xxhash64(*by, "at", "low").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        there = open_.select(*by, F.col("at").alias("nxt"), F.col("nxt").alias("then"), F.col("hops").alias("more"), F.col("low").alias("other"), F.lit(None).cast("long").alias("last"))
        there = there.unionByName(done.select(*by, F.col("at").alias("nxt"), F.lit(None).cast("long").alias("then"), F.col("left").alias("more"), F.lit(None).cast("long").alias("other"), "last"))
        met = open_.join(there, [*by, "nxt"])
        met = checkpointed(met.select(*by, "at", F.col("then").alias("nxt"), (F.col("hops") + F.col("more")).alias("hops"), F.least("low", "other").alias("low"), "last"))
        done = done.unionByName(met.where("last IS NOT NULL").select(*by, "at", "last", F.col("hops").alias("left")))
        open_ = met.where("last IS NULL").drop("last")
    done = done.withColumn("closed", F.lit(False))
    if state[0] == 0:
        return done
    # What is left runs in circles, and a full round has shown nothing lower: cut before the least.
    cut = open_.select(*by, "at", "low").join(first, [*by, "at"]).select(*by, "at", F.when(F.col("nxt") != F.col("low"), F.col("nxt")).alias("nxt"))
    return done.unionByName(ranked(cut, by).withColumn("closed", F.lit(True)))


def _ranks(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the last of its chain, how many follow until there, whether the chain was a circle) of each place, given the place after it, or its own where a chain ends."""
    n = len(at)
    hops, low, p = (to != np.arange(n)).astype(np.int64), at.copy(), to.copy()
    ended = None
    while True:
        done = to[p] == p
        state = int(done.sum())
        low2 = np.minimum(low, low[p])
        if state == n or (state == ended and (low2 == low).all()):
            break
        hops, p, low, ended = hops + hops[p], p[p], low2, state
    round_ = ~done
    if round_.any():  # what runs in circles is cut before its least dart
        cut = np.flatnonzero(round_ & (at[to] == low))
        opened = to.copy()
        opened[cut] = cut
        some = np.flatnonzero(round_)
        small = np.full(n, -1)
        small[some] = np.arange(len(some))
        last, left, _ = _ranks(at[some], small[opened[some]])
        p[some], hops[some] = some[last], left
    return p, hops, round_


def _ring_next(at: np.ndarray, own: np.ndarray, turns: tuple[int, ...]) -> np.ndarray:
    """The place of the dart of the same grain (`own`) after each of the darts `at`, which are sorted: the first of the `turns` that is there."""
    way = at % 4
    target = at // 4 + np.array(STEPS)[way]
    to = np.full(len(at), -1)
    for k in turns:
        there = target * 4 + (way + k) % 4
        i = np.minimum(np.searchsorted(at, there), len(at) - 1)
        to = np.where((to < 0) & (at[i] == there) & (own[i] == own), i, to)
    return to


def _near_chains(size: int, link: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (`size` columns of maps, the key, at, nxt, part) of whole keys, with the first and last dart of the chain, its number of darts, the dart's place, the sum of the parts, and whether it was a circle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
        if rows is None or not len(rows):
            return
        maps = np.zeros(len(rows), np.int64)
        for c in range(size):
            code = rows.column(c).combine_chunks().dictionary_encode()
            code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
            maps = np.unique(maps * (len(code.dictionary) + 1) + code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        read = lambda name: rows.column(name).to_numpy()
        order = np.lexsort((read("at"), maps))
        for mine in np.split(order, np.flatnonzero(np.diff(maps[order])) + 1):
            at = read("at")[mine]
            if link:
                to = link(at, read("key")[mine])
            else:
                nxt = rows.column("nxt").take(pa.array(mine)).fill_null(-1).to_numpy()
                to = np.where(nxt < 0, np.arange(len(at)), np.searchsorted(at, nxt))
            last, left, closed = _ranks(at, to)
            inner = np.lexsort((-left, last))
            head = np.flatnonzero(np.diff(last[inner], prepend=-1))
            count = np.diff(np.append(head, len(at)))
            spread = lambda v: np.repeat(v, count)  # noqa: E731, B023
            total = np.add.reduceat(read("part")[mine][inner], head)
            n = spread(left[inner][head])
            out = rows.take(pa.array(mine[inner])).combine_chunks().to_batches()[0]
            nxt = pa.array(at[to[inner]], pa.int64(), mask=to[inner] == inner)
            columns = [*out.columns[: size + 2], nxt, pa.array(at[spread(inner[head])]), pa.array(at[last[inner]]), pa.array(n), pa.array(n - left[inner]), pa.array(spread(total)), pa.array(closed[inner])]
            done = pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names[: size + 2], "nxt", "first", "last", "n", "seq", "total", "closed"])
            yield from (done.slice(i, 50_000) for i in range(0, len(at), 50_000))

    return run


def chained(darts: DataFrame, by: tuple[str, ...] = (), link: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, later: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(by..., key, at, nxt, first, last, n, seq, total, closed) of darts (by..., key, at, nxt, part), whole numbers all: each dart with the first and last
    of its chain, how many follow the first, its place from 0, the sum of the parts, and whether the chain returned to itself, as in `ranked`.

    A chain lies within one key, such as a grain. The darts of a key stand together and are ranked there, if there are at most WITHIN of them; the others are ranked in rounds.
    `link` may give the places of the next darts where a task has a key's darts; `later` then adds nxt to darts that are ranked in rounds.
    """
    spark = darts.sparkSession
    size = darts.groupBy(*by, "key").agg(F.count("*").alias("__n"))
    large = checkpointed(size.where(F.col("__n") > WITHIN).select(*by, "key"))
    near = darts if large.isEmpty() else darts.join(large, [*by, "key"], "left_anti")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in darts.select(*by).schema]
    shape = ", ".join([*kinds, *(f"{c} long" for c in ("key", "at", "nxt", "first", "last", "n", "seq", "total")), "closed boolean"])
    parts = max(spark.sparkContext.defaultParallelism, -(-darts.count() // PART))
    out = near.select(*by, "key", "at", "nxt", "part").repartition(parts, *by, "key").mapInArrow(_near_chains(len(by), link), shape)
    if large.isEmpty():
        return out
    far = checkpointed((later or (lambda d: d))(darts.join(large, [*by, "key"], "left_semi")))
    ranks = checkpointed(ranked(far.select(*by, "at", "nxt"), by).join(far, [*by, "at"]))
    whole = ranks.groupBy(*by, "last").agg(F.max("left").alias("n"), F.max_by("at", "left").alias("first"), F.sum("part").alias("total"))
    rows = ranks.join(whole, [*by, "last"]).withColumn("seq", F.col("n") - F.col("left"))
    return out.unionByName(rows.select(*out.columns))


def polylines(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., polyline_id, seq, x, y, grain_a, grain_b): the lines along which two grains meet, each once, from junction to junction.

    grain_a is the smaller of the two; grain_b is null along the map's outline. A line ends where other than two boundary edges meet, which includes a
    corner where two grains touch crosswise, and at the outline's own corners. It runs from the end with the smaller place, x before y; a
    closed line begins and ends at its least corner, and like one that returns to its junction has grain_a on the left. The id is the number of the first edge with grain_a on the left.
    """
    darts = checkpointed(sides(grained, by).where("right IS NULL OR left < right").withColumnsRenamed({"left": "grain_a", "right": "grain_b"}))
    ends = F.explode(F.array(F.struct(_corner(F.col("at")).alias("corner"), F.col("at").alias("out")), F.struct(_target(F.col("at")).alias("corner"), F.lit(None).cast("long").alias("out"))))
    met = darts.select(*by, "at", "grain_b", ends.alias("e")).groupBy(*by, "e.corner")
    met = met.agg(F.count("*").alias("n"), F.bool_or(F.col("grain_b").isNull()).alias("outer"), (F.min(F.col("at") % 2) != F.max(F.col("at") % 2)).alias("turned"), F.min("e.out").alias("out"))
    through = met.where((F.col("n") == 2) & ~(F.col("outer") & F.col("turned"))).select(*by, "corner", "out")
    # Both grains stay the same along a line, so grain_a keeps its edges together.
    linked = darts.withColumn("corner", _target(F.col("at"))).join(through, [*by, "corner"], "left").select(*by, F.col("grain_a").alias("key"), "at", F.col("out").alias("nxt"), F.lit(0).cast("long").alias("part"))
    chains = chained(checkpointed(linked), by)
    rows = chains.withColumnRenamed("first", "polyline_id").join(darts.select(*by, "at", "grain_a", "grain_b"), [*by, "at"])
    back = _target(F.col("last")) < _corner(F.col("polyline_id"))
    point = lambda corner, place: F.struct(corner.alias("corner"), F.when(back, F.col("n") + 1 - place).otherwise(place).alias("seq"))
    own, end = point(_corner(F.col("at")), F.col("seq")), point(_target(F.col("at")), F.col("n") + 1)
    points = F.when(F.col("seq") == F.col("n"), F.array(own, end)).otherwise(F.array(own))
    rows = rows.select(*by, "polyline_id", F.explode(points).alias("p"), "grain_a", "grain_b")
    return rows.select(*by, "polyline_id", "p.seq", *_place(F.col("p.corner")), "grain_a", "grain_b")


def between_phases(lines: DataFrame, grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`lines` with phase_a and phase_b, where the two grains have different phases."""
    phase = grained.groupBy(*by, "grain_id").agg(F.min_by("phase", "point_id").alias("phase"))
    for side in "ab":
        lines = lines.join(phase.select(*by, F.col("grain_id").alias(f"grain_{side}"), F.col("phase").alias(f"phase_{side}")), [*by, f"grain_{side}"])
    return lines.where("phase_a <> phase_b")


def ring_darts(grained: DataFrame, by: tuple[str, ...] = (), joined: bool = False) -> DataFrame:
    """(by..., grain_id, ring_id, seq, at, nxt, area): the rings of `rings` by their edges, with the edge after each. `joined` rings turn right where
    four edges meet, so that pixels that touch at a corner are together, and what they close in is a hole."""
    turns = (3, 0, 1) if joined else (1, 0, 3)
    x, y = _place(_corner(F.col("at")))
    u, v = _place(_target(F.col("at")))
    none = F.lit(None).cast("long")
    darts = checkpointed(sides(grained, by).select(*by, F.col("left").cast("long").alias("key"), "at", none.alias("nxt"), (x * v - u * y).alias("part")))

    def later(far: DataFrame) -> DataFrame:
        out = far.groupBy(*by, "key", _corner(F.col("at")).alias("corner")).agg(F.bit_or(_bit(F.col("at") % 4)).alias("ways"))
        way = F.col("at") % 4
        open_ = lambda w: F.col("ways").bitwiseAND(_bit(w)) != 0
        first, second, third = ((way + k) % 4 for k in turns)
        to = F.when(open_(first), first).when(open_(second), second).otherwise(third)
        return far.drop("nxt").withColumn("corner", _target(F.col("at"))).join(out, [*by, "key", "corner"]).select(*by, "key", "at", (F.col("corner") * 4 + to).alias("nxt"), "part")

    # Every ring is a circle of its grain's darts and begins at the least of them.
    chains = chained(darts, by, lambda at, own: _ring_next(at, own, turns), later)
    return chains.select(*by, F.col("key").alias("grain_id"), F.col("first").alias("ring_id"), "seq", "at", "nxt", (F.col("total") / 2).alias("area"))


def rings(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, ring_id, seq, x, y, area): each grain's boundary as rings of corners with the grain on the left, so that area, the ring's
    signed one, is positive for outer rings and negative for holes. A ring begins at its least corner, and its id is the number of the edge from there.

    Where four edges of a grain meet, a ring turns left and stays with its pixel, so that corners aren't crossed.
    """
    return ring_darts(grained, by).select(*by, "grain_id", "ring_id", "seq", *_place(_corner(F.col("at"))), "area")


def outlines(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, ring, seq, x, y): the rings of each grain by falling signed area: the outer ring is 0 and runs counter-clockwise, holes run clockwise."""
    found = checkpointed(rings(grained, by))
    each = found.where("seq = 0").select(*by, "grain_id", "ring_id", "area")
    order = each.withColumn("ring", F.row_number().over(Window.partitionBy(*by, "grain_id").orderBy(F.desc("area"), "ring_id")) - 1).select(*by, "ring_id", "ring")
    return found.join(order, [*by, "ring_id"]).select(*by, "grain_id", "ring", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def resampled(lines: DataFrame, spacing: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., polyline_id, seq, x, y): points at equal distances along each line, round(length / spacing) of them but two at least. Both grains of a line have the same points."""
    key = F.to_json(F.struct(*by, "polyline_id")) if by else F.col("polyline_id")
    named = lines.select(key.alias("key"), "seq", "x", "y")
    count = geometry.lengths(named, "key").select("key", F.greatest(F.lit(2), F.round(F.col("length") / spacing)).cast("int").alias("count"))
    out = geometry.resample(named.join(count, "key"), "key", "count")
    return out.join(lines.select(*by, "polyline_id", key.alias("key")).distinct(), "key").select(*by, "polyline_id", "seq", "x", "y")


def hole_pixels(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, x, y): every place that a grain encloses without holding it, be it of one grain or of several, nested or not; with
    them a grain is filled. Rows of a hole are filled between each two of the upright edges around it.
    """
    upright = ring_darts(grained, by, joined=True).where((F.col("area") < 0) & (F.col("at") % 2 == 1))
    x, y = _place(_corner(F.col("at")))
    rows = upright.select(*by, "grain_id", "ring_id", x, (y - F.when(F.col("at") % 4 == 3, 1).otherwise(0)).alias("y"))
    line = Window.partitionBy(*by, "ring_id", "y").orderBy("x")  # as wide as the map at most
    pairs = rows.withColumn("k", F.row_number().over(line)).withColumn("to", F.lead("x").over(line)).where(F.col("k") % 2 == 1)
    return pairs.select(*by, "grain_id", F.explode(F.sequence(F.col("x"), F.col("to") - 1)).alias("x"), "y")


def nesting(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, parent_id): grains that lie wholly in holes of others, with the one whose filled area is the smallest, the
    smaller id of equals: a forest, as what encloses the parent encloses the grain."""
    inside = checkpointed(hole_pixels(grained, by).withColumnRenamed("grain_id", "parent_id"))
    sizes = grained.groupBy(*by, "grain_id").agg(F.count("*").alias("size"))
    filled = sizes.join(inside.groupBy(*by, F.col("parent_id").alias("grain_id")).agg(F.count("*").alias("holes")), [*by, "grain_id"]).select(*by, F.col("grain_id").alias("parent_id"), (F.col("size") + F.col("holes")).alias("filled"))
    met = grained.select(*by, "grain_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).join(inside, [*by, "x", "y"]).groupBy(*by, "grain_id", "parent_id").agg(F.count("*").alias("n"))
    whole = met.join(sizes, [*by, "grain_id"]).where("n = size").join(filled, [*by, "parent_id"])
    return whole.groupBy(*by, "grain_id").agg(F.min_by("parent_id", F.struct("filled", "parent_id")).alias("parent_id"))


def hole_junctions(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., x, y): corners that the outer rings of hole grains pass more than once, and without which these rings would together enclose another area.

    Without a corner a ring's area changes by half its turn there, one way to the left and the other way to the right; so the turns must not cancel.
    """
    holes = nesting(grained, by).select(*by, "grain_id")
    darts = ring_darts(grained, by).where("area > 0").join(holes, [*by, "grain_id"], "left_semi")
    turn = F.pmod(F.col("nxt") % 4 - F.col("at") % 4, F.lit(4))
    bend = F.when(turn == 1, 1).when(turn == 3, -1).otherwise(0)
    met = darts.groupBy(*by, _corner(F.col("nxt")).alias("corner")).agg(F.count("*").alias("n"), F.sum(bend).alias("bend"))
    return met.where("n > 1 AND bend <> 0").select(*by, *_place(F.col("corner")))


def clearances(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`grained` with `clearance`: how many erosions, each of which takes off the points with one of four neighbours outside the grain, a point lasts until it goes with the last of them.

    That is one more than the city-block distance to the nearest point on a boundary, which the rows and then the columns give, each by running minima.
    """
    at = F.col("at")
    x, y = _place(_corner(at))
    dx, dy = F.when((at % 4).isin(1, 2), 1).otherwise(0), F.when((at % 4).isin(2, 3), 1).otherwise(0)
    edge = sides(grained, by).select(*by, (x - dx).alias("x"), (y - dy).alias("y")).distinct().withColumn("__edge", F.lit(True))
    rows = grained.withColumns({"x": F.col("x").cast("long"), "y": F.col("y").cast("long")}).join(edge, [*by, "x", "y"], "left")
    along = lambda c, other: Window.partitionBy(*by, other).orderBy(c)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    after = lambda w: w.rowsBetween(0, Window.unboundedFollowing)
    seed = F.when(F.col("__edge"), F.col("x"))
    w = along("x", "y")
    rows = rows.withColumn("__f", F.least(F.col("x") - F.last(seed, True).over(before(w)), F.first(seed, True).over(after(w)) - F.col("x")))
    w = along("y", "x")
    up, down = F.min(F.col("__f") - F.col("y")).over(before(w)) + F.col("y"), F.min(F.col("__f") + F.col("y")).over(after(w)) - F.col("y")
    return rows.withColumn("clearance", F.least(up, down) + 1).select(*grained.columns, "clearance")


def label_points(grained: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., grain_id, x, y, clearance): the point of each grain with the greatest clearance, where a label keeps away from every boundary; of
    several the one that is nearest to the centroid, then the smaller id."""
    middle = grained.groupBy(*by, "grain_id").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    dx, dy = F.col("n") * F.col("x") - F.col("sx"), F.col("n") * F.col("y") - F.col("sy")  # whole numbers: ties are exact
    both = clearances(grained, by).join(middle, [*by, "grain_id"])
    best = both.groupBy(*by, "grain_id").agg(F.min_by(F.struct("x", "y", "clearance"), F.struct(-F.col("clearance"), (dx * dx + dy * dy).alias("d"), "point_id")).alias("p"))
    return best.select(*by, "grain_id", "p.x", "p.y", "p.clearance")
