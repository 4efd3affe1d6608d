"""Meshes that follow grain boundaries: a pixel mesh whose boundaries are smoothed, and the size fields that grade meshes.

Every element of the pixel mesh lies in one grain, and stays there: nodes move, triangles do not. Junctions of three
grains and the corners of the map stand still, boundary nodes move along with their neighbours on the boundary, inner nodes with all
of theirs, and nodes on the map's sides do not move, which keeps the mesh periodic. A map is smoothed in tiles side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.operators import geometry, grains
from grainflow.operators.components import checkpointed


def _areas(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    a, b, c = t.T
    return (x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])


def _quality(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    d = [np.hypot(x[t[:, i]] - x[t[:, j]], y[t[:, i]] - y[t[:, j]]) for i, j in ((0, 1), (1, 2), (0, 2))]
    a, b, c = d
    return (b + c - a) * (c + a - b) * (a + b - c) / (a * b * c)


def smooth(x: np.ndarray, y: np.ndarray, t: np.ndarray, grain: np.ndarray, rounds: int, step: float, floor: float, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """(x, y, undone, reach): new places of the nodes. A node's move is undone in a round in which it would leave one of its elements with an area
    under `floor`; `undone` is how often, of each round, moves were taken back together.

    Where a mesh was cut out of a larger one at the nodes `cut`, a node is right for `reach` steps, each a move or an undoing, as mistakes
    go from the cut through one row of elements a step, and through nodes that stand still not at all.
    """
    n = len(x)
    sides = np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [0, 2]]])
    sides.sort(axis=1)
    owner = np.tile(grain, 3)
    key, inverse, count = np.unique(sides[:, 0] * n + sides[:, 1], return_inverse=True, return_counts=True)
    edges = np.stack(np.divmod(key, n), 1)
    first, owner = np.cumsum(count) - count, owner[np.argsort(inverse.ravel(), kind="stable")]
    low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    outer, between = count == 1, (count == 2) & (low != high)
    on_side = np.zeros(n, bool)
    on_side[edges[outer].ravel()] = True
    degree = np.bincount(edges[between].ravel(), minlength=n)
    boundary = degree > 0
    fixed = on_side | (boundary & (degree != 2))
    links = np.concatenate([edges[between], edges[~between & ~outer]])
    along = np.arange(len(links)) < between.sum()
    a, b = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
    use = np.concatenate([along, along]) | ~boundary[a]  # boundary nodes look along the boundary alone
    a, b = a[use], b[use]
    around = np.bincount(a, minlength=n)
    fixed |= around == 0  # nodes of no element
    around = np.maximum(around, 1)
    reach = np.where(cut, 0, FAR)
    front, far = cut, 0
    while front.any():
        far += 1
        met = np.zeros(n, bool)
        met[t[front[t].any(1)].ravel()] = True
        front = met & ~fixed & (reach == FAR)
        reach[front] = far
    x, y, undone = x.copy(), y.copy(), []
    for _ in range(rounds):
        nx = np.where(fixed, x, x + step * (np.bincount(a, x[b], n) / around - x))
        ny = np.where(fixed, y, y + step * (np.bincount(a, y[b], n) / around - y))
        undone.append(0)
        while (bad := _areas(nx, ny, t) < floor).any():
            back = np.zeros(n, bool)
            back[t[bad].ravel()] = True
            if not ((nx != x) | (ny != y))[back].any():
                break
            nx, ny = np.where(back, x, nx), np.where(back, y, ny)
            undone[-1] += 1
        x, y = nx, ny
    return x, y, undone, reach


#: Pixels along a side of a tile of `conforming_pixels`, and around it.
TILE, HALO = 384, 40
#: The reach of nodes that no cut affects.
FAR = np.iinfo(np.int32).max
#: A pixel's place, the right, upper right and upper corner beside it.
_CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))


def conforming_pixels(spark: SparkSession, grained: DataFrame, width: int, height: int, rounds: int = 30, step: float = 0.5, least: float = 0.2, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """(x, y, grain_id, x0, y0, ..., x3, y3): the places of each pixel's corners, from its own one round to the left, on a map on the unit grid
    0 ... width - 1, 0 ... height - 1, after smoothing. A node that is no pixel's own one, as on the far sides, has a row without grain, with x0, y0.

    A tile's rounds are one task's work, over its pixels and some around it. Rounds count if no tile's own nodes can have heard of the
    cut around it in so many steps; else fewer rounds are taken at once, each time from where the tiles stand, and at last more pixels around.
    """
    across, down = -(-width // tile), -(-height // tile)
    floor = least  # of the mean of `_areas`, which are all 1 before smoothing

    def go(halo: int, rounds: int):
        def run(table: pa.Table) -> pa.Table:
            at = table.column("tile")[0].as_py()
            u0, v0 = at % across * tile, at // across * tile
            u1, v1 = min(width, u0 + tile), min(height, v0 + tile)
            c0, c1, r0, r1 = max(0, u0 - halo), min(width, u1 + halo), max(0, v0 - halo), min(height, v1 + halo)
            nx, ny = c1 - c0 + 1, r1 - r0 + 1
            x, y = np.meshgrid(np.arange(c0, c1 + 1, dtype=float), np.arange(r0, r1 + 1, dtype=float))
            grain, held = np.zeros((ny, nx), np.int64), np.zeros((ny, nx), bool)
            rows = table.filter(pc.is_valid(table.column("x")))
            j, i = rows.column("x").to_numpy() - c0, rows.column("y").to_numpy() - r0
            for value, name in ((x, "x0"), (y, "y0")):
                own = rows.column(name).to_numpy()
                value[i, j] = np.where(np.isnan(own), value[i, j], own)
            pixel = rows.filter(pc.is_valid(rows.column("grain_id")))
            j, i = pixel.column("x").to_numpy() - c0, pixel.column("y").to_numpy() - r0
            grain[i, j], held[i, j] = pixel.column("grain_id").to_numpy(), True
            i, j = np.nonzero(held[:-1, :-1])  # those of the last column and row lend their places alone
            a = i * nx + j
            t = np.stack([a, a + 1, a + nx + 1, a, a + nx + 1, a + nx], 1).reshape(-1, 3)
            cut = np.zeros((ny, nx), bool)
            cut[:, 0], cut[:, -1] = c0 > 0, c1 < width
            cut[0] |= r0 > 0
            cut[-1] |= r1 < height
            undone, reach = [0] * rounds, np.full(nx * ny, FAR)
            if len(t):
                mx, my, undone, reach = smooth(x.ravel(), y.ravel(), t, np.repeat(grain[i, j], 2), rounds, step, floor, cut.ravel())
                x, y = mx.reshape(ny, nx), my.reshape(ny, nx)
            own = reach.reshape(ny, nx)[v0 - r0 : v1 - r0 + 1, u0 - c0 : u1 - c0 + 1].min()
            i, j = (k.ravel() for k in np.mgrid[v0 - r0 : v1 - r0 + (v1 == height), u0 - c0 : u1 - c0 + (u1 == width)])
            has = held[i, j]
            out = {"x": j + c0, "y": i + r0, "grain_id": pa.array(grain[i, j], mask=~has)}
            for k, (p, q) in enumerate(_CORNERS):
                b, c = np.minimum(i + q, ny - 1), np.minimum(j + p, nx - 1)
                out |= {f"x{k}": pa.array(x[b, c], mask=~has if k else None), f"y{k}": pa.array(y[b, c], mask=~has if k else None)}
            first = np.arange(len(i)) > 0  # what a tile tells of itself stands in its first row
            out |= {"reach": pa.array(np.full(len(i), own), pa.int64(), mask=first), "undone": pa.array([undone] + [None] * (len(i) - 1), pa.list_(pa.int32()))}
            return pa.table(out)

        return run

    every = spark.range(across * down).select(F.col("id").alias("tile"), *(F.lit(None).cast(k).alias(n) for n, k in (("x", "long"), ("y", "long"), ("grain_id", "long"), ("x0", "double"), ("y0", "double"))))
    shape = "x long, y long, grain_id long, " + ", ".join(f"x{k} double, y{k} double" for k in range(4)) + ", reach long, undone array<int>"
    none = F.lit(None).cast("double")
    state = grained.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("grain_id").cast("long").alias("grain_id"), none.alias("x0"), none.alias("y0"))
    left, take, parts = rounds, max(1, rounds), min(across * down, 2000)
    while True:
        in_ = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((F.col(c) - halo) / tile) - 1), F.least(F.lit(n - 1).cast("long"), F.floor((F.col(c) + halo) / tile))))  # noqa: E731,B023
        near = state.withColumn("u", in_("x", across)).withColumn("v", in_("y", down)).select((F.col("v") * across + F.col("u")).alias("tile"), "x", "y", "grain_id", "x0", "y0")
        take = min(take, left)
        found = checkpointed(near.unionByName(every).repartition(parts, "tile").groupBy("tile").applyInArrow(go(halo, take), shape))
        told = found.where("undone is not null").agg(F.min("reach"), *(F.max(F.col("undone")[k]) for k in range(take))).first()
        if told[0] > take + sum(told[1:]):
            left -= take
            state = found.drop("reach", "undone")
            if not left:
                return state
        elif take > 1:
            take //= 2
        else:
            halo *= 2


def elements_of(pixels: DataFrame, width: int) -> DataFrame:
    """(elem_id, n1, n2, n3, grain_id, x1, y1, ..., x3, y3) of `conforming_pixels`: two elements for each pixel, with the places of their corners."""
    a = F.col("y") * (width + 1) + F.col("x")
    node = lambda k: (a + _CORNERS[k][1] * (width + 1) + _CORNERS[k][0]).cast("long")
    halves = [F.struct((2 * (F.col("y") * width + F.col("x")) + h).cast("long").alias("elem_id"), *(node(k).alias(f"n{i + 1}") for i, k in enumerate(corner)), "grain_id", *(F.col(f"{v}{k}").alias(f"{v}{i + 1}") for i, k in enumerate(corner) for v in "xy")) for h, corner in enumerate(((0, 1, 2), (0, 2, 3)))]
    return pixels.where("grain_id is not null").select(F.explode(F.array(*halves)).alias("e")).select("e.*")


def conforming_mesh(spark: SparkSession, grained: DataFrame, width: int, height: int, rounds: int = 30, step: float = 0.5, least: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Nodes and elements (elem_id, n1, n2, n3, grain_id) of a map on the unit grid 0 ... width - 1, 0 ... height - 1: two for each pixel."""
    pixels = conforming_pixels(spark, grained, width, height, rounds, step, least)
    nodes = pixels.select((F.col("y") * (width + 1) + F.col("x")).alias("node_id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return nodes, elements_of(pixels, width).select("elem_id", "n1", "n2", "n3", "grain_id")


def size_field(grained: DataFrame, least: float, slope: float, along_axes: bool = False) -> DataFrame:
    """(i, j, h) at the pixels' corners: element sizes that start from `least` on grain boundaries and grow by `slope` for each unit of distance."""
    seeds = grains.corners(grained).select(F.col("y").alias("i"), F.col("x").alias("j")).distinct()
    edge = grained.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h_"))
    every = grained.select(F.explode(F.array(*(F.struct((F.col("y") + b).alias("i"), (F.col("x") + a).alias("j")) for a in (0, 1) for b in (0, 1)))).alias("p")).select("p.*").distinct()
    far = edge.select(((F.col("w") + F.col("h_")) * F.lit(slope) + least).alias("far"))
    start = every.join(seeds.withColumn("on", F.lit(True)), ["i", "j"], "left").join(F.broadcast(far)).select(F.lit(0).alias("map"), "i", "j", F.when(F.col("on"), F.lit(float(least))).otherwise(F.col("far")).alias("h"))
    return geometry.limit_gradient(start, "map", slope, 0.0, along_axes).select("i", "j", "h")


def look_up(sizes: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, h): bilinear interpolation of a size field (i, j, h) at places (key, x, y): each meets its four corners by an equi-join."""
    x0, y0 = F.floor("x"), F.floor("y")
    each = F.explode(F.array(*(F.struct((y0 + b).alias("i"), (x0 + a).alias("j"), ((1 - F.abs(F.col("x") - x0 - a)) * (1 - F.abs(F.col("y") - y0 - b))).alias("w")) for a in (0, 1) for b in (0, 1))))
    return places.select(key, each.alias("c")).select(key, "c.*").where("w > 0").join(sizes, ["i", "j"]).groupBy(key).agg((F.sum(F.col("w") * F.col("h")) / F.sum("w")).alias("h"))


def rings_of(pixels: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The rings of corners around a set of pixels, by falling signed area: outer ones counter-clockwise, holes clockwise."""
    ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in sorted(pixels):
        for dx, dy, a, b in ((0, -1, (x, y), (x + 1, y)), (1, 0, (x + 1, y), (x + 1, y + 1)), (0, 1, (x + 1, y + 1), (x, y + 1)), (-1, 0, (x, y + 1), (x, y))):
            if (x + dx, y + dy) not in pixels:
                ways.setdefault(a, []).append(b)
    rings = []
    while ways:
        at = start = min(ways)
        ring, came = [], None
        while True:
            out = ways[at]
            if len(out) > 1 and came is not None:  # the sharpest turn to the left keeps diagonal pixels of one grain apart
                turn = lambda p: (came[0] * (p[1] - at[1]) - came[1] * (p[0] - at[0]))  # noqa: E731,B023
                out.sort(key=turn)
            nxt = out.pop()
            if not out:
                del ways[at]
            ring.append(at)
            came, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
            if at == start:
                break
        rings.append(ring)
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) / 2
    rings.sort(key=lambda r: -area(r))
    return rings
