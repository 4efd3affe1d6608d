"""Polylines and rings as rows (key, seq, x, y): lengths, resampling, areas, curvature, normals, simplification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.operators.components import checkpointed


def _order(key: str) -> Window:
    return Window.partitionBy(key).orderBy("seq")


def arc_length(lines: DataFrame, key: str, normalise: bool = False) -> DataFrame:
    """Rows with s, the length from the first point (or its share of the whole)."""
    w = _order(key)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    out = lines.withColumn("__step", step).withColumn("s", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if normalise:
        total = F.sum("__step").over(Window.partitionBy(key))
        out = out.withColumn("s", F.when(total > 0, F.col("s") / total).otherwise(0.0))
    return out.drop("__step")


def lengths(lines: DataFrame, key: str, closed: bool = False) -> DataFrame:
    """(key, length) of polylines, or of rings with the way back to the first point."""
    w = _order(key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole) if closed else F.col(c))
    return lines.withColumn("__step", F.hypot(nxt("x") - F.col("x"), nxt("y") - F.col("y"))).groupBy(key).agg(F.sum("__step").alias("length"))


def areas(rings: DataFrame, key: str) -> DataFrame:
    """(key, area, ccw): the shoelace area and whether the ring runs counter-clockwise."""
    w = _order(key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    twice = rings.withColumn("__cross", F.col("x") * nxt("y") - nxt("x") * F.col("y")).groupBy(key).agg(F.sum("__cross").alias("twice"))
    return twice.select(key, (F.abs("twice") / 2).alias("area"), (F.col("twice") > 0).alias("ccw"))


def counter_clockwise(rings: DataFrame, key: str) -> DataFrame:
    """Rings, turned round where they run clockwise: seq counts down from 0."""
    turned = rings.join(areas(rings, key).select(key, "ccw"), key)
    return turned.select(*(F.when(F.col("ccw"), F.col("seq")).otherwise(-F.col("seq")).alias("seq") if c == "seq" else F.col(c) for c in rings.columns))


def resample(lines: DataFrame, key: str, n: int | str, closed: bool = False) -> DataFrame:
    """(key, seq, x, y): n points (0 ... n - 1) at equal distances along each line, from the first to the last point; on a ring the first is not repeated.
    n is a number or the name of a column that has it for each line."""
    lines = lines.select(key, "seq", "x", "y", (F.col(n) if isinstance(n, str) else F.lit(n)).alias("__n"))
    if closed:
        ends = lines.groupBy(key).agg(F.min_by(F.struct("x", "y"), "seq").alias("p"), (F.max("seq") + 1).alias("seq"), F.min("__n").alias("__n"))
        lines = lines.unionByName(ends.select(key, "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "__n"))
    at = arc_length(lines, key)
    w = _order(key)
    part = at.select(key, "__n", "s", "x", "y", F.lead("s").over(w).alias("s1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.max("s").over(Window.partitionBy(key)).alias("total"), F.lead("s", 2).over(w).isNull().alias("last"))
    part = part.where(F.col("s1").isNotNull() & ((F.col("s1") > F.col("s")) | F.col("last")))
    count = F.col("__n") if closed else F.greatest(F.col("__n") - 1, F.lit(1))
    # A segment makes the points that fall on it: no join is needed.
    low = F.ceil(F.when(F.col("total") > 0, F.col("s") / F.col("total") * count).otherwise(0.0) - 1e-12).cast("int")
    end = F.when(F.col("total") > 0, F.col("s1") / F.col("total") * count).otherwise(0.0)
    high = F.when(F.col("last"), F.col("__n") - 1).otherwise(F.ceil(end - 1e-12).cast("int") - 1)
    rows = part.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    t = F.when(F.col("s1") > F.col("s"), (F.col("k") * F.col("total") / count - F.col("s")) / (F.col("s1") - F.col("s"))).otherwise(0.0)
    return rows.select(key, F.col("k").alias("seq"), (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))


def _parabola(lines: DataFrame, key: str) -> tuple[DataFrame, list[Column]]:
    """Each point's parabola through its two neighbours, by the distances to them (ta < 0 < tb): its first and second derivatives.
    At an end it goes through the next two points on the one side."""
    w = _order(key)
    at = lambda f, c, other: F.coalesce(f(c).over(w), other(c, 2).over(w))
    near = lines.select("*", F.lag("seq").over(w).isNull().alias("__first"), F.lead("seq").over(w).isNull().alias("__last"), *(at(f, c, g).alias(f"__{c}{n}") for c in "xy" for f, g, n in ((F.lag, F.lead, "a"), (F.lead, F.lag, "b"))))
    ta = F.when(F.col("__first"), 1.0).otherwise(-1.0) * F.hypot(F.col("__xa") - F.col("x"), F.col("__ya") - F.col("y"))
    tb = F.when(F.col("__last"), -1.0).otherwise(1.0) * F.hypot(F.col("__xb") - F.col("x"), F.col("__yb") - F.col("y"))
    out = []
    for c in "xy":
        da, db = F.col(f"__{c}a") - F.col(c), F.col(f"__{c}b") - F.col(c)
        out += [(da * tb * tb - db * ta * ta) / (ta * tb * (tb - ta)), 2 * (db * ta - da * tb) / (ta * tb * (tb - ta))]
    return near, out


def curvature(lines: DataFrame, key: str) -> DataFrame:
    """(key, seq, curvature) from the parabola through each point and its neighbours, at an end the next two; null for lines of fewer than three points."""
    near, (x1, x2, y1, y2) = _parabola(lines, key)
    speed = x1 * x1 + y1 * y1
    return near.select(key, "seq", ((x1 * y2 - y1 * x2) / F.pow(speed, 1.5)).alias("curvature"))


def normals(lines: DataFrame, key: str) -> DataFrame:
    """(key, seq, nx, ny): unit normals from the weighted mean of the two neighbouring segments' directions."""
    w = _order(key)
    seg = lambda f: (f("x").over(w) - F.col("x"), f("y").over(w) - F.col("y"))
    rows = lines.select(key, "seq", *(c.alias(n) for c, n in zip((*seg(F.lag), *seg(F.lead)), ("ax", "ay", "bx", "by"), strict=True)))
    la, lb = F.hypot("ax", "ay"), F.hypot("bx", "by")
    tx = F.coalesce(-F.col("ax") / (la * la), F.lit(0.0)) + F.coalesce(F.col("bx") / (lb * lb), F.lit(0.0))
    ty = F.coalesce(-F.col("ay") / (la * la), F.lit(0.0)) + F.coalesce(F.col("by") / (lb * lb), F.lit(0.0))
    size = F.hypot(tx, ty)
    return rows.select(key, "seq", (-ty / size).alias("nx"), (tx / size).alias("ny"))


def _thinned(x: np.ndarray, y: np.ndarray, keep: int) -> np.ndarray:
    """Indices left after removing, again and again, the vertex whose removal moves the ring least (the area of the triangle with its neighbours)."""
    alive = list(range(len(x)))
    while len(alive) > max(3, keep):
        i = np.array(alive)
        a, b = np.roll(i, 1), np.roll(i, -1)
        cost = np.abs((x[i] - x[a]) * (y[b] - y[a]) - (x[b] - x[a]) * (y[i] - y[a]))
        del alive[int(np.argmin(cost))]
    return np.array(alive, int)


def decimate(rings: DataFrame, key: str, share: float) -> DataFrame:
    """(key, seq, x, y): rings with `share` of their vertices, three at least. A ring is one task's work and must fit it."""
    kind = rings.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        return pdf.iloc[_thinned(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), round(share * len(pdf)))]

    return rings.select(key, F.col("seq").cast("long").alias("seq"), "x", "y").groupBy(key).applyInPandas(run, f"`{key}` {kind}, seq long, x double, y double")


def allowed(a: np.ndarray, b: np.ndarray, slope: float, along_axes: bool) -> np.ndarray:
    """The most that cells may have whose lower neighbours along the two axes have a and b: for the gradient's length, the upwind form, at `slope`; along each axis, a
    step of `slope`."""
    one = np.minimum(a, b) + slope
    if along_axes:
        return one
    with np.errstate(invalid="ignore"):
        apart = np.abs(a - b)
        both = (a + b + np.sqrt(np.maximum(2 * slope * slope - apart * apart, 0))) / 2
    return np.where(apart < slope, both, one)


#: Cells along a side of a tile.
TILE = 128
#: Where a border comes from, and the edge of its sender and the place for it in the frame of the receiver.
_BORDERS = {1: (-1, 0, np.s_[-2, 1:-1], np.s_[0, 1:-1]), 2: (1, 0, np.s_[1, 1:-1], np.s_[-1, 1:-1]), 3: (0, -1, np.s_[1:-1, -2], np.s_[1:-1, 0]), 4: (0, 1, np.s_[1:-1, 1], np.s_[1:-1, -1])}


def _relaxed(state: np.ndarray, slope: float, tolerance: float, along_axes: bool) -> None:
    """Lower the cells of a tile, in a frame of its neighbours' borders, until nothing changes by more than `tolerance`."""
    inner = state[1:-1, 1:-1]
    while True:
        best = np.minimum(inner, allowed(np.minimum(state[:-2, 1:-1], state[2:, 1:-1]), np.minimum(state[1:-1, :-2], state[1:-1, 2:]), slope, along_axes))
        with np.errstate(invalid="ignore"):
            change = np.nanmax(inner - best, initial=0.0)
        if change <= tolerance:
            return
        inner[:] = best


def limit_gradient(sizes: DataFrame, key: str, slope: float, tolerance: float = 1e-5, along_axes: bool = False, tile: int = TILE, rounds: list[int] | None = None) -> DataFrame:
    """(key, i, j, h): the largest field below h whose gradient (periodic grid, unit distance) has the length `slope` at most, or, with
    `along_axes`, whose step to each neighbour is `slope` at most.

    A grid is cut into tiles. In a round every tile that got new borders sweeps until nothing changes by more than `tolerance`, and sends the borders that
    have changed to its neighbours round the torus; it ends when none has. So a task holds a tile, and sizes that reach over several tiles take as
    many rounds; `rounds` gets their number. Cells that the grid lacks count as infinite.
    """
    kind = sizes.schema[key].dataType.simpleString()
    size = sizes.groupBy(key).agg((F.max("i") + 1).cast("int").alias("ni"), (F.max("j") + 1).cast("int").alias("nj"))
    cells = sizes.select(key, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "h").join(size, key)
    placed = cells.withColumns({"ti": F.floor(F.col("i") / tile).cast("int"), "tj": F.floor(F.col("j") / tile).cast("int")})
    shape = f"`{key}` {kind}, ti int, tj int, ni int, nj int, kind int, data binary"

    def sent(head: dict, state: np.ndarray, before: np.ndarray) -> list[dict]:
        """The tile, and the borders that differ from those before."""
        n, m = -(-head["ni"] // tile), -(-head["nj"] // tile)
        out = [head | {"kind": 0, "data": state.tobytes()}]
        for side, (di, dj, edge, _) in _BORDERS.items():
            if not np.array_equal(state[edge], before[edge]):
                out.append(head | {"ti": (head["ti"] - di) % n, "tj": (head["tj"] - dj) % m, "kind": side, "data": state[edge].tobytes()})
        return out

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {c: pdf[c].iloc[0] for c in (key, "ti", "tj", "ni", "nj")}
        i0, j0 = head["ti"] * tile, head["tj"] * tile
        state = np.full((min(tile, head["ni"] - i0) + 2, min(tile, head["nj"] - j0) + 2), np.inf)
        state[pdf["i"] - i0 + 1, pdf["j"] - j0 + 1] = pdf["h"]
        _relaxed(state, slope, tolerance, along_axes)
        return pd.DataFrame(sent(head, state, np.full_like(state, np.inf)))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == 0].iloc[0]
        head = {c: own[c] for c in (key, "ti", "tj", "ni", "nj")}
        if len(pdf) == 1:
            return pd.DataFrame([head | {"kind": 0, "data": own["data"]}])
        state = np.frombuffer(own["data"]).reshape(min(tile, head["ni"] - head["ti"] * tile) + 2, -1).copy()
        before = state.copy()
        for side, data in zip(pdf["kind"], pdf["data"], strict=True):
            if side:
                place = _BORDERS[side][3]
                state[place] = np.minimum(state[place], np.frombuffer(data))
        _relaxed(state, slope, tolerance, along_axes)
        return pd.DataFrame(sent(head, state, before))

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        state = np.frombuffer(r["data"]).reshape(min(tile, r["ni"] - r["ti"] * tile) + 2, -1)[1:-1, 1:-1]
        i, j = np.indices(state.shape)
        return pd.DataFrame({key: r[key], "i": (i + r["ti"] * tile).ravel().astype(np.int32), "j": (j + r["tj"] * tile).ravel().astype(np.int32), "__h": state.ravel()})

    now, count = checkpointed(placed.groupBy(key, "ti", "tj").applyInPandas(start, shape)), 0
    while not now.where("kind > 0").isEmpty():
        now, count = checkpointed(now.groupBy(key, "ti", "tj").applyInPandas(step, shape)), count + 1
    if rounds is not None:
        rounds.append(count)
    done = now.groupBy(key, "ti", "tj").applyInPandas(spread, f"`{key}` {kind}, i int, j int, __h double")
    return cells.select(key, "i", "j").join(done, [key, "i", "j"]).withColumnRenamed("__h", "h")


def mirror(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Points and their antipodes, which have the same values."""
    return points.unionByName(points.select(*((-F.col(c)).alias(c) if c in columns else F.col(c) for c in points.columns)))


def rectangle(xc: Column, yc: Column, width: Column, height: Column, turn: Column) -> Column:
    """Corners (x, y), counter-clockwise, of a rectangle turned by `turn` radians about its centre, as an array."""
    c, s = F.cos(turn), F.sin(turn)
    each = [(u * width / 2, v * height / 2) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    return F.array(*(F.struct((xc + c * u - s * v).alias("x"), (yc + s * u + c * v).alias("y")) for u, v in each))


def densify(rings: DataFrame, key: str) -> DataFrame:
    """(key, seq, x, y): rings of points with whole coordinates, joined by horizontal, vertical or diagonal sides, with all whole points
    on their sides; seq is in the order of the ring, with gaps."""
    w = _order(key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    sides = rings.select(key, "seq", "x", "y", (nxt("x") - F.col("x")).alias("dx"), (nxt("y") - F.col("y")).alias("dy"))
    steps = F.greatest(F.abs("dx"), F.abs("dy"))
    each = sides.withColumn("n", F.greatest(steps, F.lit(1)).cast("long")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select(key, (F.col("seq") * 1_000_000 + F.col("k")).alias("seq"), (F.col("x") + F.col("k") * F.col("dx") / F.col("n")).alias("x"), (F.col("y") + F.col("k") * F.col("dy") / F.col("n")).alias("y"))
