"""Near-duplicate vectors by cosine, exactly: cover trees, and a dual traversal of pairs of them.

Unit vectors with cosine s lie sqrt(2 - 2 s) apart, so a threshold of cosine is one of distance.

1. Equal vectors are one class: copies are never compared. A class has its least id and its number of rows.
2. Classes are dealt to cells, each the neighbourhood of a pivot; a cell is cut into blocks of bounded size, so a cell that holds
   a third of all rows is many blocks. The pivots are the first centres of a cover tree of a bounded sample; they
   decide which vectors stand together, and no result.
3. Each block becomes a cover tree: nested levels, where a level's centres lie more than its radius apart and every vector within
   it of one, and the radius halves from level to level. A node keeps the greatest distance to what hangs below it, its covering radius.
4. Pairs of cells, then of blocks, go where covering radii prove that nothing in them can meet. What is left is traversed a pair of
   trees at a time, from the roots down: a pair of nodes farther apart than threshold and both radii is dropped with all below it; a pair so
   close that everything below it must link is counted whole; others are replaced by the pairs of their children. Single vectors are
   decided by their cosine in double precision, so rounding in the bounds, which keep a margin, decides nothing.
5. Trees are written once. Where radii prove most pairs apart, a tree is sent to its few partners by a shuffle; else tasks read the trees of two
   partitions each where they were written, so that disk grows with the vectors and not with the pairs.
6. A task returns each linked class with its number of links and one edge of a spanning forest, never all its pairs; components follow
   by union-find. `threshold_pairs` returns the pairs themselves.

Where vectors have no structure (independent directions in many dimensions) no bound can prune, and the work is that of all pairs
of classes, as products of matrices.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType

from grainflow.llm.common import as_schema, fresh, materialise, small, table
from grainflow.operators.components import connected_components

COSINE = 0.95
#: Classes in a block, pivots, and sampled vectors that pivots are chosen from, at most.
BLOCK, PIVOTS, SAMPLE = 4096, 1024, 4096
#: Rows of a class from which its rows meet its result by broadcast.
HOT = 4096
#: Times that a tree is sent by shuffle at most, on average; partitions of trees at least (if there are so many), and bytes of one about.
SENT, PARTS, PART_BYTES = 2, 32, 32 << 20
#: Rows of results that a task holds until it sums them up.
SUMMED = 500_000
#: Rows of a tile of distances, which has four times as many columns, and pairs of nodes held at once.
TILE, HELD = 512, 1_000_000
#: The least radius of a level; vectors that are closer are told apart at the last level, which has them all.
LEAST = 2.0**-20


@dataclass
class Level:
    """Nodes in the order of the vectors below them: these are low to high; `first` to `last` are the children in the next level."""

    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


#: A level's fields that are places.
_NUMBERS = ("low", "high", "centre", "first", "last")


@dataclass
class Tree:
    """Vectors (scaled by powers of two), their lengths, numbers and weights in the order of the leaves, and the levels from the root down."""

    x: np.ndarray
    length: np.ndarray
    number: np.ndarray
    weight: np.ndarray
    levels: list[Level]

    def __post_init__(self) -> None:
        self.unit = self.x / self.length[:, None]
        self.unit32 = self.unit.astype(np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; directions stay the same to the last bit."""
    top = np.abs(x).max(1, initial=0)
    return np.ldexp(x, -np.frexp(top)[1][:, None])


def _distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * dot))


def nets(unit: np.ndarray, most: int | None = None) -> tuple[list[int], list[int], list[np.ndarray]]:
    """(centres, number of them at each level, each vector's nearest centre at each level) of nested nets with radii 2, 1, 1/2, ...

    A level's centres are the first so many. It ends at `most` centres, or when all vectors are centres.
    """
    n = len(unit)
    u = unit.astype(np.float32)
    centres, counts, owners = [0], [1], [np.zeros(n, np.int64)]
    near = _distance(u @ u[0])
    owner = np.zeros(n, np.int64)
    near[0], radius = 0, 1.0
    while len(centres) < min(n, most or n) and radius >= LEAST:
        left = np.flatnonzero(near > radius)
        while len(left):
            some = left[:256]
            far = _distance(u[some] @ u[some].T) > radius
            alive, chosen = np.ones(len(some), bool), []
            for i in range(len(some)):
                if alive[i]:
                    chosen.append(i)
                    alive &= far[i]
            new = some[chosen]
            for at in range(0, n, 65536):
                rows = slice(at, at + 65536)
                d = _distance(u[rows] @ u[new].T)
                best = d.argmin(1)
                d = d[np.arange(len(best)), best]
                closer = d < near[rows]
                near[rows] = np.where(closer, d, near[rows])
                owner[rows] = np.where(closer, best + len(centres), owner[rows])
            near[new] = 0
            owner[new] = len(centres) + np.arange(len(new))
            centres += new.tolist()
            left = left[near[left] > radius]
        counts.append(len(centres))
        owners.append(owner.copy())
        radius /= 2
    return centres, counts, owners


def build(x: np.ndarray, number: np.ndarray, weight: np.ndarray) -> Tree:
    """The cover tree of the rows of `x`, none of them zero."""
    x = scaled(np.asarray(x, np.float64))
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / length[:, None]
    n = len(x)
    centres, counts, owners = nets(unit)
    net = np.array(centres)
    # Each vector's node at each level, from the deepest net up.
    up = [owners[-1]]
    for owner in owners[-2::-1]:
        up.append(owner[net[up[-1]]])
    up = up[::-1]
    radii = []
    for node, count in zip(up, counts, strict=True):
        radius = np.zeros(count)
        np.maximum.at(radius, node, _distance(np.einsum("ij,ij->i", unit, unit[net[node]])))
        radii.append(radius)
    # Siblings stand in the order of their radii, so that wide nodes share tiles.
    rank = []
    for radius in radii:
        place = np.empty(len(radius), np.int64)
        place[np.lexsort((np.arange(len(radius)), radius))] = np.arange(len(radius))
        rank.append(place)
    order = np.lexsort([np.arange(n), *(r[node] for r, node in zip(rank[::-1], up[::-1], strict=True))])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    levels, lows = [], []
    for node in up:
        own = node[order]
        lows.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])))
    lows.append(np.arange(n))
    for i, low in enumerate(lows):
        high = np.append(low[1:], n)
        below = lows[min(i + 1, len(lows) - 1)]
        leaf = i == len(up)
        node = None if leaf else up[i][order][low]
        levels.append(Level(low, high, low if leaf else place[net[node]], np.zeros(n) if leaf else radii[i][node], np.searchsorted(below, low), np.searchsorted(below, high)))
    return Tree(x[order], length[order], number[order], weight[order], levels)


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join what `i` and `j` belong to; `label` leads every node to the least of its set."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): for each row i the numbers from first[i] up to last[i]."""
    size = last - first
    row = np.repeat(np.arange(len(first)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]


class Dual:
    """The traversal of trees `a` and `b`, or of `a` with itself: links and labels of their vectors, or the pairs."""

    def __init__(self, a: Tree, b: Tree | None, cosine: float, pairs: bool = False) -> None:
        self.a, self.same = a, b is None
        self.b = a if b is None else b
        self.cosine, self.pairs = cosine, pairs
        self.limit = float(_distance(np.array(cosine)))
        d = a.x.shape[1]
        # Margins for rounding, of distances in double and of products in single precision.
        self.eps, self.slack = 4 * np.sqrt((d + 8) * 2.0**-52), (d + 8) * 2.0**-22
        n, m = len(a.x), 0 if self.same else len(b.x)
        self.links = np.zeros(n + m, np.int64)
        self.label = np.arange(n + m)
        self.shift = 0 if self.same else n
        self.met: list[tuple[np.ndarray, np.ndarray]] = []
        #: Distances computed, and pairs of vectors decided by whole nodes.
        self.computed = self.spared = 0

    def run(self) -> Dual:
        root = np.zeros(1, np.int64)
        stack = [(0, root, root, _distance(self._dot(self.a.levels[0].centre[:1], self.b.levels[0].centre[:1])))]
        last = max(len(self.a.levels), len(self.b.levels)) - 1
        while stack:
            level, i, j, d = stack.pop()
            p, q = self._level(self.a, level), self._level(self.b, level)
            reach = p.radius[i] + q.radius[j]
            own = (i == j) if self.same else np.zeros(len(i), bool)
            if level == last:
                i, j = p.low[i[~own]], q.low[j[~own]]
                linked = self._cosine(i, j) >= self.cosine
                self._link(i[linked], j[linked])
                continue
            whole = d + reach <= self.limit - self.eps
            self._whole(p, q, i[whole], j[whole])
            rest = ~whole & (d - reach <= self.limit + self.eps)
            for i2, j2, d2 in self._expand(level, p, q, i[rest], j[rest]):
                stack += [(level + 1, i2[at : at + HELD], j2[at : at + HELD], d2[at : at + HELD]) for at in range(0, len(i2), HELD)]
        return self

    @staticmethod
    def _level(tree: Tree, level: int) -> Level:
        return tree.levels[min(level, len(tree.levels) - 1)]

    def _dot(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.computed += len(i)
        return np.concatenate([np.einsum("ij,ij->i", self.a.unit[i[at : at + 65536]], self.b.unit[j[at : at + 65536]]) for at in range(0, max(1, len(i)), 65536)])

    def _cosine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.computed += len(i)
        return np.concatenate(
            [
                np.einsum("ij,ij->i", self.a.x[p], self.b.x[q]) / (self.a.length[p] * self.b.length[q])
                for p, q in ((i[at : at + 65536], j[at : at + 65536]) for at in range(0, max(1, len(i)), 65536))
            ]
        )

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of vectors that link."""
        if not len(i):
            return
        if self.pairs:
            self.met.append((i, j))
            return
        np.add.at(self.links, i, self.b.weight[j])
        np.add.at(self.links, j + self.shift, self.a.weight[i])
        hook(self.label, i, j + self.shift)

    def _whole(self, p: Level, q: Level, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of nodes of which all vectors link."""
        if self.pairs:
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                k, m = (v.ravel() for v in np.meshgrid(np.arange(p.low[x], p.high[x]), np.arange(q.low[y], q.high[y]), indexing="ij"))
                once = k < m if self.same and x == y else slice(None)
                self._link(k[once], m[once])
            return
        for at in range(0, len(i), 10_000):
            x, y = i[at : at + 10_000], j[at : at + 10_000]
            sums_a, sums_b = np.append(0, np.cumsum(self.a.weight)), np.append(0, np.cumsum(self.b.weight))
            a, b = sums_a[p.high[x]] - sums_a[p.low[x]], sums_b[q.high[y]] - sums_b[q.low[y]]
            self.spared += int(((p.high[x] - p.low[x]) * (q.high[y] - q.low[y])).sum())
            row, k = _ranges(p.low[x], p.high[x])
            np.add.at(self.links, k, b[row])
            hook(self.label, k, q.low[y][row] + self.shift)
            own = (x == y) if self.same else np.zeros(len(x), bool)
            np.subtract.at(self.links, k[own[row]], self.a.weight[k[own[row]]])
            row, k = _ranges(q.low[y[~own]], q.high[y[~own]])
            np.add.at(self.links, k + self.shift, a[~own][row])
            hook(self.label, k + self.shift, p.low[x[~own]][row])

    def _expand(self, level: int, p: Level, q: Level, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of children that may hold links, with their distances."""
        child_a, child_b = self._level(self.a, level + 1), self._level(self.b, level + 1)
        # A tree that ends before the other waits at its leaves.
        first_a, last_a = (p.first, p.last) if level < len(self.a.levels) - 1 else (np.arange(len(p.low)), np.arange(len(p.low)) + 1)
        first_b, last_b = (q.first, q.last) if level < len(self.b.levels) - 1 else (np.arange(len(q.low)), np.arange(len(q.low)) + 1)
        many = (last_a[i] - first_a[i]) * (last_b[j] - first_b[j])
        for x, y in zip(i[many > 4096].tolist(), j[many > 4096].tolist(), strict=True):
            yield from self._tiles(child_a, child_b, slice(first_a[x], last_a[x]), slice(first_b[y], last_b[y]), self.same and x == y)
        i, j, many = i[many <= 4096], j[many <= 4096], many[many <= 4096]
        part = np.cumsum(many) // HELD
        for cut in np.split(np.arange(len(i)), np.flatnonzero(np.diff(part)) + 1) if len(i) else []:
            x, y = i[cut], j[cut]
            row, k = _ranges(first_a[x], last_a[x])
            row2, m = _ranges(first_b[y][row], last_b[y][row])
            k = k[row2]
            if self.same:
                keep = (x != y)[row][row2] | (k <= m)
                k, m = k[keep], m[keep]
            yield self._near(child_a, child_b, k, m)

    def _near(self, p: Level, q: Level, k: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = _distance(self._dot(p.centre[k], q.centre[m]))
        keep = d <= self.limit + self.eps + p.radius[k] + q.radius[m]
        return k[keep], m[keep], d[keep]

    def _tiles(self, p: Level, q: Level, rows: slice, columns: slice, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        right = self.b.unit32[q.centre[columns]]
        for top in range(rows.start, rows.stop, TILE):
            k = np.arange(top, min(top + TILE, rows.stop))
            left = self.a.unit32[p.centre[k]]
            for at in range(columns.start, columns.stop, 4 * TILE):
                m = np.arange(at, min(at + 4 * TILE, columns.stop))
                if same and m[-1] < k[0]:
                    continue
                dot = left @ right[at - columns.start : at - columns.start + len(m)].T
                self.computed += dot.size
                reach = self.limit + self.eps + p.radius[k].max() + q.radius[m].max()
                least = 1 - reach**2 / 2 - self.slack
                if least < 0.3:  # wide nodes: a limit for each pair
                    reach = (self.limit + self.eps + p.radius[k])[:, None] + q.radius[m][None, :]
                    x, y = np.nonzero(dot >= (1 - reach**2 / 2 - self.slack).astype(np.float32))
                else:
                    some = np.flatnonzero(dot.max(1) >= least)
                    x, y = np.nonzero(dot[some] >= least)
                    x = some[x]
                x, y = k[x], m[y]
                if same:
                    keep = x <= y
                    x, y = x[keep], y[keep]
                for cut in range(0, len(x), HELD):
                    yield self._near(p, q, x[cut : cut + HELD], y[cut : cut + HELD])


def _vectors(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat components as double, starts, lengths) of lists without nulls."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths) - lengths, lengths


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) with a 128-bit digest of the vector, -0 read as 0; null for one that links with nothing."""
    for batch in batches:
        flat, starts, lengths = _vectors(batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1))
        flat = flat + 0.0
        fine = np.isfinite(flat)
        keys = []
        for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            v = flat[s : s + n]
            keys.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if fine[s : s + n].all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], names=["id", "v", "key"])


def _cells(pivots: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Classes (number, n, v) with length, nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts, lengths = _vectors(batch.column(2))
            cell, far = np.zeros(len(lengths), np.int32), np.full(len(lengths), 2.0)
            for dim in np.unique(lengths):
                if (mine := pivots.get(int(dim))) is not None:
                    rows = np.flatnonzero(lengths == dim)
                    x = scaled(flat[starts[rows, None] + np.arange(dim)])
                    dot = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ mine.T
                    cell[rows] = dot.argmax(1)
                    far[rows] = _distance(dot.max(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(cell), pa.array(far)], names=["number", "n", "v", "dim", "cell", "far"])

    return run


def _packed(tree: Tree) -> tuple:
    """A tree as it is sent to its partners: vectors that single precision holds exactly take half the room, and so do the numbers of nodes."""
    with np.errstate(over="ignore"):
        short = tree.x.astype(np.float32)
    levels = [[getattr(v, f).astype(np.int32) for f in _NUMBERS] + [v.radius] for v in tree.levels]
    return (short if (short == tree.x).all() else tree.x), tree.length, tree.number, tree.weight, levels


def _unpacked(state: bytes) -> Tree:
    x, length, number, weight, levels = pickle.loads(state)
    return Tree(x.astype(np.float64), length, number, weight, [Level(**dict(zip(_NUMBERS, (a.astype(np.int64) for a in v), strict=False)), radius=v[-1]) for v in levels])


def _planted(rows: pa.Table) -> pa.Table:
    """A block's classes as one row with their tree."""
    rows = rows.combine_chunks().sort_by("number")
    flat, _, lengths = _vectors(rows.column("v").chunk(0))
    read = lambda name: rows.column(name).to_numpy().astype(np.int64)
    tree = build(flat.reshape(len(lengths), -1), read("number"), read("n"))
    top = tree.levels[0]
    state = pickle.dumps(_packed(tree), protocol=5)
    first = [rows.column(c)[0].as_py() for c in ("block", "dim", "cell")]
    return pa.table({"block": [first[0]], "dim": pa.array([first[1]], pa.int32()), "cell": pa.array([first[2]], pa.int32()), "centre": [tree.unit[top.centre[0]].tolist()], "radius": [float(top.radius[0])], "tree": pa.array([state], pa.binary())})


def _traversal(trees: list[Tree], cosine: float, pairs: bool) -> pa.Table:
    """One pair of blocks (one tree if a block meets itself): linked classes, or pairs of them."""
    found = Dual(trees[0], trees[1] if len(trees) > 1 else None, cosine, pairs).run()
    number = np.concatenate([t.number for t in trees])
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*found.met, strict=True)) if found.met else (np.zeros(0, np.int64),) * 2
        a, b = number[i], number[j + found.shift]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": found._cosine(i, j) if len(i) else np.zeros(0)})
    linked = np.flatnonzero(found.links)
    return pa.table({"number": number[linked], "links": found.links[linked], "other": number[found.label[linked]]})


def _traversed(cosine: float, pairs: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _traversal([_unpacked(t) for t in rows.sort_by("side").column("tree").to_pylist()], cosine, pairs)


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Linked classes of several pairs of blocks, each once: links add up, and what is joined by any of them is joined."""
    number, links, other = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("number", "links", "other"))
    names, at = np.unique(np.concatenate([number, other]), return_inverse=True)
    total, label = np.zeros(len(names), np.int64), np.arange(len(names))
    np.add.at(total, at[: len(number)], links)
    hook(label, at[: len(number)], at[len(number) :])
    return pa.table({"number": names, "links": total, "other": names[label]})


def _traversed_rows(cosine: float, pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (tree, with), each a pair of blocks; without `with` a block meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                both = [_unpacked(c[i].as_py()) for c in batch.columns if c[i].is_valid]
                got = _traversal(both, cosine, pairs)
                if pairs:
                    yield from got.to_batches(65536)
                    continue
                held.append(got)
                rows += len(got)
                if rows > SUMMED:
                    held = [_summed(held)]
                    rows = 0
        if held:
            yield from _summed(held).to_batches(65536)

    return run


def classes(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows (id, key), classes (number, id, n, v, key)): the rows with a digest of their vectors, and each different vector once.

    The key is null for vectors that link with nothing: null, empty or zero, or with null, NaN or infinite components.
    """
    kind = df.schema[id_col].dataType
    schema, _ = as_schema(("id", kind), ("v", df.schema[vector_col].dataType), ("key", BinaryType()))
    v = F.col(f"`{vector_col}`")
    whole = F.when(F.forall(v, lambda x: x.isNotNull()), v)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), whole.alias("v")).mapInArrow(_keyed, schema)
    grouped = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    return rows.select("id", "key"), materialise(grouped.select(F.monotonically_increasing_id().alias("number"), "id", "n", "v", "key"))


def _pivots(found: DataFrame, count: int, block: int) -> dict[int, np.ndarray]:
    """Unit vectors of each length: the first centres of the nested nets of a sample, those with the least digests."""
    most = min(PIVOTS, -(-count // block))
    if most < 2:
        return {}
    by: dict[int, list] = {}
    for r in found.select("v", "key").orderBy("key").limit(SAMPLE).collect():
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, vectors in by.items():
        x = scaled(np.array(vectors, np.float64))
        unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        share = max(1, most * len(vectors) // sum(map(len, by.values())))
        out[dim] = unit[nets(unit, share)[0][:share]]
    return out


def _blocks(found: DataFrame, block: int) -> tuple[DataFrame, dict[int, np.ndarray], list]:
    """(block rows with trees, pivots, cells (dim, cell, classes, distance to the pivot at most))."""
    count = found.count()
    pivots = _pivots(found, count, block)
    kind = found.schema["v"].dataType
    schema, _ = as_schema(*((n, found.schema[n].dataType) for n in ("number", "n")), ("v", kind), ("dim", IntegerType()), ("cell", IntegerType()))
    dealt = found.select("number", "n", "v").mapInArrow(_cells(pivots), schema.add("far", "double"))
    # The rows of a cell: sizes first, so that a large cell is cut into parts.
    cells = dealt.groupBy("dim", "cell").agg(F.count("*").alias("size"), F.max("far").alias("far")).collect() if count else []
    parts = found.sparkSession.createDataFrame([(r["dim"], r["cell"], -(-r["size"] // block)) for r in cells], "dim int, cell int, parts long")
    part = F.pmod(F.xxhash64("number"), F.col("parts"))
    named = dealt.join(small(parts), ["dim", "cell"]).withColumn("block", F.concat_ws("/", "dim", "cell", part))
    shape = "block string, dim int, cell int, centre array<double>, radius double, tree binary"
    count = max(min(PARTS, sum(-(-r["size"] // block) for r in cells)), -(-sum(r["size"] * (8 * r["dim"] + 48) for r in cells) // PART_BYTES), 1)
    return materialise(named.select("block", "dim", "cell", "number", "n", "v").repartition(count, "block").groupBy("block").applyInArrow(_planted, shape)), pivots, cells


def _hopeful(limit: float) -> Column:
    """Whether blocks a (centre p, radius r) and b (q, s), a <= b, may hold a link."""
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("p", "q", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)))
    return (F.col("a") <= F.col("b")) & ((F.col("a") == F.col("b")) | (apart <= limit + F.col("r") + F.col("s") + 1e-5))


def _pairs_of_blocks(trees: DataFrame, pivots: dict[int, np.ndarray], cells: list, limit: float) -> DataFrame:
    """(pair, a, b) of the blocks, a <= b, whose covering radii leave hope, found from the pairs of cells that do."""
    near = []
    for dim in {r["dim"] for r in cells}:
        mine = [r for r in cells if r["dim"] == dim]
        names, far = [r["cell"] for r in mine], np.array([r["far"] for r in mine])
        if dim in pivots:
            unit = pivots[dim][names]
            i, j = np.nonzero(_distance(unit @ unit.T) <= limit + far[:, None] + far[None, :] + 1e-6)
        else:
            i, j = (np.zeros(1, int),) * 2
        near += [(dim, names[x], names[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    spark = trees.sparkSession
    hoped = spark.createDataFrame(near, "dim int, cell int, cell_b int")
    a = trees.select("dim", "cell", F.col("block").alias("a"), F.col("centre").alias("p"), F.col("radius").alias("r"))
    b = trees.select("dim", F.col("cell").alias("cell_b"), F.col("block").alias("b"), F.col("centre").alias("q"), F.col("radius").alias("s"))
    met = hoped.join(a, ["dim", "cell"]).join(b, ["dim", "cell_b"]).where(_hopeful(limit))
    return materialise(met.select(F.concat_ws("|", "a", "b").alias("pair"), "a", "b"))


def _traverse(found: DataFrame, cosine: float, block: int, pairs: bool) -> DataFrame:
    if not 0 < cosine < 1:
        raise ValueError("the cosine must be between 0 and 1")
    trees, pivots, cells = _blocks(found, block)
    limit = float(_distance(np.array(cosine)))
    meet = _pairs_of_blocks(trees, pivots, cells, limit)
    count, blocks = meet.count(), trees.count()
    shape = "a long, b long, cosine double" if pairs else "number long, links long, other long"
    if 2 * count > SENT * blocks + blocks:
        # Every partition of trees meets every other where they were written; nothing is shuffled.
        a = trees.select("dim", F.col("block").alias("a"), F.col("centre").alias("p"), F.col("radius").alias("r"), "tree")
        b = trees.select(F.col("dim").alias("dim_b"), F.col("block").alias("b"), F.col("centre").alias("q"), F.col("radius").alias("s"), F.col("tree").alias("with"))
        both = a.hint("shuffle_replicate_nl").join(b, (F.col("dim") == F.col("dim_b")) & _hopeful(limit))
        return both.select("tree", F.when(F.col("a") != F.col("b"), F.col("with")).alias("with")).mapInArrow(_traversed_rows(cosine, pairs), shape)
    sides = meet.select("pair", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(meet.where("a <> b").select("pair", F.col("b").alias("block"), F.lit(1).alias("side")))
    sent = sides.join(trees.select("block", "tree"), "block").select("pair", "side", "tree").repartition(max(1, min(10_000, count)), "pair")
    return sent.groupBy("pair").applyInArrow(_traversed(cosine, pairs), shape)


def threshold_pairs(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, cosine), membership (id, class)): every pair of different vectors with at least this cosine once, each vector named by
    the number of its class, and the class of every row, null where a vector links with nothing. Equal vectors share a class."""
    rows, found = classes(df, id_col, vector_col)
    return _traverse(found, cosine, block, True), rows.join(found.select("key", F.col("number").alias("class")), "key", "left").select("id", "class")


def groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(id, n_links long, component_id, kept) of every row: the other rows whose vectors have at least this cosine with it, in
    double precision; the least id reachable by links, its own included; whether that is its own.

    Vectors may be of any length; those of different lengths link with nothing, nor do null, empty or zero vectors and those
    with a null, NaN or infinite component: they have no links and stay. Rows that repeat a vector link with each other; rows that
    repeat an id are rows of their own. Null ids count after all others. The id column keeps its name and type; other columns of
    the input may have any name and are not read. An empty table gives an empty result. Work and memory: see the module.
    """
    rows, found = classes(df, id_col, vector_col)
    met = materialise(_traverse(found, cosine, block, False))
    links = met.groupBy("number").agg(F.sum("links").alias("links"))
    part = connected_components(met.where("number <> other").select(F.col("number").alias("a"), F.col("other").alias("b")))
    named = found.select("number", "id", "n", "key").join(links, "number", "left").join(part.withColumnRenamed("node", "number"), "number", "left")
    named = materialise(named.select("key", "id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "number").alias("component")))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    told = materialise(named.join(least, "component").where("links > 0 OR n > 1").select("key", "least", "n", (F.col("links") + F.col("n") - 1).alias("n_links")))
    # A class with very many rows meets them by broadcast, the others by their keys.
    hot = small(told.where(F.col("n") > HOT))
    warm = rows.join(hot.select("key", "least", "n_links"), "key")
    cold = rows.join(hot.select("key"), "key", "left_anti").join(told.where(F.col("n") <= HOT).select("key", "least", "n_links"), "key", "left")
    both = warm.select("id", "n_links", "least").unionByName(cold.select("id", "n_links", F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("least")).alias("least")))
    new = fresh("component_id", [id_col])
    out = both.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias(fresh("n_links", [id_col])), F.col("least").alias(new))
    return out.withColumn(fresh("kept", [id_col]), F.col(f"`{id_col}`").eqNullSafe(F.col(new)))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "embeddings"))
