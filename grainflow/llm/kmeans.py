"""Centroids of integer vectors by Lloyd's rounds with Elkan's bounds, exact to the last unit and tie.

The vectors stand in blocks that are written once. What Elkan's method remembers of a vector, an upper bound of the distance to its own centroid
and a lower bound for every centroid, is a small table beside them, by block; a round reads the blocks with the last
round's table and writes the next. Distances between centroids and the bounds, moved on by the centroids' steps, spare most
distances. Bounds are doubles rounded away from the truth and compared strictly, so that whatever could be as near as the own centroid
is computed, and ties are seen; distances that decide are exact integers.

A round's sums are made in the tasks and added up by Spark: the driver gets a number for each component of each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from grainflow.llm.common import as_schema, fresh, materialise, table

#: Vectors of a block at most.
BLOCK = 2048
LIMIT = 2.0**63
BITS = "decimal(38,0)"


def to_integers(df: DataFrame, id_col: str, vector_col: str, scale: int, dim: int | None = None) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of every component x, as double.

    Rows drop out whose vector is null, has another length than `dim` (if given), or holds a null, a NaN, an infinity or a component
    whose floor doesn't fit a long.
    """
    v = F.col(f"`{vector_col}`")
    # A null or a NaN makes the comparison null or false.
    fine = F.forall(v, lambda x: F.coalesce((x.cast("double") * scale < LIMIT) & (x.cast("double") * scale >= -LIMIT), F.lit(False)))
    fits = fine if dim is None else (F.size(v) == dim) & fine
    return df.where(v.isNotNull() & fits).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(lists: pa.Array) -> np.ndarray:
    """The rows of an Arrow column of lists of one length, as long."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (n, ids, vectors) of rows (id, v); vectors of four bytes a component where they fit."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        x = matrix(rows.column(1).combine_chunks())
        x = x.astype(np.int32) if -(2**31) <= x.min() and x.max() < 2**31 else x
        ids = rows.column(0).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary())], names=["n", "ids", "vectors"])

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        while count >= BLOCK:
            rows = pa.Table.from_batches(held)
            yield block(rows.slice(0, BLOCK))
            held, count = rows.slice(BLOCK).to_batches(), count - BLOCK
    if count:
        yield block(pa.Table.from_batches(held))


def _unpacked(batch: pa.RecordBatch, i: int, dim: int) -> np.ndarray:
    """The vectors of a block, as long."""
    data, n = batch.column("vectors")[i].as_buffer(), batch.column("n")[i].as_py()
    return np.frombuffer(data, np.int32 if data.size == 4 * n * dim else np.int64).astype(np.int64).reshape(n, dim)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x * (1 + 2.0**-48), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.nextafter(x * (1 - 2.0**-48), -np.inf))


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of `x` from those of `c`; of Python's integers where 63 bits may not do."""
    d = x - c
    return np.einsum("ij,ij->i", d, d) if d.dtype != object else (d * d).sum(1)


def _root(square: np.ndarray) -> np.ndarray:
    """The roots of exact squares as doubles, within two last places."""
    return np.sqrt(square.astype(np.float64))


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance between each two centroids, rounded down."""
    k = len(centroids)
    return np.array([[0.5 * float(_down(_root(_exact(centroids[i : i + 1], centroids[j : j + 1])))[0]) for j in range(k)] for i in range(k)]).reshape(k, k)


class Bounds:
    """What is remembered of a block's vectors: own centroid, upper bound of its distance, lower bound of every centroid's."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        self.own, self.upper, self.lower = own, upper, lower
        #: Distances that were computed.
        self.computed = 0

    @classmethod
    def none(cls, n: int, k: int) -> Bounds:
        return cls(np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k)))

    def moved(self, steps: np.ndarray) -> None:
        """The centroids have moved by `steps` at most."""
        self.upper = _up(self.upper + steps[self.own])
        self.lower = _down(self.lower - steps)

    def assign(self, x: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> None:
        """Every vector to its nearest centroid, the smaller number of those as near."""
        k = len(centroids)
        nearest = np.where(np.eye(k, dtype=bool), np.inf, half).min(1)
        some = np.flatnonzero(self.upper >= nearest[self.own])
        if not len(some):
            return
        part, own, lower = x[some], self.own[some], self.lower[some]
        square = _exact(part, centroids[own])
        self.computed += len(some)
        root = _root(square)
        upper = _up(root)
        lower[np.arange(len(some)), own] = _down(root)
        for j in range(k):
            ask = np.flatnonzero((own != j) & (upper >= lower[:, j]) & (upper >= half[own, j]))
            if not len(ask):
                continue
            other = _exact(part[ask], centroids[j][None, :])
            self.computed += len(ask)
            root = _root(other)
            lower[ask, j] = _down(root)
            closer = (other < square[ask]) | ((other == square[ask]) & (j < own[ask]))
            won = ask[closer]
            own[won], square[won], upper[won] = j, other[closer], _up(root[closer])
        self.own[some], self.upper[some], self.lower[some] = own, upper, lower


def exact_type(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as long where no squared distance and no sum of a block can leave 63 bits, else as Python's integers."""
    top = max((max(abs(int(a.max())), abs(int(a.min()))) for a in (x, centroids) if a.size), default=0)
    plain = (2 * top) ** 2 * x.shape[1] < 2**63 and top * BLOCK < 2**63
    return (x, centroids) if plain else (x.astype(object), centroids.astype(object))


def _round(centroids: np.ndarray, before: np.ndarray | None, half: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over blocks with what was remembered of them (nothing in the first round): what is now, after assignment to
    `centroids`, and a row without a block that has the sizes and sums, as decimal text, of the task's clusters. `before` are the centroids that the bounds belong to."""
    schema = pa.schema([("block", pa.int64()), ("own", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("size", pa.list_(pa.int64())), ("sums", pa.list_(pa.list_(pa.string())))])
    k, dim = centroids.shape
    steps = None if before is None else _up(_root(_exact(*exact_type(centroids, before))))

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                x = _unpacked(batch, i, dim)
                if steps is None:
                    bounds = Bounds.none(len(x), k)
                else:
                    read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind).copy()  # noqa: B023, E731
                    bounds = Bounds(read("own", np.int32), read("upper", np.float64), read("lower", np.float64).reshape(-1, k))
                    bounds.moved(steps)
                exact, to = exact_type(x, centroids)
                bounds.assign(exact, to, half)
                for c in np.unique(bounds.own):
                    sums[c] += exact[bounds.own == c].sum(0).astype(object)
                sizes += np.bincount(bounds.own, minlength=k)
                yield row(batch.column("block")[i].as_py(), bounds.own.tobytes(), bounds.upper.tobytes(), bounds.lower.tobytes(), None, None)
        yield row(None, None, None, None, sizes.tolist(), [[str(s) for s in c] for c in sums.tolist()])

    return run


ROUND = "block long, own binary, upper binary, lower binary, size array<long>, sums array<array<string>>"


def _final(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over blocks with the vectors' clusters: (id, cluster, distance as decimal text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, to = exact_type(_unpacked(batch, i, centroids.shape[1]), centroids)
                own = np.frombuffer(batch.column("own")[i].as_buffer(), np.int32)
                far = _exact(x, to[own])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(own), pa.array([str(d) for d in far.tolist()], pa.string())], names=["id", "cluster", "distance"])

    return run


def start(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors (id, v) whose ids have the k least sha256 of seed:<id>, in that order; of rows that repeat an id all count, by vector."""
    named = vectors.where(F.col("id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "v")
    return [r["v"] for r in named.orderBy("hash", "v").limit(k).collect()]


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3") -> DataFrame:
    """(id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256) of every vector that takes part.

    Components x become floor(scale * x). The first centroids are the k vectors (all, if fewer) whose ids have the least sha256 of
    `seed:<id>`. A round assigns every vector to the nearest centroid by squared Euclidean distance, ties to the smaller number, and replaces every centroid that has
    vectors by their componentwise floor(sum / count); after `rounds` of them vectors are assigned once more. Rounds that would change
    nothing are left out. All this is exact.

    Vectors that are null or of another length, hold null, NaN or infinity, or a component whose floor doesn't fit a long, take no part and have no row. Rows with
    a null id take part but start no centroid; if no row has an id there are no centroids, and no rows. Repeated rows are rows of their own. A
    distance or inertia that doesn't fit a long is null. The id column keeps its name and type; other columns aren't read.
    """
    vectors = to_integers(df, id_col, vector_col, scale, dim)
    first = start(vectors, k, seed)
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    names = [id_col, *(fresh(n, [id_col]) for n in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))]
    if not first:
        kinds = (kind, IntegerType(), LongType(), LongType(), LongType(), StringType())
        return spark.createDataFrame([], as_schema(*zip(names, kinds, strict=True))[0])
    centroids = np.array(first, np.int64).reshape(len(first), dim)
    packed = vectors.mapInArrow(_packed, f"n int, ids array<{kind.simpleString()}>, vectors binary")
    blocks = materialise(packed.select(F.monotonically_increasing_id().alias("block"), "n", "ids", "vectors"))
    parts = max(1, min(10_000, blocks.count()))
    # Blocks are dealt out once; what is remembered of them follows by the same numbers.
    blocks = materialise(blocks.repartition(parts, "block"))
    following = lambda state, *c: state.where("block IS NOT NULL").select("block", *c).repartition(parts, "block").hint("shuffle_hash")
    state, before, half = None, None, between(centroids.astype(object))
    for n in range(rounds + 1):
        asked = blocks.select("block", "n", "vectors")
        if state is not None:
            asked = asked.join(following(state, "own", "upper", "lower"), "block")
        state = materialise(asked.mapInArrow(_round(centroids, before, half), ROUND))
        if n == rounds:
            break
        each = state.where("block IS NULL").select(F.posexplode(F.arrays_zip("size", "sums")).alias("cluster", "c")).select("cluster", "c.size", F.posexplode("c.sums").alias("at", "sum"))
        told = each.groupBy("cluster", "at").agg(F.sum("size").alias("size"), F.sum(F.col("sum").cast(BITS)).alias("sum")).collect()
        after = centroids.copy()
        for r in told:
            if r["size"]:
                after[r["cluster"], r["at"]] = int(r["sum"]) // r["size"]
        before, centroids = centroids, after
        if (before == centroids).all():
            break  # the assignment is the last one's, and so are all to come
        half = between(centroids.astype(object))
    shape, _ = as_schema(("id", kind), ("cluster", IntegerType()), ("distance", StringType()))
    final = blocks.join(following(state, "own"), "block").mapInArrow(_final(centroids), shape)
    final = materialise(final.withColumn("distance", F.col("distance").cast(BITS)))
    inertia = {r["cluster"]: int(r["d"]) for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    long = lambda x: x if x < 2**63 else None
    rows = [(c, long(d), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    of = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    fits = F.when(F.col("distance") <= F.lit(2**63 - 1), F.col("distance").cast("long"))
    return final.join(of, "cluster").select("id", "cluster", fits.alias("distance"), "cluster_inertia", "inertia", "centroid_sha256").toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
