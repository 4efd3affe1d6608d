"""Exact top-k search by inner product over a vector-approximation file.

The file (`write`, `open_file`) holds chunks of approximations: for every dimension a grid of 2**bits cells over the
chunk's own range, and the cell number of every component, a byte; the exact vectors stay where they are. A search scans the
cells alone: a query's inner product with a cell's corners bounds every score from both sides, and a vector
whose upper bound is below the query's k-th lower bound is out. Then exact vectors are read in the order of their
bounds, in growing prefixes: the best few of every query first, then those of the next that can still reach the k-th exact score
so far, until none can, and the result is certain.

Each task sends on the candidates that its own chunks leave open. Of candidates with the same vector only the k smallest ids can count, so a
vector that is there a million times gives no more than that. Queries are taken in blocks of bounded size, each broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainflow.llm.common import materialise, short_batches, small, table, whole_number
from grainflow.session import checkpoint_folder

#: Vectors of a chunk at most.
CHUNK = 8192
#: Components of this size or more take no part: every score of 2**20 dimensions is then exact in 38 digits.
LIMIT = 2.0**53
#: How much longer each prefix of the bounds' order is than the last.
GROWTH = 4
#: Bounds (queries x candidates), and bounds still in question, that a task holds at once.
CELLS, HELD = 2_000_000, 4_000_000
PACKED = "dim int, ids binary, hashes binary, low binary, step binary, cells binary"
BOUNDS = "query_id long, vec_id long, hash long, lower double, upper double"
WIDE = "decimal(38,0)"


def to_integers(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component.

    Rows drop out whose id is null or whose vector is null or holds a null, NaN, infinity, or a component that gives 2**53 or more (or as much below 0).
    Ids are whole numbers of any type; others are refused.
    """
    if not whole_number(df.schema[id_col].dataType):
        raise TypeError(f"{id_col} must hold whole numbers")
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < LIMIT))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, matrix) of a batch of (vec_id, v, ...), one for each vector length."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, ids[rows], flat[starts[rows, None] + np.arange(dim)].reshape(len(rows), int(dim))


def pack(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunk rows, of one vector length each, from rows (vec_id, v, hash)."""
    schema = pa.schema([("dim", pa.int32()), *((n, pa.binary()) for n in ("ids", "hashes", "low", "step", "cells"))])

    def chunk(ids: np.ndarray, hashes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        low = x.min(0)
        step = (x.max(0) - low) // 2**bits + 1
        cells = ((x - low) // step).astype(np.uint8)
        row = [x.shape[1], *(a.tobytes() for a in (ids, hashes, low, step, cells))]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def joined(dim: int) -> pa.RecordBatch:
            count.pop(dim)
            return chunk(*(np.concatenate(part) for part in zip(*held.pop(dim), strict=True)))

        for batch in batches:
            hashes = batch.column(2).to_numpy()
            for rows, ids, x in _matrices(batch):
                for at in range(0, len(ids), CHUNK):
                    cut, dim = slice(at, at + CHUNK), x.shape[1]
                    held.setdefault(dim, []).append((ids[cut], hashes[rows[cut]], x[cut]))
                    count[dim] = count.get(dim, 0) + len(ids[cut])
                    if count[dim] >= CHUNK:
                        yield joined(dim)
                    elif sum(count[d] * (d + 2) for d in count) > 64 * CHUNK * 64:  # many lengths at once
                        yield joined(max(count, key=lambda d: count[d] * (d + 2)))
        for dim in list(held):
            yield joined(dim)

    return run


class Candidates:
    """The candidates of some queries that bounds leave open, and the k best lower bounds of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.best = np.full((queries, k), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def limit(self) -> np.ndarray:
        """The k-th lower bound, or minus infinity as long as there are fewer."""
        return self.best[:, -1]

    def add(self, q: np.ndarray, ids: np.ndarray, hashes: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        order = np.lexsort((-lower, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        top = order[rank < self.k]
        touched, row = np.unique(q[top], return_inverse=True)
        new = np.full((len(touched), self.k), -np.inf)
        new[row, rank[rank < self.k]] = lower[top]
        self.best[touched] = -np.sort(-np.concatenate([self.best[touched], new], 1), 1)[:, : self.k]
        self.parts.append((q, ids, hashes, lower, upper))
        self.held += len(q)
        if self.held > HELD:
            self.parts = [self.open()]
            self.held = len(self.parts[0][0])

    def open(self) -> tuple[np.ndarray, ...]:
        """What can still be among the k best: (query, id, hash, lower, upper)."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        q, ids, hashes, lower, upper = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        some = np.flatnonzero(upper >= self.limit()[q])
        order = some[np.lexsort((ids[some], hashes[some], q[some]))]
        new = np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])]) if len(order) else np.zeros(0, bool)
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[rank < self.k]
        return q[order], ids[order], hashes[order], lower[order], upper[order]


def scan(found: Candidates, query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, hashes: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> None:
    """Bound the scores of one chunk for the queries `q` from the cells alone."""
    d = q.shape[1]
    weight = q.astype(np.float64) * step
    base = q.astype(np.float64) @ low.astype(np.float64)
    # Rounding of the product in single precision and of the rest in double precision.
    slack = (d + 2) * 2.0**-22 * 256 * np.abs(weight).sum(1) + (d + 2) * 2.0**-51 * (np.abs(q).astype(np.float64) @ np.abs(low).astype(np.float64))
    above = base + np.maximum(q, 0).astype(np.float64) @ (step - 1) + slack
    below = base + np.minimum(q, 0).astype(np.float64) @ (step - 1) - slack
    weight = weight.astype(np.float32)
    width = max(64, CELLS // max(1, len(q)))
    for at in range(0, len(ids), width):
        part = ids[at : at + width]
        corner = weight @ cells[at : at + width].T.astype(np.float32)
        own_row, own_col = np.nonzero(query_ids[:, None] == part[None, :]) if np.isin(query_ids, part).any() else (np.zeros(0, int), np.zeros(0, int))
        corner[own_row, own_col] = -np.inf  # a query is no candidate of its own
        limit = found.limit()
        if np.isneginf(limit).any() and len(part) >= found.k:
            limit = np.maximum(limit, np.partition(corner, -found.k, axis=1)[:, -found.k] + below)
        least = np.nextafter((limit - above).astype(np.float32), np.float32(-np.inf))
        row, col = np.nonzero((corner >= least[:, None]) & (corner > -np.inf))
        if len(row):
            value = corner[row, col].astype(np.float64)
            found.add(row, part[col], hashes[at : at + width][col], value + below[row], value + above[row])


def bounds(block, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over chunk rows: the candidates of every query in `block` that this task's chunks leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {q.shape[1]: (ids, q) for ids, q in block.value}
        found = {d: Candidates(len(ids), k) for d, (ids, _) in queries.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.column("dim")[i].as_py()
                if d in queries:
                    read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                    ids = read("ids", np.int64)
                    scan(found[d], *queries[d], ids, *(read(n, np.int64) for n in ("hashes", "low", "step")), read("cells", np.uint8).reshape(len(ids), d))
        for d, c in found.items():
            q, *rest = c.open()
            for at in range(0, len(q), 100_000):
                columns = [queries[d][0][q[at : at + 100_000]], *(x[at : at + 100_000] for x in rest)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "vec_id", "hash", "lower", "upper"])

    return run


def _blocks(asked: DataFrame, block: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The queries as (ids, matrix) of each vector length, `block` at a time."""
    held: dict[int, tuple[list, list]] = {}
    count = 0
    pack_ = lambda: [(np.array(i, np.int64), np.array(v, np.int64).reshape(len(i), d)) for d, (i, v) in held.items()]
    for r in asked.toLocalIterator():
        ids, vectors = held.setdefault(len(r["v"]), ([], []))
        ids.append(r["vec_id"])
        vectors.append(r["v"])
        count += 1
        if count == block:
            yield pack_()
            held, count = {}, 0
    if count:
        yield pack_()


def write(vectors: DataFrame, path: str, bits: int = 8) -> None:
    """Write the file of cells of (vec_id, v) to `path`, as Parquet."""
    short_batches(vectors.sparkSession)
    vectors.select("vec_id", "v", F.xxhash64("v").alias("hash")).mapInArrow(pack(bits), PACKED).write.parquet(path)


def open_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKED).parquet(path)


def _exact(pairs: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, vec_id, score decimal) of pairs (query_id, vec_id); an id that repeats has a row for each of its vectors."""
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    met = pairs.join(vectors, "vec_id").join(q, "query_id").where(F.size("v") == F.size("q"))
    products = F.zip_with("q", "v", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    top = lambda c: F.coalesce(F.array_max(F.transform(c, F.abs)), F.lit(0)).cast("double")
    plain = top("q") * top("v") * (F.size("v") + 1) < 2.0**62  # then 63 bits do
    small_ = F.aggregate(products, F.lit(0).cast("long"), lambda s, p: s + p["a"] * p["b"]).cast(WIDE)
    wide = F.aggregate(products, F.lit(0).cast(WIDE), lambda s, p: (s + p["a"].cast("decimal(19,0)") * p["b"].cast("decimal(19,0)")).cast(WIDE))
    return met.select("query_id", "vec_id", F.when(plain, small_).otherwise(wide).alias("score"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = 8, block: int = 8192, cells: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, all if fewer.

    Both inputs are (vec_id long, v array<long>), as `to_integers` makes them; `cells` is the opened file of `vectors`, which is
    made and kept for this search if it isn't given. Ties go to the
    smaller vec_id. A candidate with the query's own id is left out, as are vectors of another
    length. Rows that repeat an id are candidates each; a query id that repeats is asked once, with
    its smallest vector. Without vectors or queries the result is empty. Queries are
    broadcast in blocks of `block`, each a scan of the cells. Ranks are exact; a score that doesn't fit a long is null.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    asked = materialise(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    if cells is None:
        cells = materialise(vectors.select("vec_id", "v", F.xxhash64("v").alias("hash")).mapInArrow(pack(bits), PACKED))
    sent = None
    for part in _blocks(asked, block):
        one = cells.mapInArrow(bounds(spark.sparkContext.broadcast(part), k), BOUNDS)
        sent = one if sent is None else sent.unionByName(one)
    if sent is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The k-th lower bound of each query over all tasks, and one vector's k smallest ids.
    ranked = sent.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "hash").orderBy("vec_id", F.desc("lower")))).where(F.col("n") <= k)
    ranked = materialise(ranked.drop("n", "hash"))
    number = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    limits = ranked.withColumn("n", number(F.desc("lower"), "vec_id")).where(F.col("n") == k).select("query_id", F.col("lower").alias("limit"))
    left = ranked.join(small(materialise(limits)), "query_id", "left").where(F.col("limit").isNull() | (F.col("upper") >= F.col("limit")))
    # A row for each id: its vectors, if it has several, are all read.
    left = left.groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper")).withColumn("n", number(F.desc("upper"), "vec_id"))
    left = materialise(left)
    found, high = None, 2 * k
    part = left.where(F.col("n") <= high)
    while True:
        read = materialise(_exact(small(part.select("query_id", "vec_id")), vectors, asked))
        found = read if found is None else found.unionByName(read)
        sure = found.withColumn("n", number(F.desc("score"), "vec_id")).where(F.col("n") == k).select("query_id", F.col("score").cast("double").alias("sure"))
        # Bounds are doubles: what lies below the k-th score by more than their rounding is out.
        hopeful = F.col("sure").isNull() | (F.col("upper") >= F.col("sure") - 2.0**-50 * F.abs("sure"))
        left = materialise(left.where(F.col("n") > high).join(small(materialise(sure)), "query_id", "left").where(hopeful).drop("sure"))
        high *= GROWTH
        if left.isEmpty():
            break
        part = left.where(F.col("n") <= high)
    ranks = found.withColumn("rank", number(F.desc("score"), "vec_id")).where(F.col("rank") <= k)
    fits = F.when(F.col("score").between(F.lit(-(2**63)).cast(WIDE), F.lit(2**63 - 1).cast(WIDE)), F.col("score").cast("long"))
    return ranks.select("query_id", "rank", "vec_id", fits.alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """The cells are written to the folder of checkpoints, opened, and searched."""
    vectors = to_integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    path = f"{checkpoint_folder(spark)}/cells-{uuid.uuid4().hex}"
    write(vectors, path)
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), cells=open_file(spark, path))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
