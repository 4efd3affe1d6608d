"""Connected components of a graph: union-find within bounded parts, then star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.session import checkpoint_folder

#: Edges of a part.
PART = 200_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that `checkpoint_folder` names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a part, replaced by one from each node to the least node that it is connected to there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame, part: int = PART) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), whole numbers: the least node of each component.

    Edges are cut into ranges of about `part`, so that neighbours on a map mostly stand together, and each is contracted in a
    task. With one part that is all. Otherwise rounds of large-star and small-star follow on what is left: every node hands its neighbours to its
    least neighbour, until all point to the least node of their component. The rounds grow with the logarithm of the longest path between parts.
    """
    now = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    parts = -(-now.count() // part)
    now = checkpointed((now.repartitionByRange(parts, "a") if parts > 1 else now.coalesce(1)).mapInArrow(_forest, "a long, b long"))
    before = None
    while parts > 1:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        down = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
