"""Numbers in an order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.operators.components import checkpointed

#: Bits of a row's place in its partition.
PLACE = 33


def numbered(df: DataFrame, order: list[str | Column], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `name`: 0, 1, ... in the order, from 0 again for each value of `by`.

    Rows are range-sorted once; a row's number is its place in its partition and the rows of the partitions before, of which a row each is counted. The least
    number of each `by` is taken off. Ties fall as they come, but once and for all, as the sorted rows are kept.
    """
    sorted_ = checkpointed(df.orderBy(*by, *order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", PLACE)
    sizes = sorted(tuple(r) for r in sorted_.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, total))
        total += n
    spark = df.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))  # a row for each partition
    out = sorted_.withColumn("__part", part).join(offsets, "__part").withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << PLACE) - 1)))
    out = out.select(*df.columns, name)
    if by:
        first = out.groupBy(*by).agg(F.min(name).alias("__first"))
        out = out.join(first, [*by]).withColumn(name, F.col(name) - F.col("__first")).select(*df.columns, name)
    return out
