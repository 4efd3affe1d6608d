"""Order statistics of a column by refining histograms: no sort, and no values gathered but a few."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram, and values that are sorted at last.
BINS, FEW = 1024, 4096


def order_statistic(df: DataFrame, column: str, rank: int) -> float | None:
    """The value of that rank, from 0, among the column's finite values; None if there are fewer.

    Each round counts the values in equal bins of the interval that holds the rank, which becomes a bin, until few values or one are left there. A
    skewed column takes more rounds, not more memory.
    """
    c = F.col(f"`{column}`").cast("double")
    values = df.select(c.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    count, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not 0 <= rank < count:
        return None
    while low < high and count > FEW:
        step = high / BINS - low / BINS
        if not step > 0 or low + step == low:
            break
        inside = values.where(F.col("v").between(low, high))
        bin_ = F.least(F.floor((F.col("v") - low) / step), F.lit(BINS - 1))
        found = inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        for r in found:
            if rank < r["n"]:
                break
            rank -= r["n"]
        count, low, high = r["n"], r["low"], r["high"]
    if low == high:
        return low
    inside = values.where(F.col("v").between(low, high)).groupBy("v").count().orderBy("v")
    for r in inside.toLocalIterator():
        if rank < r["count"]:
            return r["v"]
        rank -= r["count"]
    return None


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The quantile, interpolated between the two order statistics around it; None without values."""
    count = df.where(F.col(f"`{column}`").isNotNull()).count()
    if not count:
        return None
    place = (count - 1) * share
    low = order_statistic(df, column, math.floor(place))
    high = order_statistic(df, column, math.ceil(place)) if place != math.floor(place) else low
    return low + (high - low) * (place - math.floor(place))
