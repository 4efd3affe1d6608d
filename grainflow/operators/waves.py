"""Seismic wave speeds over a grid of directions of the lower hemisphere."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.functions import kernels as K

SPEEDS = ("vp", "vs1", "vs2", "vsh", "vsv")


def directions(spark: SparkSession, n: int, whole: bool = False) -> DataFrame:
    """(i, j, azimuth, x, y, z): rows i from the pole z = -1 upwards (to the equator, or over the whole sphere), columns j around the axis."""
    rows = n + 1 if whole else n // 2 + 1
    grid = spark.range(rows * (n + 1)).select(F.floor(F.col("id") / (n + 1)).cast("int").alias("i"), (F.col("id") % (n + 1)).cast("int").alias("j"))
    polar, azimuth = math.pi - F.col("i") * (math.pi / n), F.col("j") * (2 * math.pi / n)
    return grid.select("i", "j", azimuth.alias("azimuth"), (F.sin(polar) * F.cos(azimuth)).alias("x"), (F.sin(polar) * F.sin(azimuth)).alias("y"), F.cos(polar).alias("z"))


def wave_speeds(materials: DataFrame, key: str, n: int = 200, whole: bool = False) -> DataFrame:
    """Speeds and delays of every material (key, stiffness array[36], density) in every direction.

    Materials without stiffness or with a density that is not positive are left out. avs is the shear splitting in
    percent, dts the delay of the slow shear wave, dtp that of the P wave behind the fastest one, both for unit length.
    """
    kind = materials.schema[key].dataType.simpleString()
    ok = materials.where(F.col("stiffness").isNotNull() & (F.col("density") > 0)).select(key, "stiffness", "density")
    pairs = directions(materials.sparkSession, n, whole).join(F.broadcast(ok))  # a grid for each of a few materials

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column(key).to_pylist(), object)
            for value in dict.fromkeys(keys.tolist()):
                part = batch.filter(pa.array(keys == value))
                x, y, z = (part.column(c).to_numpy() for c in "xyz")
                stiff = np.array(part.column("stiffness")[0].as_py()).reshape(6, 6)
                speed = K.wave_speeds(stiff, part.column("density")[0].as_py(), np.arctan2(y, x), np.arccos(np.clip(z, -1, 1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (key, "i", "j", "x", "y", "z")), *(pa.array(np.ascontiguousarray(speed[:, k])) for k in range(5))], names=[key, "i", "j", "x", "y", "z", *SPEEDS])

    out = pairs.mapInArrow(run, f"`{key}` {kind}, i int, j int, x double, y double, z double, " + ", ".join(f"{s} double" for s in SPEEDS))
    fastest = out.groupBy(key).agg(F.max("vp").alias("fastest"))
    vs1, vs2 = F.col("vs1"), F.col("vs2")
    return out.join(F.broadcast(fastest), key).select(*out.columns, ((vs1 - vs2) / ((vs1 + vs2) / 2) * 100).alias("avs"), (1 / vs2 - 1 / vs1).alias("dts"), (1 / F.col("vp") - 1 / F.col("fastest")).alias("dtp"))


def anisotropy(speeds: DataFrame, key: str) -> DataFrame:
    """(key, a_vp, ..., max_avs): the range of each speed in percent of its mid-range."""
    share = lambda c: F.when(F.max(c) + F.min(c) > 0, (F.max(c) - F.min(c)) / ((F.max(c) + F.min(c)) / 2) * 100).otherwise(0.0)
    return speeds.groupBy(key).agg(*(share(s).alias(f"a_{s}") for s in SPEEDS), F.max("avs").alias("max_avs"))
